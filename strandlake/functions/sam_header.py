"""SAM headers: lines to columns and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The keys of each kind of line, in the order in which they are written.
KEYS = {
    "HD": "VN SO GO SS".split(),
    "SQ": "SN LN UR AH AN AS DS M5 SP TP".split(),
    "RG": "ID PL PU LB DS BC DT FO KS PG PI PM SM CN".split(),
    "PG": "ID PN PP DS VN CL".split(),
}
SORTING = ["unknown", "unsorted", "queryname", "coordinate"]
GROUPING = ["none", "query", "reference"]
PLATFORMS = ["CAPILLARY", "LS454", "ILLUMINA", "SOLID", "HELICOS", "IONTORRENT", "ONT", "PACBIO"]
TOPOLOGY = ["linear", "circular"]
#: Lines are written by kind in this order.
ORDER = ["HD", "SQ", "RG", "PG", "CO"]


def line_type(line: Column) -> Column:
    """The two letters after ``@``; other lines are an error."""
    kind = F.regexp_extract(line, r"^@(HD|SQ|RG|PG|CO)(?:\t|$)", 1)
    return F.when(kind != "", kind).otherwise(F.raise_error(F.concat(F.lit("not a header line: "), line)))


def line_tags(line: Column) -> Column:
    """map<key, value> of the ``KY:value`` fields; other fields are passed over, and of a repeated key the last counts."""
    pairs = F.filter(F.split(line, "\t"), lambda f: f.rlike("^[A-Za-z][A-Za-z0-9]:"))
    keys, values = F.transform(pairs, lambda f: F.substring(f, 1, 2)), F.transform(pairs, lambda f: F.substring(f, 4, 1 << 30))
    last = F.filter(F.sequence(F.lit(1), F.greatest(F.size(keys), F.lit(1))), lambda i: (i <= F.size(keys)) & (F.array_position(F.slice(keys, i + 1, F.size(keys)), F.get(keys, i - 1)) == 0))
    return F.map_from_entries(F.transform(last, lambda i: F.struct(F.get(keys, i - 1), F.get(values, i - 1))))


def alt_locus(text: Column) -> Column:
    """struct<chrom,start,end> of ``chrom:start-end``; null for null and ``*``, an error for other text."""
    pattern = r"^(.+):([0-9]+)-([0-9]+)$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    found = F.struct(part(1).alias("chrom"), part(2).cast("bigint").alias("start"), part(3).cast("bigint").alias("end"))
    return F.when(text.isNull() | (text == "*"), None).when(text.rlike(pattern), found).otherwise(F.raise_error(F.concat(F.lit("not a locus: "), text)))


def one_of(value: Column, allowed: list[str], exact: bool = False) -> Column:
    """The value in the form of the list, compared in either case unless ``exact``; another value is an error."""
    out = F.when(value.isNull(), None)
    for a in allowed:
        out = out.when(value == a if exact else F.lower(value) == a.lower(), F.lit(a))
    return out.otherwise(F.raise_error(F.concat(F.lit("not one of the allowed values: "), value)))


def parse_header(lines: DataFrame) -> DataFrame:
    """line_no, type, tags and comment of lines (line_no, line); kinds are checked, and the first has to be @HD."""
    kind = line_type(F.col("line"))
    first = F.when((F.col("line_no") == 0) & (kind != "HD"), F.raise_error(F.lit("a header begins with @HD"))).otherwise(kind)
    comment = F.when(F.col("line").startswith("@CO"), F.substring("line", 5, 1 << 30))
    return lines.select("line_no", first.alias("type"), F.when(~F.col("line").startswith("@CO"), line_tags(F.col("line"))).alias("tags"), comment.alias("comment"))


def typed_sq(tags: Column) -> Column:
    """The @SQ line's fields in their types."""
    get = lambda k: F.try_element_at(tags, F.lit(k))
    return F.struct(get("SN").alias("SN"), get("LN").cast("bigint").alias("LN"), alt_locus(get("AH")).alias("AH"), F.split(get("AN"), ",").alias("AN"), get("AS").alias("AS"), get("DS").alias("DS"), get("M5").alias("M5"), get("SP").alias("SP"), one_of(get("TP"), TOPOLOGY).alias("TP"), get("UR").alias("UR"))


def format_line(kind: str, tags: Column) -> Column:
    """A header line with its keys in the order of writing; absent keys are left out."""
    fields = [F.concat(F.lit(f"{k}:"), F.try_element_at(tags, F.lit(k))) for k in KEYS[kind]]
    return F.concat_ws("\t", F.lit(f"@{kind}"), *fields)


def format_header(parsed: DataFrame) -> DataFrame:
    """(rank, line_no, line) of a parsed header, to be written in that order: by kind, then as they stood."""
    line = F.when(F.col("type") == "CO", F.concat(F.lit("@CO\t"), F.coalesce("comment", F.lit(""))))
    for kind in KEYS:
        line = line.when(F.col("type") == kind, format_line(kind, F.col("tags")))
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("type"))
    return parsed.select(rank.alias("rank"), "line_no", line.alias("line"))


def group_ids(parsed: DataFrame) -> DataFrame:
    """The read groups' ids."""
    return parsed.filter("type = 'RG'").select(F.try_element_at("tags", F.lit("ID")).alias("group_id"))


def references(parsed: DataFrame) -> DataFrame:
    """(ref_id, name, length) in the order of the @SQ lines; a header's lines are few."""
    rows = parsed.filter("type = 'SQ'").select("line_no", F.try_element_at("tags", F.lit("SN")).alias("name"), F.try_element_at("tags", F.lit("LN")).cast("int").alias("length"))
    at = rows.agg(F.array_sort(F.collect_list(F.struct("line_no", "name", "length"))).alias("all"))
    return at.select(F.posexplode("all").alias("ref_id", "r")).select("ref_id", "r.name", "r.length")
