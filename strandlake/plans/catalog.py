"""The queries over sequences, alignments and codecs with their SQL, as the driver's entry file registers them.

The driver's tables stand for the domain's: documents are sequences (header doc_id), benchmark texts are patterns,
page addresses are short sequences, line items are alignments (see ``alignments``), events are regions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bins, cigar, dna, flags, sam_header, tags
from ..functions.reconstruct import reconstruct_reference
from ..operators import blocks, fmindex, intervals, search, textindex
from ..session import shared_dir, ship, stored
from ..sources import register
from ..streaming.landing import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PATTERN, SELF_OVERLAPPING = "the", "ee"


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def big(column) -> F.Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


def sequences(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("header"), F.col("text").alias("seq"), big(F.length("text")).alias("seq_len"), F.col("doc_id").alias("file_offset"), "lang", "source")


def addresses(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("header"), F.col("url").alias("seq"))


CIGAR_SQL = "concat(l_linenumber, 'S', CAST(l_quantity AS INT), 'M', l_suppkey % 5 + 1, 'D')"
#: Line items as alignments, in SQL.
ALN = f"""(SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS ref_id, l_orderkey * 37 + 1 AS pos, l_partkey % 4096 AS flag,
  l_suppkey % 61 AS mapq, {CIGAR_SQL} AS cigar, CAST(l_quantity AS BIGINT) + l_suppkey % 5 + 1 AS ref_len,
  l_orderkey * 1000 + l_linenumber AS voffset FROM lineitem)"""
END_SQL = "CASE WHEN flag & 4 <> 0 THEN 0 ELSE pos + ref_len - 1 END"
BIN_SQL = """CASE WHEN ({a}) >> 14 = (({b}) - 1) >> 14 THEN 4681 + (({a}) >> 14) WHEN ({a}) >> 17 = (({b}) - 1) >> 17 THEN 585 + (({a}) >> 17)
  WHEN ({a}) >> 20 = (({b}) - 1) >> 20 THEN 73 + (({a}) >> 20) WHEN ({a}) >> 23 = (({b}) - 1) >> 23 THEN 9 + (({a}) >> 23)
  WHEN ({a}) >> 26 = (({b}) - 1) >> 26 THEN 1 + (({a}) >> 26) ELSE 0 END"""


def alignments(spark, sf_dir, ordered: bool = False) -> DataFrame:
    """Line items as alignments; ``ordered`` by reference and position, which the numbers they are made of have, before texts are made."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    if ordered:
        l = l.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity").orderBy("l_linenumber", "l_orderkey")  # noqa: E741
    text = F.concat(F.col("l_linenumber").cast("string"), F.lit("S"), F.col("l_quantity").cast("int").cast("string"), F.lit("M"), (F.col("l_suppkey") % 5 + 1).cast("string"), F.lit("D"))
    base = l.select("l_orderkey", big("l_linenumber").alias("ref_id"), (F.col("l_orderkey") * 37 + 1).alias("pos"), (F.col("l_partkey") % 4096).alias("flag"), (F.col("l_suppkey") % 61).alias("mapq"), text.alias("cigar"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("voffset"))
    ops = base.withColumn("ops", cigar.parse_cigar(F.col("cigar")))
    placed = ops.withColumn("end_pos", cigar.alignment_end(F.col("flag"), F.col("pos"), F.col("ops"))).withColumn("voffset_end", F.col("voffset") + 1)
    return placed.withColumn("bin", bins.record_bin(F.col("flag"), F.col("ref_id"), F.col("pos"), F.col("end_pos")))


ALN_BIN = f"(SELECT *, CASE WHEN flag & 4 <> 0 THEN 37450 ELSE {BIN_SQL.format(a='pos - 1', b='end_pos')} END AS bin FROM (SELECT *, {END_SQL} AS end_pos FROM {ALN}))"


# Search


@query(f"SELECT doc_id AS header, CAST((length(text) - length(replace(text, '{PATTERN}', ''))) // {len(PATTERN)} AS BIGINT) AS n_matches FROM documents WHERE contains(text, '{PATTERN}')")
def q_count_pattern(spark, sf_dir):
    return search.count_pattern(sequences(spark, sf_dir), PATTERN)


@query("SELECT header, n_matches FROM (SELECT doc_id AS header, CAST(len(list_filter(range(1, len(c)), lambda i: c[i] = 'e' AND c[i + 1] = 'e')) AS BIGINT) AS n_matches FROM (SELECT doc_id, string_split(text, '') AS c FROM documents)) WHERE n_matches > 0")
def q_count_overlap(spark, sf_dir):
    return search.count_pattern(sequences(spark, sf_dir), SELF_OVERLAPPING)


@query(f"SELECT lang, CAST(sum((length(text) - length(replace(text, '{PATTERN}', ''))) // {len(PATTERN)}) AS BIGINT) AS n_matches FROM documents WHERE contains(text, '{PATTERN}') GROUP BY ROLLUP (lang)")
def q_count_total_rollup(spark, sf_dir):
    s = sequences(spark, sf_dir).filter(F.col("seq").contains(PATTERN))
    return s.rollup("lang").agg(F.sum(search.count_in(F.col("seq"), PATTERN)).alias("n_matches"))


@query(f"SELECT doc_id AS header, CAST((length(text) - length(replace(text, '{PATTERN}', ''))) // {len(PATTERN)} AS BIGINT) AS n_matches FROM documents WHERE doc_id = 7 AND contains(text, '{PATTERN}')")
def q_count_in_header(spark, sf_dir):
    return search.count_pattern(search.named(sequences(spark, sf_dir), 7), PATTERN)


#: Positions of a pattern that can't overlap itself: the parts between matches, added up.
PLACES = """(SELECT {key} AS header, CAST(sum(length(part) + {size}) OVER (PARTITION BY {key} ORDER BY i) - {size} AS BIGINT) AS pos, i, n
  FROM (SELECT {key}, unnest(string_split({text}, {pattern})) AS part, generate_subscripts(string_split({text}, {pattern}), 1) AS i, len(string_split({text}, {pattern})) AS n FROM {source}))"""
DOC_PLACES = PLACES.format(key="doc_id", size=len(PATTERN), text="text", pattern=f"'{PATTERN}'", source=f"(SELECT * FROM documents WHERE contains(text, '{PATTERN}'))")


@query(f"SELECT header, pos FROM {DOC_PLACES} WHERE i < n")
def q_locate(spark, sf_dir):
    return search.locate_pattern(sequences(spark, sf_dir), PATTERN)


@query(f"SELECT header, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM {DOC_PLACES} WHERE i < n GROUP BY header")
def q_locate_agg_sorted(spark, sf_dir):
    ship(spark)
    s = sequences(spark, sf_dir).filter(F.col("seq").contains(PATTERN))
    return s.select("header", F.array_join(search.positions_in(PATTERN)(F.col("seq")).cast("array<string>"), ",").alias("positions"))


@query(f"SELECT header, pos FROM {DOC_PLACES} WHERE i < n")
def q_tiled_locate(spark, sf_dir):
    return search.locate_in_tiles(search.tiles(sequences(spark, sf_dir), longest=len(PATTERN), tile=1000), PATTERN)


@query(f"SELECT doc_id AS header, CAST((length(text) - length(replace(text, '{PATTERN}', ''))) // {len(PATTERN)} AS BIGINT) AS n_matches FROM documents WHERE contains(text, '{PATTERN}')")
def q_tiled_count(spark, sf_dir):
    return q_tiled_locate(spark, sf_dir).groupBy("header").agg(F.count(F.lit(1)).alias("n_matches"))


@query(f"SELECT doc_id AS header, '>' || doc_id || ' found : ' || (length(text) - length(replace(text, '{PATTERN}', ''))) // {len(PATTERN)} AS line FROM documents WHERE contains(text, '{PATTERN}')")
def q_report_lines(spark, sf_dir):
    counts = q_count_pattern(spark, sf_dir)
    return counts.select("header", F.concat(F.lit(">"), F.col("header").cast("string"), F.lit(" found : "), F.col("n_matches").cast("string")).alias("line"))


@query(f"SELECT source, count(*) AS n FROM documents d WHERE EXISTS (SELECT 1 FROM documents e WHERE e.doc_id = d.doc_id AND contains(e.text, '{PATTERN}')) GROUP BY source")
def q_left_semi_hits(spark, sf_dir):
    s = sequences(spark, sf_dir)
    hits = search.count_pattern(s, PATTERN).select("header")
    return s.join(hits, "header", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id AS header, substring(text, 11, CAST(greatest(least(60, length(text)) - 10, 0) AS BIGINT)) AS bases FROM documents")
def q_extract_region(spark, sf_dir):
    return sequences(spark, sf_dir).select("header", search.extract_column(F.col("seq"), 10, 60).alias("bases"))


@query("SELECT doc_id AS header, substring(text, 3, length(text)) AS bases FROM documents WHERE doc_id = 5")
def q_extract_named(spark, sf_dir):
    return search.extract(sequences(spark, sf_dir), 5, 2)


@query("SELECT doc_id AS header, CAST(length(text) AS BIGINT) AS seq_len FROM documents")
def q_seq_lengths(spark, sf_dir):
    return sequences(spark, sf_dir).select("header", "seq_len")


@query("SELECT source, count(*) AS n_sequences, CAST(sum(length(text) + 1) AS BIGINT) AS block_size, CAST(max(length(text)) AS BIGINT) AS longest FROM documents GROUP BY source")
def q_block_size(spark, sf_dir):
    s = sequences(spark, sf_dir).withColumnRenamed("source", "block_id")
    return blocks.block_catalog(s).withColumnRenamed("block_id", "source")


@query("SELECT DISTINCT source, lang FROM documents")
def q_list_headers(spark, sf_dir):
    return sequences(spark, sf_dir).select("source", "lang").distinct()


@query("SELECT doc_id AS header, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS place FROM documents")
def q_order_len_desc(spark, sf_dir):
    ranged = sequences(spark, sf_dir).select("header", (-F.col("seq_len")).alias("neg"), F.lit(0).cast("bigint").alias("seq_len"))
    placed = blocks.cumulative_offsets(ranged.withColumn("_key", F.struct("neg", "header")), "_key")
    return placed.select("header", (F.col("text_begin") + 1).alias("place"))


@query("SELECT source, CAST(n_chars AS BIGINT) AS seq_len, min(doc_id) AS file_offset FROM documents GROUP BY source, n_chars")
def q_dedup_header_len(spark, sf_dir):
    s = sequences(spark, sf_dir).select(F.col("source").alias("header"), "seq_len", "file_offset")
    return blocks.dedup_sequences(s).select(F.col("header").alias("source"), "seq_len", "file_offset")


@query("SELECT doc_id AS header, CAST(coalesce(sum(length(text) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS text_begin FROM documents")
def q_cum_offsets(spark, sf_dir):
    return blocks.cumulative_offsets(sequences(spark, sf_dir).select("header", "seq_len"), "header").select("header", "text_begin")


@query("""WITH o AS (SELECT doc_id, length(text) AS n, coalesce(sum(length(text) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents)
SELECT event_id, doc_id AS header, CAST(event_id * 131 - b AS BIGINT) AS pos FROM events JOIN o ON event_id * 131 >= b AND event_id * 131 < b + n""")
def q_owner_of_position(spark, sf_dir):
    offsets = blocks.cumulative_offsets(sequences(spark, sf_dir).select("header", "seq_len"), "header")
    places = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 131).alias("text_pos"))
    return blocks.owner_of(places, offsets).select("event_id", "header", "pos")


@query("""SELECT item_id, doc_id AS header, CAST(sum(length(part) + m) OVER (PARTITION BY item_id, doc_id ORDER BY i) - m AS BIGINT) AS pos FROM (
  SELECT item_id, doc_id, length(b.text) AS m, unnest(string_split(d.text, b.text)) AS part, generate_subscripts(string_split(d.text, b.text), 1) AS i, len(string_split(d.text, b.text)) AS n
  FROM documents d JOIN benchmark b ON contains(d.text, b.text)) QUALIFY i < n""")
def q_seed_join_eq_bruteforce(spark, sf_dir):
    patterns = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("pattern"))
    return search.seed_join(sequences(spark, sf_dir), patterns).select("item_id", "header", "pos")


@query("""WITH q AS (SELECT item_id, translate(text, 'U', 'T') AS t FROM benchmark WHERE length(text) > 0),
s AS (SELECT item_id, '+' AS strand, t AS p FROM q UNION ALL SELECT item_id, '-', translate(reverse(t), 'ACGT', 'TGCA') FROM q),
h AS (SELECT item_id, strand, p, doc_id, unnest(string_split(text, p)) AS part, generate_subscripts(string_split(text, p), 1) AS i, len(string_split(text, p)) AS n FROM documents JOIN s ON contains(text, p))
SELECT CAST(doc_id AS VARCHAR) AS seqid, 'strandlake' AS source, 'dna' AS type, CAST(place + 1 AS BIGINT) AS "start", CAST(place + length(p) AS BIGINT) AS "end", '1.000' AS score, strand, '.' AS phase, 'ID=' || item_id AS attributes
FROM (SELECT *, sum(length(part) + length(p)) OVER (PARTITION BY item_id, strand, doc_id ORDER BY i) - length(p) AS place FROM h) WHERE i < n""")
def q_gff_both_strands(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("header"), F.col("text").alias("seq"))
    return search.gff_search(sequences(spark, sf_dir), queries)


# Scalars


@query("SELECT doc_id AS header, translate(reverse(text), 'ACGT', 'TGCA') AS rc FROM documents")
def q_revcomp(spark, sf_dir):
    return sequences(spark, sf_dir).select("header", dna.reverse_complement(F.col("seq")).alias("rc"))


@query("SELECT doc_id AS header, translate(text, 'U', 'T') AS dna FROM documents")
def q_rna_to_dna(spark, sf_dir):
    return sequences(spark, sf_dir).select("header", dna.rna_to_dna(F.col("seq")).alias("dna"))


@query("SELECT doc_id, 'ID=' || array_to_string([source, lang, CAST(n_chars AS VARCHAR)], ';Note=') AS attributes FROM documents")
def q_gff_attributes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", dna.gff_attributes(F.concat_ws("|", "source", "lang", F.col("n_chars").cast("string"))).alias("attributes"))


@query("SELECT page_id, CASE WHEN length(url) % 50 = 0 AND length(url) > 0 THEN rtrim(w, chr(10)) ELSE w END AS wrapped FROM (SELECT page_id, url, regexp_replace(url, '(.{50})', '\\1' || chr(10), 'g') AS w FROM pages)")
def q_wrap50(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", dna.wrap(F.col("url"), 50).alias("wrapped"))


@query("SELECT doc_id, regexp_replace(text, '[\\r\\n]', '', 'g') AS stripped FROM documents")
def q_strip_crlf(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", dna.strip_line_ends(F.col("text")).alias("stripped"))


@query("SELECT l_orderkey, l_linenumber, chr(CAST(33 + CAST(l_quantity AS BIGINT) % 41 AS INT)) || chr(CAST(33 + l_suppkey % 41 AS INT)) AS qual, CAST(CAST(l_quantity AS BIGINT) % 41 + l_suppkey % 41 AS BIGINT) AS total FROM lineitem")
def q_phred(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    q = l.withColumn("q", F.array(big("l_quantity") % 41, F.col("l_suppkey") % 41)).withColumn("qual", dna.phred_of(F.col("q")))
    return q.select("l_orderkey", "l_linenumber", "qual", F.aggregate(dna.qualities_of(F.col("qual")), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("SELECT page_id, array_to_string(list_transform(string_split(url, ''), lambda c: CASE WHEN strpos('=ACMGRSVTWYHKDBN', upper(c)) = 0 THEN '.' ELSE CAST(strpos('=ACMGRSVTWYHKDBN', upper(c)) - 1 AS VARCHAR) END), ',') AS codes FROM pages")
def q_base_encode(spark, sf_dir):
    codes = F.transform(dna.base_codes(F.col("url")), lambda c: F.coalesce(c.cast("string"), F.lit(".")))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(codes, ",").alias("codes"))


@query("SELECT l_orderkey, l_linenumber, substring('=ACMGRSVTWYHKDBN', CAST(l_partkey % 16 + 1 AS BIGINT), 1) || substring('=ACMGRSVTWYHKDBN', CAST(l_suppkey % 16 + 1 AS BIGINT), 1) AS bases FROM lineitem")
def q_base_decode(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", dna.bases_of(F.array(F.col("l_partkey") % 16, F.col("l_suppkey") % 16)).alias("bases"))


def _flag_query(number: int, name: str, mask: int) -> None:
    def run(spark, sf_dir):
        a = alignments(spark, sf_dir)
        return a.groupBy("ref_id").agg(F.count_if(flags.has_flag(F.col("flag"), name)).alias(name))

    run.__name__ = f"q_flag_{number:02d}"
    query(f"SELECT ref_id, CAST(count(*) FILTER (WHERE flag & {mask} <> 0) AS BIGINT) AS {name} FROM {ALN} GROUP BY ref_id")(run)


for _i, (_name, _mask) in enumerate(flags.FLAGS.items(), 1):
    _flag_query(_i, _name, _mask)


@query("SELECT " + ", ".join(f"CAST(count(*) FILTER (WHERE flag & {m} <> 0) AS BIGINT) AS {n}" for n, m in flags.FLAGS.items()) + f" FROM {ALN}")
def q_flag_histogram(spark, sf_dir):
    return alignments(spark, sf_dir).agg(*[F.count_if(flags.has_flag(F.col("flag"), n)).alias(n) for n in flags.FLAGS])


@query(f"SELECT l_orderkey, ref_id, flag | 1024 AS marked, flag - (flag & 16) AS forward FROM {ALN}")
def q_flag_set_clear(spark, sf_dir):
    f = F.col("flag")
    return alignments(spark, sf_dir).select("l_orderkey", "ref_id", flags.set_flag(f, "optical_duplicate").alias("marked"), flags.clear_flag(f, "reverse_complemented").alias("forward"))


@query(f"SELECT l_orderkey, ref_id, CAST(u.i AS BIGINT) AS i, regexp_extract(u.t, '[MIDNSHP=X]') AS op, CAST(regexp_extract(u.t, '[0-9]+') AS BIGINT) AS len FROM (SELECT l_orderkey, ref_id, unnest(list_transform(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), lambda t, i: {{'t': t, 'i': i - 1}})) AS u FROM {ALN})")
def q_cigar_parse(spark, sf_dir):
    return alignments(spark, sf_dir).select("l_orderkey", "ref_id", F.posexplode("ops").alias("i", "o")).select("l_orderkey", "ref_id", big("i").alias("i"), "o.op", "o.len")


@query(f"SELECT l_orderkey, ref_id, cigar FROM {ALN}")
def q_cigar_format(spark, sf_dir):
    return alignments(spark, sf_dir).select("l_orderkey", "ref_id", cigar.format_cigar(F.col("ops")).alias("cigar"))


@query(f"SELECT l_orderkey, ref_id, ref_len FROM {ALN}")
def q_cigar_reflen(spark, sf_dir):
    return alignments(spark, sf_dir).select("l_orderkey", "ref_id", cigar.reference_length(F.col("ops")).alias("ref_len"))


@query(f"SELECT l_orderkey, ref_id, {END_SQL} AS end_pos FROM {ALN}")
def q_alignment_end(spark, sf_dir):
    return alignments(spark, sf_dir).select("l_orderkey", "ref_id", "end_pos")


@query(f"SELECT l_orderkey, ref_id, CAST({BIN_SQL.format(a='pos - 1', b='pos + ref_len - 1')} AS BIGINT) AS bin FROM {ALN}")
def q_reg2bin(spark, sf_dir):
    a = alignments(spark, sf_dir)
    return a.select("l_orderkey", "ref_id", bins.reg2bin(F.col("pos") - 1, F.col("pos") + cigar.reference_length(F.col("ops")) - 1).alias("bin"))


@query("""SELECT event_id, array_to_string(list_sort(list_concat([0], range(1 + (a >> 26), 2 + (b >> 26)), range(9 + (a >> 23), 10 + (b >> 23)), range(73 + (a >> 20), 74 + (b >> 20)), range(585 + (a >> 17), 586 + (b >> 17)), range(4681 + (a >> 14), 4682 + (b >> 14)))), ',') AS bins
FROM (SELECT event_id, event_id * 100 AS a, event_id * 100 + 70000 - 1 AS b FROM events)""")
def q_reg2bins(spark, sf_dir):
    begin = F.col("event_id") * 100
    found = F.array_sort(bins.reg2bins(begin, begin + 70000)).cast("array<string>")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(found, ",").alias("bins"))


@query(f"SELECT l_orderkey, ref_id, CAST(bin AS BIGINT) AS bin FROM {ALN_BIN}")
def q_record_bin(spark, sf_dir):
    return alignments(spark, sf_dir).select("l_orderkey", "ref_id", "bin")


@query("SELECT event_id, v, v >> 16 AS block, v & 65535 AS inside FROM (SELECT event_id, ((event_id * 977) << 16) | (user_id % 65536) AS v FROM events)")
def q_voffset_pack_unpack(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", bins.virtual_offset(F.col("event_id") * 977, F.col("user_id") % 65536))
    return e.select("event_id", "v", bins.offset_block(F.col("v")).alias("block"), bins.offset_inside(F.col("v")).alias("inside"))


@query("""SELECT l_orderkey, l_linenumber, array_to_string(regexp_extract_all(concat(CAST(l_quantity AS INT), 'A', l_linenumber, '^GT', l_suppkey % 9), '[0-9]+(?:[A-Z]|\\^[A-Z]+)?'), '|') AS tokens FROM lineitem""")
def q_md_tokens(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    md = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("A"), F.col("l_linenumber").cast("string"), F.lit("^GT"), (F.col("l_suppkey") % 9).cast("string"))
    return l.select("l_orderkey", "l_linenumber", F.array_join(cigar.md_tokens(md), "|").alias("tokens"))


@query("SELECT event_id, user_id % 100 AS nm, event_type AS rg FROM events")
def q_tag_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    made = F.create_map(F.lit("NM"), tags.make_tag("C", F.lit(0)), F.lit("RG"), tags.make_tag("Z", F.col("event_type")))
    held = e.withColumn("t", tags.set_tag(made, "NM", "i", F.col("user_id") % 100))
    return held.select("event_id", tags.int_tag(F.col("t"), "NM").alias("nm"), tags.read_group(F.col("t")).alias("rg"))


@query("SELECT s_suppkey, s_name AS sn, 1000 + s_suppkey AS ln, 'linear' AS tp, 'chr' || s_nationkey AS chrom, s_suppkey * 10 AS \"begin\", s_suppkey * 10 + 5 AS \"end\", CAST(2 AS BIGINT) AS n_names FROM supplier")
def q_header_parse(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    locus = F.concat(F.lit("chr"), F.col("s_nationkey").cast("string"), F.lit(":"), (k * 10).cast("string"), F.lit("-"), (k * 10 + 5).cast("string"))
    line = F.concat(F.lit("@SQ\tSN:"), F.col("s_name"), F.lit("\tLN:"), (k + 1000).cast("string"), F.lit("\tAH:"), locus, F.lit("\tAN:one,uno\tTP:LINEAR"))
    t = s.withColumn("sq", sam_header.typed_sq(sam_header.line_tags(line)))
    return t.select("s_suppkey", F.col("sq.SN").alias("sn"), F.col("sq.LN").alias("ln"), F.col("sq.TP").alias("tp"), F.col("sq.AH.chrom").alias("chrom"), F.col("sq.AH.start").alias("begin"), F.col("sq.AH.end").alias("end"), big(F.size("sq.AN")).alias("n_names"))


@query("SELECT s_suppkey, '@SQ' || chr(9) || 'SN:' || s_name || chr(9) || 'LN:' || (1000 + s_suppkey) || chr(9) || 'TP:linear' AS line FROM supplier")
def q_header_format(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    made = F.create_map(F.lit("TP"), F.lit("linear"), F.lit("LN"), (F.col("s_suppkey") + 1000).cast("string"), F.lit("SN"), F.col("s_name"))
    return s.select("s_suppkey", sam_header.format_line("SQ", made).alias("line"))


@query(f"SELECT l_orderkey, ref_id, CAST(mapq AS BIGINT) AS mapq, CAST(flag AS BIGINT) AS flag, pos FROM {ALN} WHERE flag & 4 = 0 AND mapq >= 30")
def q_record_projection(spark, sf_dir):
    a = alignments(spark, sf_dir).filter(~flags.has_flag(F.col("flag"), "unmapped_segment") & (F.col("mapq") >= 30))
    return a.select("l_orderkey", "ref_id", big("mapq").alias("mapq"), big("flag").alias("flag"), "pos")


# Intervals

REGION_SQL = "(SELECT event_id, event_id % 7 + 1 AS region_ref, event_id * 53 AS \"begin\", event_id * 53 + 40 AS \"end\" FROM events)"


def regions(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", (F.col("event_id") % 7 + 1).alias("region_ref"), (F.col("event_id") * 53).alias("begin"), (F.col("event_id") * 53 + 40).alias("end"))


@query(f"SELECT event_id, l_orderkey, ref_id, pos, end_pos FROM {ALN_BIN} a JOIN {REGION_SQL} r ON ref_id = region_ref AND pos < r.\"end\" AND end_pos > r.\"begin\"")
def q_overlap_join(spark, sf_dir):
    met = intervals.overlap_join(alignments(spark, sf_dir), regions(spark, sf_dir))
    return met.select("event_id", "l_orderkey", "ref_id", "pos", "end_pos")


@query(f"SELECT event_id, l_orderkey, n_name AS rname FROM {ALN_BIN} a JOIN {REGION_SQL} r ON ref_id = region_ref AND pos < r.\"end\" AND end_pos > r.\"begin\" LEFT JOIN nation ON ref_id = n_nationkey")
def q_overlap_with_refname(spark, sf_dir):
    refs = table(spark, sf_dir, "nation").select(big("n_nationkey").alias("ref_id"), F.col("n_name").alias("name"))
    met = intervals.overlap_join(alignments(spark, sf_dir).withColumn("next_ref_id", F.lit(-1)), regions(spark, sf_dir))
    return intervals.with_reference_names(met, refs).select("event_id", "l_orderkey", "rname")


@query(f"SELECT ref_id, CAST(bin AS BIGINT) AS bin, CAST(count(*) FILTER (WHERE flag & 4 = 0) AS BIGINT) AS n_mapped, CAST(count(*) FILTER (WHERE flag & 4 <> 0) AS BIGINT) AS n_unmapped, min(voffset) AS first_voffset, max(voffset) + 1 AS last_voffset FROM {ALN_BIN} GROUP BY ref_id, bin")
def q_bin_stats(spark, sf_dir):
    return intervals.bin_counts(alignments(spark, sf_dir))


@query(f"""WITH c AS (SELECT ref_id, bin, voffset AS a, voffset + 1 AS b FROM {ALN_BIN}),
f AS (SELECT *, max(b) OVER (PARTITION BY ref_id, bin ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM c),
g AS (SELECT *, sum(CASE WHEN far IS NOT NULL AND a > far AND a >> 16 <> far >> 16 THEN 1 ELSE 0 END) OVER (PARTITION BY ref_id, bin ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS n FROM f)
SELECT ref_id, CAST(bin AS BIGINT) AS bin, min(a) AS chunk_beg, max(b) AS chunk_end FROM g GROUP BY ref_id, bin, n""")
def q_chunk_merge(spark, sf_dir):
    a = alignments(spark, sf_dir)
    return intervals.merge_chunks(a.select("ref_id", "bin", F.col("voffset").alias("chunk_beg"), F.col("voffset_end").alias("chunk_end")))


@query(f"SELECT ref_id, CAST(w AS BIGINT) AS win, min(voffset) AS voffset FROM (SELECT ref_id, voffset, unnest(range((pos - 1) >> 14, ((greatest(end_pos, pos) - 1) >> 14) + 1)) AS w FROM {ALN_BIN} WHERE flag & 4 = 0) GROUP BY ref_id, w")
def q_linear_index(spark, sf_dir):
    return intervals.linear_index(alignments(spark, sf_dir))


@query(f"SELECT CAST(count(*) FILTER (WHERE ref_id < 0) AS BIGINT) AS unplaced, max(CASE WHEN ref_id >= 0 THEN voffset + 1 END) AS last_mapped FROM {ALN}")
def q_index_totals(spark, sf_dir):
    return intervals.build_index(alignments(spark, sf_dir))[2]


# Text statistics and index structures


@query("SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch")
def q_char_hist(spark, sf_dir):
    return textindex.histogram(sequences(spark, sf_dir))


@query("SELECT round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 9) AS entropy FROM (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch)")
def q_entropy(spark, sf_dir):
    return textindex.entropy(textindex.histogram(sequences(spark, sf_dir))).select(F.round("entropy", 9).alias("entropy"))


@query("SELECT ch, n, CAST(coalesce(sum(n) OVER (ORDER BY ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"start\" FROM (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch)")
def q_symbol_starts(spark, sf_dir):
    return textindex.symbol_starts(textindex.histogram(sequences(spark, sf_dir)))


LETTERS = "(SELECT page_id AS header, CAST(generate_subscripts(string_split(url, ''), 1) - 1 AS BIGINT) AS pos, unnest(string_split(url, '')) AS ch FROM pages)"


@query(f"SELECT header, pos, CAST(count(*) FILTER (WHERE ch = 'e') OVER (PARTITION BY header ORDER BY pos) - 1 AS BIGINT) AS rank FROM {LETTERS}")
def q_rank_symbol(spark, sf_dir):
    return textindex.rank_symbol(textindex.letters(addresses(spark, sf_dir)), "e").select("header", "pos", "rank")


@query(f"SELECT header, pos FROM (SELECT *, row_number() OVER (PARTITION BY header ORDER BY pos) AS k FROM {LETTERS} WHERE ch = 'e') WHERE k = 2")
def q_select_symbol(spark, sf_dir):
    return textindex.select_symbol(textindex.letters(addresses(spark, sf_dir)), "e", 2)


SUFFIXES = f"(SELECT header, pos, CAST(row_number() OVER (PARTITION BY header ORDER BY substring(url, pos + 1)) - 1 AS BIGINT) AS sa_rank, CASE WHEN pos > 0 THEN substring(url, pos, 1) END AS bwt, url FROM {LETTERS} JOIN pages ON page_id = header)"


@query(f"SELECT header, sa_rank, pos FROM {SUFFIXES}")
def q_suffix_array(spark, sf_dir):
    return textindex.suffix_array(addresses(spark, sf_dir)).select("header", "sa_rank", "pos")


@query(f"SELECT header, string_agg(coalesce(bwt, '$'), '' ORDER BY sa_rank) AS bwt FROM {SUFFIXES} GROUP BY header")
def q_bwt(spark, sf_dir):
    sa = textindex.suffix_array(addresses(spark, sf_dir))
    rows = sa.groupBy("header").agg(F.array_sort(F.collect_list(F.struct("sa_rank", F.coalesce("bwt", F.lit("$")).alias("c")))).alias("l"))
    return rows.select("header", F.array_join(F.transform("l", lambda x: x["c"]), "").alias("bwt"))


@query(f"SELECT header, sa_rank, pos FROM {SUFFIXES} WHERE pos % 32 = 0")
def q_sampled_sa(spark, sf_dir):
    return textindex.sampled(textindex.suffix_array(addresses(spark, sf_dir))).select("header", "sa_rank", "pos")


@query(f"SELECT header, min(sa_rank) AS sp, max(sa_rank) AS ep, count(*) AS n FROM {SUFFIXES} WHERE substring(url, pos + 1, 2) = 'th' GROUP BY header")
def q_backward_search(spark, sf_dir):
    return fmindex.backward_search(fmindex.build_indexes(addresses(spark, sf_dir)), "th")


@query("""SELECT doc_id AS header, ((n - 1) >> 16) * 6 + ((n - 1) >> 9) * 2 + ((n + 7) >> 3) AS bit_bytes,
  ((n - 1) >> 16) * 6 + ((n - 1) >> 9) * 2 + ((n + 7) >> 3) + length(bin(m)) * (((m - 1) >> 16) * 6 + ((m - 1) >> 9) * 2 + ((m + 7) >> 3)) AS index_bytes
FROM (SELECT doc_id, CAST(length(text) + 1 AS BIGINT) AS n, CAST(ceil((length(text) + 1) / 32) AS BIGINT) AS m FROM documents)""")
def q_index_size(spark, sf_dir):
    n = F.col("seq_len") + 1
    return sequences(spark, sf_dir).select("header", bins.bit_vector_bytes(n).alias("bit_bytes"), bins.sampled_index_bytes(n).alias("index_bytes"))


@query(f"""SELECT header, sa_rank, CAST(CASE WHEN p IS NULL THEN 0 ELSE len(list_filter(range(1, least(length(s), length(p)) + 1), lambda i: s[1:i] = p[1:i])) END AS BIGINT) AS lcp
FROM (SELECT header, sa_rank, s, lag(s) OVER (PARTITION BY header ORDER BY sa_rank) AS p FROM (SELECT header, sa_rank, substring(url, pos + 1) AS s FROM {SUFFIXES}))""")
def q_common_prefixes(spark, sf_dir):
    return textindex.common_prefixes(addresses(spark, sf_dir))


@query("""WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS crc)
SELECT doc_id AS header, xor(list_reduce(list_transform(range(octet_length(encode(text))), lambda i: CAST('0x' || substring(hex(encode(text)), 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) AS crc32 FROM documents, t""")
def q_crc32(spark, sf_dir):
    return sequences(spark, sf_dir).select("header", F.crc32(F.col("seq").cast("binary")).alias("crc32"))


#: Package-merge level by level: leaves and the packages of the level before, sorted, are paired. Codes of equal length count up.
@query("""WITH RECURSIVE c AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch),
leaves AS (SELECT list({'n': CAST(n AS HUGEINT), 's': [ch]}) AS l FROM c),
p AS (SELECT 0 AS step, list_filter(l, lambda x: false) AS packages FROM leaves
  UNION ALL SELECT step + 1, list_transform(range(1, len(r), 2), lambda i: {'n': r[i].n + r[i + 1].n, 's': list_concat(r[i].s, r[i + 1].s)})
  FROM (SELECT step, list_sort(list_concat(l, packages)) AS r FROM p, leaves WHERE step < 15)),
b AS (SELECT ch, count(*) AS bits FROM (SELECT unnest(x.s) AS ch FROM (SELECT unnest(packages[:len(l) - 1]) AS x FROM p, leaves WHERE step = 15)) GROUP BY ch),
f AS (SELECT *, CAST(coalesce(sum(1 << (15 - bits)) OVER (ORDER BY bits, ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead FROM b)
SELECT ch, n, bits, lpad(bin(ahead >> (15 - bits)), CAST(bits AS INT), '0') AS code FROM f JOIN c USING (ch)""")
def q_huffman_lengths(spark, sf_dir):
    return textindex.huffman_codes(textindex.histogram(sequences(spark, sf_dir)))


#: Joining the two smallest weights until one is left: their sums are the bits of the best prefix code.
@query("""WITH RECURSIVE h AS (SELECT list_sort(list(n)) AS l, CAST(0 AS HUGEINT) AS bits FROM (SELECT CAST(count(*) AS HUGEINT) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch)
  UNION ALL SELECT list_sort(list_append(l[3:], l[1] + l[2])), bits + l[1] + l[2] FROM h WHERE len(l) > 1)
SELECT CAST(bits AS BIGINT) AS total_bits, CAST(1 AS DOUBLE) AS kraft FROM h WHERE len(l) = 1""")
def q_huffman_cost(spark, sf_dir):
    codes = textindex.huffman_codes(textindex.histogram(sequences(spark, sf_dir)), most=60)
    return codes.agg(F.sum(F.col("n") * F.col("bits")).alias("total_bits"), F.sum(F.pow(F.lit(2.0), -F.col("bits"))).alias("kraft"))


@query("""SELECT doc_id, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS hash
FROM (SELECT doc_id, list_reduce(list_transform(string_split(source || lang, ''), lambda c: CAST(unicode(c) AS HUGEINT)), lambda a, c: (a * 31 + c) % 18446744073709551616, CAST(1125899906842597 AS HUGEINT)) AS h FROM documents)""")
def q_header_hash(spark, sf_dir):
    ship(spark)
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", textindex.header_hash(F.array("source", "lang")).alias("hash"))


#: The two smallest blocks are joined as long as they fit; blocks are structs of size, longest item and items, sorted.
PACKED = """(WITH RECURSIVE d AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS h, CAST(length(text) AS BIGINT) AS n FROM documents),
p AS (SELECT list_sort(list({'s': n + 1, 'n': -n, 'h': h, 'items': [{'n': -n, 'h': h}]})) AS l, max(n) + 1 AS room FROM d
  UNION ALL SELECT list_sort(list_append(l[3:], {'s': l[1].s + l[2].s, 'n': list_sort([{'n': l[1].n, 'h': l[1].h}, {'n': l[2].n, 'h': l[2].h}])[1].n,
    'h': list_sort([{'n': l[1].n, 'h': l[1].h}, {'n': l[2].n, 'h': l[2].h}])[1].h, 'items': list_concat(l[1].items, l[2].items)})), room FROM p WHERE len(l) > 1 AND l[1].s + l[2].s <= room),
b AS (SELECT unnest(l) AS b FROM (SELECT l FROM p ORDER BY len(l) LIMIT 1)),
o AS (SELECT row_number() OVER (ORDER BY b.n, b.s, b.h) - 1 AS block_id, unnest(list_sort(b.items)) AS i, generate_subscripts(b.items, 1) - 1 AS ord FROM b)
SELECT i.h AS header, -i.n AS seq_len, CAST(block_id AS BIGINT) AS block_id, CAST(ord AS BIGINT) AS ord FROM o)"""


@query(f"SELECT * FROM {PACKED}")
def q_block_pack(spark, sf_dir):
    return blocks.pack_blocks(sequences(spark, sf_dir).withColumn("header", F.col("header").cast("string")))


@query(f"""SELECT block_id, ord, '>' || header || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN length(x) % 50 = 0 AND length(x) > 0 THEN rtrim(regexp_replace(x, '(.{{50}})', '\\1' || chr(10), 'g'), chr(10))
  ELSE regexp_replace(x, '(.{{50}})', '\\1' || chr(10), 'g') END), chr(10)) AS record FROM {PACKED} JOIN documents ON CAST(doc_id AS VARCHAR) = header""")
def q_restore(spark, sf_dir):
    s = sequences(spark, sf_dir).withColumn("header", F.col("header").cast("string"))
    return search.restore(s.join(blocks.pack_blocks(s), ["header", "seq_len"]))


#: MD has m matches, a base and four matches; what it says beyond the read's end is N.
@query(f"""SELECT l_orderkey, ref_id, left(b, m) || 'A' || substring(b, m + 2) AS reference FROM (SELECT l_orderkey, ref_id, m, CASE WHEN length(b) >= m + 5 THEN b ELSE rpad(b, m + 5, 'N') END AS b FROM
  (SELECT l_orderkey, ref_id, CAST(mapq AS INT) AS m, substring(repeat('ACGTTGCA', 8), ref_id + 1 + flag % 3, CAST(regexp_extract(cigar, 'S([0-9]+)M', 1) AS INT)) || repeat('N', CAST(regexp_extract(cigar, 'M([0-9]+)D', 1) AS INT)) AS b FROM {ALN}))""")
def q_reconstruct_ref(spark, sf_dir):
    ship(spark)
    read = F.substring(F.repeat(F.lit("ACGTTGCA"), 8), (F.col("flag") % 3 + 1).cast("int"), F.lit(64))
    return alignments(spark, sf_dir).select("l_orderkey", "ref_id", reconstruct_reference(read, F.col("cigar"), F.concat(F.col("mapq").cast("string"), F.lit("A4"))).alias("reference"))


@query("SELECT page_id AS header, CAST(length(url) AS BIGINT) AS n_bytes, CAST((length(url) - length(replace(url, 'th', ''))) // 2 AS BIGINT) AS n_matches FROM pages")
def q_fm_count(spark, sf_dir):
    fm = fmindex.build_indexes(addresses(spark, sf_dir))
    return fm.select("header", "n_bytes", fmindex.fm_count(F.col("fm"), "th").alias("n_matches"))


@query(f"SELECT header, pos FROM {PLACES.format(key='page_id', size=2, text='url', pattern=chr(39) + 'th' + chr(39), source='pages')} WHERE i < n")
def q_fm_locate(spark, sf_dir):
    fm = fmindex.build_indexes(addresses(spark, sf_dir))
    return fm.select("header", F.explode(fmindex.fm_locate(F.col("fm"), "th")).alias("pos"))


#: The same over whole documents, whose positions count bytes.
DOC_BYTES = PLACES.format(key="doc_id", size=len(PATTERN), text="text", pattern=f"'{PATTERN}'", source="documents").replace("length(part)", "strlen(part)")


def document_indexes(spark, sf_dir) -> DataFrame:
    """Each document's index, stored: building takes longer than any answer."""
    return stored(fmindex.build_indexes(sequences(spark, sf_dir)), "indexes")


@query(f"SELECT doc_id AS header, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST((length(text) - length(replace(text, '{PATTERN}', ''))) // {len(PATTERN)} AS BIGINT) AS n_matches FROM documents")
def q_fm_count_documents(spark, sf_dir):
    return document_indexes(spark, sf_dir).select("header", "n_bytes", fmindex.fm_count(F.col("fm"), PATTERN).alias("n_matches"))


@query(f"SELECT header, pos FROM {DOC_BYTES} WHERE i < n")
def q_fm_locate_documents(spark, sf_dir):
    return document_indexes(spark, sf_dir).select("header", F.explode(fmindex.fm_locate(F.col("fm"), PATTERN)).alias("pos"))


#: Whole texts read back from their transforms alone.
@query("SELECT doc_id AS header, md5(text) AS digest FROM documents")
def q_fm_restore_documents(spark, sf_dir):
    # The package is sent to workers with the indexes, and a function made before that would go without it.
    indexes = document_indexes(spark, sf_dir)
    text = fmindex.fm_extract(F.col("fm"), 0, 1 << 62)
    return indexes.select("header", F.md5(text.cast("binary")).alias("digest"))


# Sources and sinks


@query("SELECT CAST(doc_id AS VARCHAR) AS header, regexp_replace(text, '[\\r\\n]', '', 'g') AS seq, CAST(length(regexp_replace(text, '[\\r\\n]', '', 'g')) AS BIGINT) AS seq_len FROM documents")
def q_fasta_roundtrip(spark, sf_dir):
    register(spark)
    path = shared_dir(spark, "fasta")
    rows = sequences(spark, sf_dir).select(F.col("header").cast("string").alias("header"), dna.strip_line_ends(F.col("seq")).alias("seq"))
    rows.write.format("fasta").option("path", path).option("markers", ">").mode("append").save()
    return spark.read.format("fasta").option("markers", ">").load(path).select("header", "seq", "seq_len")


@query(f"SELECT l_orderkey || '/' || ref_id AS qname, CAST(flag AS INT) AS flag, CAST(ref_id - 1 AS INT) AS ref_id, 'ref' || ref_id AS rname, CAST(pos AS INT) AS pos, CAST(end_pos AS INT) AS end_pos, cigar, CAST(bin AS INT) AS bin, mapq AS nm FROM {ALN_BIN}")
def q_bam_roundtrip(spark, sf_dir):
    register(spark)
    path, a = shared_dir(spark, "bam"), alignments(spark, sf_dir)
    header = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:ref{i}\tLN:536870912\n" for i in range(1, 8))
    i32 = lambda c: c.cast("int")
    rows = a.select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("ref_id").cast("string")).alias("qname"), i32(F.col("flag")).alias("flag"), i32(F.col("ref_id") - 1).alias("ref_id"), i32(F.col("pos")).alias("pos"), i32(F.col("mapq")).alias("mapq"), "cigar", F.create_map(F.lit("NM"), tags.make_tag("C", F.col("mapq"))).alias("tags"))
    rows.write.format("bam").option("path", path).option("header", header).mode("append").save()
    return spark.read.format("bam").load(path).select("qname", "flag", "ref_id", "rname", "pos", "end_pos", "cigar", "bin", tags.int_tag(F.col("tags"), "NM").alias("nm"))


# Windows and streams


@query("SELECT time_bucket(INTERVAL 10 MINUTES, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def q_windowed_events(spark, sf_dir):
    rows = windowed_counts(table(spark, sf_dir, "events"))
    return rows.select("window_start", "event_type", "n", F.round("total", 6).alias("total"))


@query("SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events")
def q_gap_to_previous(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", (F.col("event_id") - F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))).alias("gap"))
