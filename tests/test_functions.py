import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions import bins, cigar, dna, flags, sam_header, tags
from strandlake.functions.reconstruct import reconstruct


def values(spark, rows, ddl, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*columns).collect()]


def test_dna(spark):
    got = values(spark, [("ACGTN",), ("acgU",), (None,), ("",)], "s string", dna.reverse_complement(F.col("s")), dna.rna_to_dna(F.col("s")))
    assert got == [("NACGT", "ACGTN"), ("Ugca", "acgT"), (None, None), ("", "")]


def test_attributes_drop_empty_ends(spark):
    got = values(spark, [("q1|note a|note b",), ("q",), ("a||b||",)], "h string", dna.gff_attributes(F.col("h")))
    assert got == [("ID=q1;Note=note a;Note=note b",), ("ID=q",), ("ID=a;Note=;Note=b",)]


def test_wrap_leaves_no_blank_line(spark):
    got = values(spark, [("A" * 100,), ("A" * 51,), ("",)], "s string", dna.wrap(F.col("s")))
    assert got == [("A" * 50 + "\n" + "A" * 50,), ("A" * 50 + "\nA",), ("",)]


def test_base_codes_round_trip(spark):
    got = values(spark, [("=ACMGRSVTWYHKDBN",), ("acgtn",), ("x",)], "s string", dna.bases_of(dna.base_codes(F.col("s"))), F.exists(dna.base_codes(F.col("s")), lambda c: c.isNull()))
    assert [g[0] for g in got[:2]] == ["=ACMGRSVTWYHKDBN", "ACGTN"] and got[2][1]


def test_phred_round_trip(spark):
    got = values(spark, [([0, 40, 93],), ([],)], "q array<bigint>", dna.phred_of(F.col("q")), dna.qualities_of(dna.phred_of(F.col("q"))), dna.quality_is_zero(F.col("q")))
    assert got == [("!I~", [0, 40, 93], False), ("", [], True)]


ALIGNMENTS = [("a", 0, 0, 100, "50M", 149, 4681), ("b", 16, 0, 16380, "5S10M2D3I4M", 16395, 585), ("c", 4, -1, 0, "*", 0, 4680), ("d", 4, 0, 100, "*", 0, 37450), ("e", 1024, 0, 67108860, "10M", 67108869, 0), ("f", 0, 1, 1, "3H4=1X2N6P", 13, 4681)]


def test_alignment_ends_and_bins(spark):
    df = spark.createDataFrame(ALIGNMENTS, "q string, flag int, ref int, pos int, c string, e int, b int").withColumn("ops", cigar.parse_cigar(F.col("c")))
    df = df.withColumn("end", cigar.alignment_end(F.col("flag"), F.col("pos"), F.col("ops")))
    for r in df.select("e", "b", "end", bins.record_bin(F.col("flag"), F.col("ref"), F.col("pos"), F.col("end")).alias("bin"), "c", cigar.format_cigar(F.col("ops")).alias("again")).collect():
        assert (r["end"], r["bin"], r["again"]) == (r["e"], r["b"], r["c"])


def test_cigar_passes_over_other_text(spark):
    got = values(spark, [("5Mx3I",), ("",), ("*",), (None,)], "c string", cigar.cigar_ops(cigar.parse_cigar(F.col("c"))), cigar.cigar_lengths(cigar.parse_cigar(F.col("c"))))
    assert got == [(["M", "I"], [5, 3]), ([], []), (None, None), (None, None)]


def test_flags(spark):
    for name, mask in flags.FLAGS.items():
        f = F.col("f")
        got = values(spark, [(0,), (4095,), (mask,)], "f int", flags.has_flag(f, name), flags.set_flag(f, name), flags.clear_flag(f, name))
        assert got == [(False, mask, 0), (True, 4095, 4095 - mask), (True, mask, 0)]


def test_virtual_offsets(spark):
    v = bins.virtual_offset(F.col("a"), F.col("b"))
    assert values(spark, [(7, 65535), (0, 0)], "a bigint, b int", v, bins.offset_block(v), bins.offset_inside(v)) == [(7 << 16 | 65535, 7, 65535), (0, 0, 0)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1 << 28), st.integers(1, 1 << 20)), min_size=1, max_size=30))
def test_a_records_bin_is_among_the_regions_bins(spark, spans):
    rows = [(a, min(a + n, 1 << 29)) for a, n in spans]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    assert df.filter(~F.array_contains(bins.reg2bins(F.col("a"), F.col("b")), bins.reg2bin(F.col("a"), F.col("b")))).isEmpty()


def test_tags(spark):
    t = F.create_map(F.lit("NM"), tags.make_tag("C", F.lit(200)), F.lit("RG"), tags.make_tag("Z", F.lit("g1")))
    later = tags.set_tag(t, "NM", "i", F.lit(3))
    got = values(spark, [(1,)], "x int", tags.int_tag(t, "NM"), tags.read_group(t), tags.int_tag(later, "NM"), F.map_keys(later), F.size(tags.remove_tag(t, "RG")), tags.get_tag(t, "XX").isNull())
    assert got == [(200, "g1", 3, ["RG", "NM"], 1, True)]
    kinds = tags.tag_types()
    assert len(kinds) == 52 and kinds["NM"] == "i" and kinds["MD"] == "Z" and kinds["CG"] == "B"


HEADER = ["@HD\tVN:1.6\tSO:coordinate", "@CO\tfree text", "@SQ\tSN:chr1\tLN:14\tAN:one,uno\tAH:chr1:5-9\tTP:linear", "@RG\tID:g1\tPL:ILLUMINA\tPI:300", "@PG\tID:p"]


def test_sam_header(spark):
    lines = spark.createDataFrame(list(enumerate(HEADER)), "line_no int, line string")
    parsed = sam_header.parse_header(lines)
    written = [r["line"] for r in sam_header.format_header(parsed).orderBy("rank", "line_no").collect()]
    assert written == [HEADER[0], "@SQ\tSN:chr1\tLN:14\tAH:chr1:5-9\tAN:one,uno\tTP:linear", "@RG\tID:g1\tPL:ILLUMINA\tPI:300", HEADER[4], HEADER[1]]
    assert [tuple(r) for r in sam_header.references(parsed).collect()] == [(0, "chr1", 14)]
    assert [r[0] for r in sam_header.group_ids(parsed).collect()] == ["g1"]
    sq = parsed.filter("type = 'SQ'").select(sam_header.typed_sq(F.col("tags")).alias("s")).first()["s"]
    assert (sq["LN"], sq["AN"], tuple(sq["AH"]), sq["TP"]) == (14, ["one", "uno"], ("chr1", 5, 9), "linear")


@pytest.mark.parametrize("lines", [["@SQ\tSN:a"], ["@HD\tVN:1", "@XX\ty"], ["@HD\tVN:1", "text"]])
def test_bad_headers_are_errors(spark, lines):
    with pytest.raises(Exception, match="header"):
        sam_header.parse_header(spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")).collect()


def test_enums_and_loci(spark):
    ok = values(spark, [("Coordinate",), (None,)], "v string", sam_header.one_of(F.col("v"), sam_header.SORTING))
    assert ok == [("coordinate",), (None,)]
    with pytest.raises(Exception, match="allowed"):
        values(spark, [("illumina",)], "v string", sam_header.one_of(F.col("v"), sam_header.PLATFORMS, exact=True))
    with pytest.raises(Exception, match="locus"):
        values(spark, [("chr1",)], "v string", sam_header.alt_locus(F.col("v")))


@pytest.mark.parametrize(
    ("seq", "ops", "md", "want"),
    [("ACGTACGT", "8M", "3A4", "ACGAACGT"), ("ACGTACGT", "8M", None, "acgtacgt"), ("ACGTACGT", "4M2D4M", "4^GG4", "ACGTGGACGT"), ("ACGT", "*", None, ""), (None, "3M", None, "nnn"), ("TTACG", "2S3M", "3", "ACG"), ("ACGT", "1M1I2M", "3", "AGT"), ("AC", "2=1X", None, "ACN")],
)
def test_reconstruct(seq, ops, md, want):
    assert reconstruct(seq, ops, md) == want
