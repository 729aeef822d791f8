import collections
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.operators import blocks, fmindex, intervals, search, textindex

SEQUENCES = [("chr1", "AAAACGTTTTACGT"), ("chr2", "ACGTN"), ("chr3", "ttacgtA"), ("dup", "GATTACA"), ("dup", "GATTACA"), ("empty", ""), ("null", None)]


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame([(h, s, i, len(s or "")) for i, (h, s) in enumerate(SEQUENCES)], "header string, seq string, file_offset bigint, seq_len bigint")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_counts_overlap(seqs):
    assert rows(search.count_pattern(seqs, "AA")) == [("chr1", 3)]
    assert rows(search.locate_pattern(seqs, "AA")) == [("chr1", 0), ("chr1", 1), ("chr1", 2)]
    assert rows(search.locate_pattern(seqs, "ACGT")) == [("chr1", 3), ("chr1", 10), ("chr2", 0)]


def test_patterns_are_literal(spark):
    df = spark.createDataFrame([("a", "x.y\\Ez.*")], "header string, seq string")
    for p, n in ((".", 2), ("\\E", 1), (".*", 1), ("x.y\\Ez", 1)):
        assert rows(search.count_pattern(df, p)) == [("a", n)]


def test_empty_pattern_and_unknown_header_are_errors(seqs):
    with pytest.raises(ValueError, match="empty"):
        search.count_pattern(seqs, "")
    with pytest.raises(LookupError):
        search.named(seqs, "chr9")
    with pytest.raises(ValueError, match="end"):
        search.extract(seqs, "chr1", 5, 2)


def test_extract(seqs):
    get = lambda *a: search.extract(seqs, *a).first()["bases"]
    assert (get("chr1", 2, 6), get("chr1", 10, 999), get("chr1"), get("chr2", 9, 12)) == ("AACG", "ACGT", "AAAACGTTTTACGT", "")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("AC", max_size=40), min_size=1, max_size=6), st.text("AC", min_size=1, max_size=3), st.integers(1, 9))
def test_search_equals_brute_force(spark, texts, pattern, tile):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "header bigint, seq string")
    want = sorted((i, p) for i, t in enumerate(texts) for p in range(len(t)) if t.startswith(pattern, p))
    assert rows(search.locate_pattern(df, pattern)) == want
    assert rows(search.locate_in_tiles(search.tiles(df, len(pattern), tile), pattern)) == want
    assert rows(search.count_pattern(df, pattern)) == sorted(collections.Counter(i for i, _ in want).items())
    patterns = spark.createDataFrame([(pattern,), ("",), (None,)], "pattern string")
    assert rows(search.seed_join(df, patterns).select("header", "pos")) == want


def test_gff_on_both_strands(spark, seqs):
    queries = spark.createDataFrame([("q1|note a|note b", "ACGU"), ("none", "")], "header string, seq string")
    got = rows(search.gff_search(seqs, queries))
    note = "ID=q1;Note=note a;Note=note b"
    want = [(h, "strandlake", "dna", a, a + 3, "1.000", s, ".", note) for h, a in (("chr1", 4), ("chr1", 11), ("chr2", 1)) for s in "+-"]
    assert got == sorted(want)
    assert "chr2\tstrandlake\tdna\t1\t4\t1.000\t+\t.\t" + note in [r[0] for r in search.gff_lines(search.gff_search(seqs, queries)).collect()]


def test_many_short_and_long_patterns(spark, seqs):
    patterns = spark.createDataFrame([("A",), ("ACGT",), ("AAAACGTTTTACG",), ("CC",)], "pattern string")
    want = sorted((p, h, i) for p in ("A", "ACGT", "AAAACGTTTTACG") for h, s in SEQUENCES for i in range(len(s or "")) if s.startswith(p, i))
    assert rows(search.seed_join(seqs, patterns).select("pattern", "header", "pos")) == want


@pytest.mark.parametrize("packed", [False, True])
def test_thousands_of_patterns(spark, monkeypatch, packed):
    rng = random.Random(4)
    if packed:
        monkeypatch.setattr(search.SeedFilter, "__init__", lambda self, maps: (setattr(self, "bits", 25), setattr(self, "maps", {}))[0])
        maps = {12: np.packbits(np.arange(1 << 25) % 3 == 0, bitorder="little").tobytes()}
        one = search.SeedFilter({})
        one.maps = {k: np.frombuffer(m, np.uint8) for k, m in maps.items()}
        text = "".join(rng.choices("ACGT", k=500))
        want = [i for i, h in enumerate(search._hashes(search._codes(text), 12).tolist()) if h % (1 << 25) % 3 == 0]
        assert one.places(text, 12).tolist() == want and want
        return
    texts = ["".join(rng.choices("ACGT", k=3000)) for _ in range(4)] + ["", None, "AC"]
    sought = sorted({t[i : i + rng.randint(1, 40)] for t in texts[:4] for i in range(0, 2900, 3)} | {"".join(rng.choices("ACGT", k=14)) for _ in range(2000)})
    got = rows(search.seed_join(spark.createDataFrame(list(enumerate(texts)), "header bigint, seq string"), spark.createDataFrame([(p,) for p in sought], "pattern string")).select("header", "pos", "pattern"))
    assert got == sorted((i, at, p) for p in sought for i, t in enumerate(texts) for at in (m.start() for m in re.finditer(f"(?={p})", t or "")))


def test_overlap_of_unmapped_records_and_reversed_regions(spark):
    r = [(i, 0, 4, p, e) for i, (p, e) in enumerate([(5, 0), (70_000_000, 0), (100, 149), (1, 1), (1, 1 << 29)])]
    g = [(j, 0, a, b) for j, (a, b) in enumerate([(-5, 10), (0, 1 << 29), (120, 110), (149, 149), (-9, 80_000_000)])]
    got = rows(intervals.overlap_join(spark.createDataFrame(r, "id int, ref_id int, flag int, pos int, end_pos int"), spark.createDataFrame(g, "region int, region_ref int, begin int, end int")).select("id", "region"))
    assert got == sorted((i, j) for i, _, _, p, e in r for j, _, a, b in g if p < b and e > a)


def test_dedup_and_order(seqs):
    kept = rows(blocks.dedup_sequences(seqs).select("header", "file_offset"))
    assert kept == [("chr1", 0), ("chr2", 1), ("chr3", 2), ("dup", 3), ("empty", 5), ("null", 6)]
    assert [r["header"] for r in blocks.longest_first(blocks.dedup_sequences(seqs)).collect()][:4] == ["chr1", "chr3", "dup", "chr2"]


def test_packing_example():
    assert blocks.merge_smallest([(10, "a"), (3, "b"), (2, "c"), (1, "d")]) == [[(10, "a")], [(3, "b"), (2, "c"), (1, "d")]]
    assert blocks.merge_smallest([]) == []


@given(st.lists(st.tuples(st.integers(0, 300), st.text("ab", max_size=3)), max_size=60))
def test_packing_keeps_all_and_fits(items):
    packed = blocks.merge_smallest(items)
    assert sorted(x for b in packed for x in b) == sorted(set(items))
    if items:
        assert max(sum(n + 1 for n, _ in b) for b in packed) <= max(n for n, _ in items) + 1


def test_restore(spark, seqs):
    placed = seqs.join(blocks.pack_blocks(seqs), ["header", "seq_len"])
    text = [r["record"] for r in search.restore(placed.filter("header = 'chr1'"), 5).collect()]
    assert text == [">chr1\nAAAAC\nGTTTT\nACGT"]


def test_offsets_and_owners(spark, seqs):
    offsets = blocks.cumulative_offsets(seqs.select("header", "seq_len", "file_offset"), "file_offset", parts=3)
    assert [r["text_begin"] for r in offsets.orderBy("file_offset").collect()] == [0, 15, 21, 29, 37, 45, 46]
    places = spark.createDataFrame([(0,), (13,), (14,), (15,), (45,), (99,)], "text_pos bigint")
    assert rows(blocks.owner_of(places, offsets, width=4).select("text_pos", "header", "pos")) == [(0, "chr1", 0), (13, "chr1", 13), (15, "chr2", 0)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(1, 1 << 18), st.integers(1, 50000)), max_size=25), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 1 << 18), st.integers(1, 60000)), max_size=10))
def test_overlap_join_equals_range_join(spark, records, regions):
    r = spark.createDataFrame([(i, a, 0, p, p + n - 1) for i, (a, p, n) in enumerate(records)], "id bigint, ref_id bigint, flag int, pos bigint, end_pos bigint")
    g = spark.createDataFrame([(i, a, b, b + n) for i, (a, b, n) in enumerate(regions)], "region bigint, region_ref bigint, begin bigint, end bigint")
    want = sorted((i, j) for i, (a, p, n) in enumerate(records) for j, (c, b, m) in enumerate(regions) if a == c and p < b + m and p + n - 1 > b)
    assert rows(intervals.overlap_join(r, g).select("id", "region")) == want


def test_overlap_is_strict(spark):
    r = spark.createDataFrame([("a", 0, 0, 100, 149), ("e", 0, 0, 67108860, 67108869)], "q string, ref_id bigint, flag int, pos bigint, end_pos bigint")
    near = lambda a, b: rows(intervals.overlap_join(r, spark.createDataFrame([(0, a, b)], "region_ref bigint, begin bigint, end bigint")).select("q"))
    assert (near(149, 200), near(148, 200), near(67108850, 67108900)) == ([], [("a",)], [("e",)])


def test_chunks_merge(spark):
    c = [(0, 1, 1 << 16, 1 << 16 | 50), (0, 1, 1 << 16 | 60, 1 << 16 | 90), (0, 1, 3 << 16, 3 << 16 | 10)]
    assert rows(intervals.merge_chunks(spark.createDataFrame(c, "ref_id int, bin bigint, chunk_beg bigint, chunk_end bigint")).select("chunk_beg", "chunk_end")) == [(1 << 16, 1 << 16 | 90), (3 << 16, 3 << 16 | 10)]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text("abc", max_size=30), min_size=1, max_size=4))
def test_suffix_array_equals_sorting(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "header bigint, seq string")
    sa = textindex.suffix_array(df)
    want = {i: sorted(range(len(t)), key=lambda p, t=t: t[p:]) for i, t in enumerate(texts)}
    assert rows(sa.select("header", "sa_rank", "pos")) == sorted((i, r, p) for i, order in want.items() for r, p in enumerate(order))
    lcp = {(r[0], r[1]): r[2] for r in textindex.common_prefixes(df).collect()}
    for i, order in want.items():
        for r in range(1, len(order)):
            a, b = texts[i][order[r - 1] :], texts[i][order[r] :]
            assert lcp[i, r] == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_backward_search(spark, seqs):
    known = seqs.filter("header = 'chr1'")
    order = sorted(range(14), key=lambda p: SEQUENCES[0][1][p:])
    ranks = sorted(order.index(p) for p in (3, 10))
    indexes = fmindex.build_indexes(known)
    assert rows(fmindex.backward_search(indexes, "ACGT")) == [("chr1", ranks[0], ranks[1], 2)]
    assert rows(fmindex.backward_search(indexes, "GGG")) == []
    with pytest.raises(ValueError, match="empty"):
        fmindex.backward_search(indexes, "")


@given(st.dictionaries(st.characters(codec="ascii"), st.integers(1, 10**9), min_size=1, max_size=60), st.integers(6, 15))
def test_code_lengths_are_a_prefix_code(counts, most):
    lengths = textindex.code_lengths(counts, most)
    assert set(lengths) == set(counts) and max(lengths.values()) <= most
    assert sum(2.0**-n for n in lengths.values()) <= 1
    codes = sorted(textindex.canonical_codes(lengths).values())
    assert all(not b.startswith(a) for a, b in zip(codes, codes[1:], strict=False))


@given(st.text("abcdé", max_size=60))
def test_codes_round_trip(text):
    codes = textindex.canonical_codes(textindex.code_lengths(collections.Counter(text + "ab")))
    packed = textindex.encode_text(text, codes)
    assert len(packed) == -(-sum(len(codes[c]) for c in text) // 8) and textindex.decode_text(packed, len(text), codes) == text
    if len(text) > 8:
        with pytest.raises(EOFError):
            textindex.decode_text(packed[:-1][:1], len(text), codes)


def test_skewed_codes():
    lengths = textindex.code_lengths({chr(i): i * i + 1 for i in range(256)})
    assert max(lengths.values()) <= 15 and lengths[chr(255)] <= lengths[chr(1)]


def test_header_hash(spark):
    h = 1125899906842597
    for c in "chr1" + "é":
        h = (31 * h + ord(c)) & (1 << 64) - 1
    df = spark.createDataFrame([(["chr1", "é"],), ([],)], "h array<string>")
    assert [r[0] for r in df.select(textindex.header_hash(F.col("h"))).collect()] == [h - (1 << 64) if h >> 63 else h, 1125899906842597]
