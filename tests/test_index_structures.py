import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.functions.bits import BitReader, BitVector, BitWriter, WaveletTree, inverse
from strandlake.operators.fmindex import FmIndex, build_indexes, fm_count, fm_extract, fm_locate
from strandlake.operators.textindex import canonical_codes, code_lengths


@given(st.lists(st.tuples(st.integers(0, 2**20 - 1), st.integers(1, 20))))
def test_bit_streams(numbers):
    w = BitWriter()
    for n, bits in numbers:
        w.write(n, bits)
    r = BitReader(w.bytes())
    assert [r.read(bits) for _, bits in numbers] == [n & (1 << bits) - 1 for n, bits in numbers]
    r.align()
    assert r.at == 8 * len(w.bytes())


def test_an_18_bit_number():
    w = BitWriter()
    w.write(0b100011110010101010, 18)
    assert w.bytes() == bytes([0b10101010, 0b00111100, 0b10])
    assert BitReader(w.bytes()).peek(30) == 0b100011110010101010


@settings(max_examples=30)
@given(st.lists(st.booleans(), max_size=1500), st.integers(0, 1500))
def test_rank_and_select(bits, at):
    v, at = BitVector(np.array(bits, bool)), min(at, len(bits))
    for bit in (0, 1):
        places = [i for i, b in enumerate(bits) if b == bit]
        assert v.rank(bit, at) == sum(p < at for p in places)
        for k in {1, len(places) // 2, len(places)} - {0}:
            assert v.select(bit, k) == (places[k - 1] if k <= len(places) else -1)
        assert v.select(bit, len(places) + 1) == -1 == v.select(bit, 0)


@settings(max_examples=30)
@given(st.binary(min_size=1, max_size=200), st.integers(0, 200))
def test_wavelet_tree(data, at):
    lengths = code_lengths({chr(b): data.count(b) for b in set(data)})
    tree = WaveletTree(data, {ord(s): c for s, c in canonical_codes(lengths).items()})
    at = min(at, len(data))
    assert bytes(tree.get(i) for i in range(len(data))) == data
    for b in {*data[:3], 7}:
        places = [i for i, x in enumerate(data) if x == b]
        assert tree.rank(b, at) == sum(p < at for p in places)
        assert [tree.select(b, k + 1) for k in range(len(places) + 1)] == [*places, -1]


def test_inverse():
    order = np.random.default_rng(0).permutation(50)
    assert (order[inverse(order)] == np.arange(50)).all()


@settings(max_examples=40)
@given(st.text("ab\0é", max_size=400), st.text("abé\0", min_size=1, max_size=3), st.integers(0, 420), st.integers(0, 420))
def test_full_text_index(text, pattern, begin, end):
    data, sought = text.encode(), pattern.encode()
    index = FmIndex.load(FmIndex.of(data).dump())
    want = [i for i in range(len(data)) if data.startswith(sought, i)]
    assert index.count(sought) == len(want) and index.locate(sought) == want
    assert index.extract(begin, end) == data[begin:end]


def test_index_rows(spark):
    df = spark.createDataFrame([("chr1", "AAAACGTTTTACGT"), ("none", ""), ("null", None)], "header string, seq string")
    fm = build_indexes(df)
    got = {r[0]: tuple(r[1:]) for r in fm.select("header", "n_bytes", fm_count(fm.fm, "AA"), fm_locate(fm.fm, "ACGT"), fm_extract(fm.fm, 2, 6)).collect()}
    assert got == {"chr1": (14, 3, [3, 10], "AACG"), "none": (0, 0, [], "")}


def test_whole_texts_are_read_back_at_once_and_repetitive_ones_are_sorted():
    import random
    import time

    from strandlake.operators.textindex import suffix_order

    rng = random.Random(3)
    texts = [b"", b"a", b"ab" * 40, b"\0\0\0", b"a" * 64, b"the same line\n" * 50, bytes(rng.choices(range(256), k=1000)), bytes(rng.choices(b"ab", k=333))]
    for data in texts:
        assert suffix_order(data).tolist() == sorted(range(len(data)), key=lambda i: data[i:])  # noqa: B023
        index = FmIndex.load(FmIndex.of(data).dump())
        for begin, end in ((0, 1 << 62), (0, 31), (5, 64), (31, 33), (32, 64), (63, 70), (200, 201)):
            assert index.extract(begin, end) == data[begin:end]
    data = b" ".join(rng.choices([b"the", b"corpus", b"of", b"texts", b"line"], k=60_000))
    index, began = FmIndex.of(data), time.process_time()
    # Letter by letter it takes some 5 microseconds a byte.
    assert index.extract(0, len(data)) == data and time.process_time() - began < 0.5
