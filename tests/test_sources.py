import gzip
import io
import random
import struct

import pytest
from pyspark.sql import functions as F

from strandlake import cli
from strandlake.operators import intervals
from strandlake.operators.fmindex import fm_count
from strandlake.sources import bam, bgzf, fasta, register, sniff
from strandlake.streaming.landing import landing_counts, landing_sequences, windowed_counts

FASTA = b"\n>chr1 desc\r\nAAAACGT\r\n\r\nTTTACGT\r\n>chr2\nACGTN\n>none\n>last\nAC"
FASTQ = b"@r1\nACGU\n+r1\n@>+!\n@r2\nGG\n+\n!!\n"
WANT = [("chr1 desc", "AAAACGTTTTACGT", 14, True), ("chr2", "ACGTN", 5, False), ("none", "", 0, False), ("last", "AC", 2, False)]


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    register(spark)


def load(spark, path, form="fasta", **options):
    df = spark.read.format(form).options(**options).load(str(path))
    return [tuple(r) for r in df.orderBy("source_file", "file_offset").select("header", "seq", "seq_len", "multiline").collect()]


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(FASTA)
    assert load(spark, tmp_path / "a.fa") == WANT
    for split in (1, 3, 7, 20):
        assert load(spark, tmp_path / "a.fa", split=split) == WANT
    with gzip.open(tmp_path / "b.fa.gz", "wb") as f:
        f.write(FASTA[:20])
    with open(tmp_path / "b.fa.gz", "ab") as f:
        f.write(gzip.compress(FASTA[20:]))
    assert load(spark, tmp_path / "b.fa.gz") == WANT
    assert load(spark, tmp_path / "*.fa") == WANT
    assert [r[1:3] for r in load(spark, tmp_path / "a.fa", lazy="true")] == [(None, 14), (None, 5), (None, 0), (None, 2)]
    at = FASTA.index(b">chr2")
    assert load(spark, tmp_path / "a.fa", offset=at) == WANT[1:]


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fq").write_bytes(FASTQ)
    df = spark.read.format("fastq").load(str(tmp_path / "a.fq")).orderBy("file_offset")
    assert [tuple(r) for r in df.select("header", "seq", "quality").collect()] == [("r1", "ACGU", "@>+!"), ("r2", "GG", "!!")]


def test_long_lines_cross_reads():
    data = b">a\n" + b"ACGT" * 700_000 + b"\n>b\nA\n"
    assert [(r[0], r[2]) for r in fasta.parse(data)] == [("a", 2_800_000), ("b", 1)]


def test_one_long_line_takes_time_with_its_length():
    import time

    def took(n):
        data = b">a\n" + b"ACGT" * (n << 18) + b"\n"
        began = time.perf_counter()
        assert next(iter(fasta.parse(data)))[2] == n << 20
        return time.perf_counter() - began

    took(4)
    assert took(96) < 40 * took(8) + 1


def fastq_text(rng, n):
    rows = []
    for i in range(n):
        size = rng.randint(1, 90)
        rows.append(f"@r{i}\n{''.join(rng.choices('ACGT', k=size))}\n+\n{''.join(rng.choices('@+>!I', k=size))}\n")
    return "".join(rows).encode()


@pytest.mark.parametrize("kind", ["fasta", "fastq"])
def test_blocked_files_are_split(spark, tmp_path, kind):
    rng = random.Random(5)
    text = fastq_text(rng, 4000) if kind == "fastq" else "".join(f">s{i}\n" + "".join(rng.choices("ACGT", k=200_000 if i % 40 == 7 else rng.randint(0, 3000))) + "\n" for i in range(200)).encode()
    with open(tmp_path / "a.gz", "wb") as f:
        w = bgzf.BlockWriter(f)
        w.write(text[:100_000])
        w.close()
        w = bgzf.BlockWriter(f)
        w.write(text[100_000:])
        w.close()
    (tmp_path / "plain").write_bytes(text)
    for name in ("a.gz", "plain"):
        df = lambda **o: spark.read.format("fasta").options(four_lines=str(kind == "fastq").lower(), **o).load(str(tmp_path / name))  # noqa: B023, E731
        want = [tuple(r) for r in df().orderBy("file_offset").select("header", "seq", "quality", "file_offset").collect()]
        assert [r[:3] for r in want] == [(r[0], r[1], r[4]) for r in fasta.parse(text)]
        for split in (1 << 14, 50_000, 1 << 17):
            got = df(split=split)
            assert got.rdd.getNumPartitions() > 1
            assert sorted(tuple(r) for r in got.select("header", "seq", "quality", "file_offset").collect()) == sorted(want)
        assert sorted(tuple(r) for r in df(split=50_000, offset=want[120][3]).select("header", "seq", "quality", "file_offset").collect()) == sorted(want[120:])


def test_block_at(tmp_path):
    out = io.BytesIO()
    w = bgzf.BlockWriter(out)
    w.write(bytes(random.Random(3).choices(b"\x1f\x8b\x08\x04BC", k=400_000)))
    w.close()
    raw = out.getvalue()
    starts = [*bgzf.block_starts(io.BytesIO(raw), len(raw)), len(raw)]
    for at in [0, 1, *(s + d for s in starts for d in (-1, 0, 1, 7) if 0 <= s + d <= len(raw))]:
        assert bgzf.block_at(io.BytesIO(raw), len(raw), at) == next(s for s in starts if s >= at)


@pytest.mark.parametrize("zipped", ["false", "true"])
def test_fasta_write(spark, tmp_path, zipped):
    df = spark.createDataFrame([(f"s{i}", "ACGT" * i) for i in range(30)], "header string, seq string").repartition(3)
    df.write.format("fasta").option("width", "7").option("gzip", zipped).mode("append").save(str(tmp_path / "out"))
    assert sorted(r[:2] for r in load(spark, tmp_path / "out")) == sorted((f"s{i}", "ACGT" * i) for i in range(30))


def test_rows_are_written_as_they_were_read(spark, tmp_path):
    df = spark.createDataFrame([("one", "ACGT" * 30, False), ("many", "ACGT" * 30, True)], "header string, seq string, multiline boolean").coalesce(1)
    df.write.format("fasta").mode("append").save(str(tmp_path / "a"))
    assert [r[0::3] for r in load(spark, tmp_path / "a")] == [("one", False), ("many", True)]
    df.write.format("fasta").option("width", "60").mode("append").save(str(tmp_path / "b"))
    assert [r[0::3] for r in load(spark, tmp_path / "b")] == [("one", True), ("many", True)]


def test_a_second_write_keeps_the_first(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([(f"s{i}", "ACGT")], "header string, seq string").coalesce(1).write.format("fasta").mode("append").save(str(tmp_path / "a"))
        spark.createDataFrame([(f"q{i}", 4, -1)], "qname string, flag int, ref_id int").coalesce(1).write.format("bam").mode("append").save(str(tmp_path / "b"))
    assert sorted(r[0] for r in load(spark, tmp_path / "a")) == ["s0", "s1"]
    assert sorted(r["qname"] for r in spark.read.format("bam").load(str(tmp_path / "b")).collect()) == ["q0", "q1"]


def test_no_line_begins_as_a_record():
    assert list(fasta.wrapped("ab@>+cdef@", 2)) == ["ab@>+", "cd", "ef@"]
    with pytest.raises(ValueError, match="begin"):
        list(fasta.wrapped("@x", 2))


def test_gzip_members():
    out = io.BytesIO()
    writer = bgzf.BlockWriter(out)
    data = bytes(i * i % 251 for i in range(200_000))
    writer.write(data)
    writer.close()
    raw = out.getvalue()
    assert gzip.decompress(raw) == data and raw.endswith(bgzf.END_BLOCK)
    starts = list(bgzf.block_starts(io.BytesIO(raw), len(raw)))
    assert len(starts) == 5
    reader = bgzf.MemberReader(io.BytesIO(raw), len(raw), starts[1] << 16 | 10)
    assert reader.read(100) == data[bgzf.BLOCK_BYTES + 10 :][:100]
    named = io.BytesIO()
    with gzip.GzipFile("x.txt", "wb", fileobj=named, mtime=5) as f:
        f.write(b"hi")
    told = bgzf.parse_member_header(named.getvalue())
    assert (told["file_name"], told["mtime"], told["block_size"]) == ("x.txt", 5, None)
    with pytest.raises(ValueError, match="gzip"):
        bgzf.parse_member_header(b"plain text here")
    spoiled = raw[:100] + bytes([raw[100] ^ 255]) + raw[101:]
    with pytest.raises(Exception, match="Error|invalid|incorrect"):
        bgzf.MemberReader(io.BytesIO(spoiled), len(spoiled)).read(len(data))


HEADER = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:1000000\n@SQ\tSN:chr2\tLN:500\n"
TAGS = "map(cast('NM' as string), named_struct('type','C','i',200L,'f',cast(null as float),'s',cast(null as string),'ia',cast(null as array<bigint>),'fa',cast(null as array<float>)), 'MD', named_struct('type','Z','i',cast(null as bigint),'f',cast(null as float),'s','8','ia',cast(null as array<bigint>),'fa',cast(null as array<float>)), 'FZ', named_struct('type','BS','i',cast(null as bigint),'f',cast(null as float),'s',cast(null as string),'ia',array(65535L, 1L),'fa',cast(null as array<float>)))"


@pytest.fixture(scope="module")
def bam_file(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bam")
    n = 3000
    rows = [(f"q{i:05d}", 0 if i % 10 else 16, 0, 1 + i * 300, 30, "4M1I3M", -1, 0, 0, "ACGTACGT", "IIIIIIII") for i in range(n)]
    rows += [("un", 4, -1, 0, 0, "*", -1, 0, 0, "ACG", None), ("placed", 4, 1, 100, 255, "*", 0, 7, -5, None, None)]
    df = spark.createDataFrame(rows, "qname string, flag int, ref_id int, pos int, mapq int, cigar string, next_ref_id int, next_pos int, tlen int, seq string, qual string").withColumn("tags", F.expr(TAGS))
    df.coalesce(1).write.format("bam").option("header", HEADER).mode("append").save(str(folder))
    return str(next(folder.glob("*.bam")))


def test_bam_round_trip(spark, bam_file):
    df = spark.read.format("bam").load(bam_file)
    assert df.count() == 3002
    r = df.filter("qname = 'q00010'").first()
    assert (r["flag"], r["rname"], r["pos"], r["end_pos"], r["mapq"], r["cigar"], r["seq"], r["qual"], r["bin"]) == (16, "chr1", 3001, 3007, 30, "4M1I3M", "ACGTACGT", "IIIIIIII", 4681)
    assert (r["tags"]["NM"]["i"], r["tags"]["MD"]["s"], r["tags"]["FZ"]["ia"]) == (200, "8", [65535, 1])
    p = df.filter("qname = 'placed'").first()
    assert (p["rname"], p["rname_next"], p["next_pos"], p["tlen"], p["mapq"], p["seq"], p["qual"], p["bin"]) == ("chr2", "chr1", 7, -5, 255, None, None, 37450)
    assert [tuple(x) for x in spark.read.format("bam").option("part", "refs").load(bam_file).orderBy("ref_id").collect()] == [(0, "chr1", 1000000), (1, "chr2", 500)]
    assert [x["line"] for x in spark.read.format("bam").option("part", "header").load(bam_file).orderBy("line_no").collect()] == HEADER.strip().split("\n")


def test_index_finds_the_same_records(spark, bam_file, tmp_path):
    import shutil

    plain = spark.read.format("bam").load(bam_file).cache()
    copy = str(tmp_path / "x.bam")
    shutil.copy(bam_file, copy)
    refs = spark.read.format("bam").option("part", "refs").load(bam_file)
    chunks, linear, totals = intervals.build_index(plain.withColumn("ref_id", F.col("ref_id").cast("int")), refs)
    assert tuple(totals.select("unplaced").first()) == (1,)
    bam.write_index(copy + ".bai", 2, chunks, linear, totals)
    told = spark.read.format("bai").load(copy + ".bai")
    assert {tuple(r) for r in told.select("ref_id", "bin", "chunk_beg", "chunk_end").collect()} == {tuple(r) for r in chunks.select("ref_id", "bin", "chunk_beg", "chunk_end").collect()}
    first = spark.read.format("bai").option("part", "linear").load(copy + ".bai").filter("ref_id = 0 and win = 0").first()
    assert first["voffset"] == plain.agg(F.min("voffset")).first()[0]
    indexed = spark.read.format("bam").load(copy)
    assert indexed.count() == 3002
    where = "ref_id = 0 and pos < 450000 and end_pos > 440000"
    want = {r[0] for r in plain.filter(where).select("qname").collect()}
    assert len(want) > 30 and {r[0] for r in indexed.filter(where).select("qname").collect()} == want
    assert {r[0] for r in indexed.filter("ref_id = 1").select("qname").collect()} == {"placed"}
    with open(copy + ".bai", "rb") as f:
        raw = f.read()
    assert bam.read_index(raw)["unplaced"] == 1 and struct.unpack("<Q", raw[-8:])[0] == 1


@pytest.mark.parametrize("long", [False, True])
def test_files_without_an_index_are_split(spark, tmp_path, long):
    rng = random.Random(2)
    n = 3000
    rows = [(f"q{i:05d}", 0, 0, 1 + i * 300, 30, "*", -1, 0, 0, s := "".join(rng.choices("ACGT", k=90_000 if long and i % 50 == 3 else rng.randint(0, 300))), None if i % 3 else "I" * len(s)) for i in range(n)]
    df = spark.createDataFrame(rows, "qname string, flag int, ref_id int, pos int, mapq int, cigar string, next_ref_id int, next_pos int, tlen int, seq string, qual string").withColumn("tags", F.expr(TAGS))
    df.coalesce(1).write.format("bam").option("header", HEADER).mode("append").save(str(tmp_path))
    path = str(next(tmp_path.glob("*.bam")))
    want = [tuple(r) for r in spark.read.format("bam").option("split", 0).load(path).orderBy("qname").select("qname", "seq", "qual", "voffset", "voffset_end", "tags.MD.s").collect()]
    assert [r[0] for r in want] == [r[0] for r in rows]
    for split in (9_000, 20_000, 70_000):
        got = spark.read.format("bam").option("split", split).load(path)
        assert got.rdd.getNumPartitions() > 2
        assert [tuple(r) for r in got.orderBy("qname").select("qname", "seq", "qual", "voffset", "voffset_end", "tags.MD.s").collect()] == want


def test_a_missing_index_is_built(spark, bam_file, tmp_path):
    import shutil

    copy, where = str(tmp_path / "y.bam"), "ref_id = 0 and pos < 450000 and end_pos > 440000"
    shutil.copy(bam_file, copy)
    want = sorted(r[0] for r in spark.read.format("bam").load(copy).filter(where).select("qname").collect())
    assert sorted(r[0] for r in bam.indexed(spark, copy).filter(where).select("qname").collect()) == want
    assert not (tmp_path / "z.bai").exists()
    assert sorted(r[0] for r in bam.indexed(spark, copy, str(tmp_path / "z.bai")).filter(where).select("qname").collect()) == want
    assert sniff(str(tmp_path / "z.bai")) == "bai"
    assert sorted(r[0] for r in bam.indexed(spark, copy, str(tmp_path / "z.bai")).filter(where).select("qname").collect()) == want


def test_lazy_alignments_and_sniffing(spark, bam_file, tmp_path):
    r = spark.read.format("bam").option("lazy", "true").load(bam_file).filter("qname = 'q00010'").first()
    assert (r["pos"], r["end_pos"], r["cigar"], r["seq"], r["qual"], r["tags"]) == (3001, 3007, "4M1I3M", None, None, None)
    for name, data, kind in (("a", b"\n>x\nA\n", "fasta"), ("b", b"@x\nA\n+\n!\n", "fastq"), ("c", gzip.compress(b">x"), "gzip"), ("d", b"BAI\x01", "bai"), ("e", b"", "unknown")):
        (tmp_path / name).write_bytes(data)
        assert sniff(str(tmp_path / name)) == kind
    assert sniff(bam_file) == "bam" and sniff(str(tmp_path)) == "unknown"
    with pytest.raises(FileNotFoundError):
        sniff(str(tmp_path / "none"))


def test_tags_of_every_type():
    raw = b"NMC" + bytes([200]) + b"ASi" + struct.pack("<i", -5) + b"XSs" + struct.pack("<h", -3) + b"MDZ8\0" + b"XAAx" + b"XFf" + struct.pack("<f", 1.5) + b"XHH1AE3\0" + b"CGBI" + struct.pack("<iII", 2, 1, 2) + b"FZBS" + struct.pack("<iH", 1, 65535) + b"XBBf" + struct.pack("<if", 1, 0.5) + b"XLI" + struct.pack("<I", 1 << 31)
    got = bam.decode_tags(raw)
    assert [got[k]["i"] for k in ("NM", "AS", "XS", "XL")] == [200, -5, -3, 1 << 31]
    assert (got["MD"]["s"], got["XA"]["s"], got["XF"]["f"], got["XH"]["s"], got["CG"]["ia"], got["FZ"]["ia"], got["XB"]["fa"]) == ("8", "x", 1.5, "1AE3", [1, 2], [65535], [0.5])
    assert bam.encode_tags(got) == raw


def test_damaged_files_are_errors(spark, tmp_path, bam_file):
    with open(bam_file, "rb") as f:
        raw = f.read()
    (tmp_path / "cut.bam").write_bytes(raw[: len(raw) // 2])
    with pytest.raises(Exception, match="cut short|EOF"):
        spark.read.format("bam").load(str(tmp_path / "cut.bam")).count()
    (tmp_path / "text.bam").write_bytes(gzip.compress(b"hello world"))
    with pytest.raises(Exception, match="not a BAM"):
        spark.read.format("bam").load(str(tmp_path / "text.bam")).count()


def test_command_line(spark, tmp_path):
    fa, store, out = tmp_path / "a.fa", str(tmp_path / "store"), io.StringIO()
    fa.write_bytes(b">chr1\nAAAACGTTTTACGT\n>chr2\nACGTN\n>dup\nGATTACA\n>dup\nGATTACA\n")
    cli.run(spark, cli.arguments(["-i", str(fa), "-o", store, "-idx", str(tmp_path / "fm")]))
    fm = spark.read.parquet(str(tmp_path / "fm"))
    assert sorted(tuple(r) for r in fm.select("header", fm_count(fm.fm, "ACGT")).collect()) == [("chr1", 2), ("chr2", 1), ("dup", 0)]
    cli.run(spark, cli.arguments(["-i", store, "-c", "ACGT"]), out)
    assert out.getvalue().splitlines() == [">chr1 found : 2", ">chr2 found : 1"]
    cli.run(spark, cli.arguments(["-i", store, "-s", "chr1", "AA"]), out := io.StringIO())
    assert out.getvalue().split() == [">chr1", "found", ":", "3", "0", "1", "2"]
    (tmp_path / "q.fa").write_text(">q|n\nACGU\n")
    cli.run(spark, cli.arguments(["-i", store, "-s", str(tmp_path / "q.fa")]), out := io.StringIO())
    assert len(out.getvalue().splitlines()) == 6
    cli.run(spark, cli.arguments(["-i", store, "-o", str(tmp_path / "seq"), "chr1", "2", "6"]))
    assert [r[0] for r in spark.read.text(str(tmp_path / "seq")).collect()] == ["AACG"]
    cli.run(spark, cli.arguments(["-i", store, "-o", str(tmp_path / "fasta")]))
    assert [r[0] for r in sorted(spark.read.text(str(tmp_path / "fasta")).collect())] == sorted([">chr1", "AAAACGTTTTACGT", ">dup", "GATTACA", ">chr2", "ACGTN"])
    for path in ([], ["-idx", str(tmp_path / "fm")]):
        cli.run(spark, cli.arguments(["-i", store, "-c", "AC", *path]), out := io.StringIO())
        assert out.getvalue().splitlines() == [">chr1 found : 2", ">dup found : 1", ">chr2 found : 1"]
        cli.run(spark, cli.arguments(["-i", store, "-s", "AC", *path]), out := io.StringIO())
        assert out.getvalue().split("\n")[:3] == [">chr1 found : 2", "3", "10"]
    with pytest.raises(SystemExit):
        cli.arguments(["-i", "x", "-c", "a", "b", "c"])


def test_command_line_keeps_records_of_one_header_apart(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">x\nACGT\n>x\nACACAC\n>y\nAC\n")
    store = str(tmp_path / "store")
    cli.run(spark, cli.arguments(["-i", str(tmp_path / "a.fa"), "-o", store, "-idx", str(tmp_path / "fm")]))
    for extra in (["-i", str(tmp_path / "a.fa")], ["-i", store], ["-i", store, "-idx", str(tmp_path / "fm")]):
        cli.run(spark, cli.arguments([*extra, "-c", "AC"]), out := io.StringIO())
        assert sorted(out.getvalue().splitlines()) == [">x found : 1", ">x found : 3", ">y found : 1"]
        cli.run(spark, cli.arguments([*extra, "-s", "x", "AC"]), out := io.StringIO())
        assert sorted(out.getvalue().split("\n")) == sorted([">x found : 1", "0", ">x found : 3", "0", "2", "4", ""])


def run_stream(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_landing_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fa").write_bytes(b"text before\n>chr1\r\nAAAACGT\r\nTTTACGT\r\n>none\n")
    (tmp_path / "in/b.fa").write_bytes(b">chr2\nACGTN\n")
    got = run_stream(spark, landing_sequences(spark, str(tmp_path / "in")).select("header", "seq", "seq_len", "multiline"), "landed")
    assert got == [("chr1", "AAAACGTTTTACGT", 14, True), ("chr2", "ACGTN", 5, False), ("none", "", 0, False)]
    assert run_stream(spark, landing_counts(spark, str(tmp_path / "in"), "ACGT").select("header", "n_matches"), "counted") == [("chr1", 2), ("chr2", 1)]


def test_windows_on_a_stream(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "events"))
    got = run_stream(spark, windowed_counts(stream).select("window_start", "event_type", "n"), "windowed")
    want = sorted(tuple(r) for r in windowed_counts(batch).select("window_start", "event_type", "n").collect())
    assert got and set(got) <= set(want)
