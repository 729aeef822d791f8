"""Alignments in batches: the same bytes and rows as record by record, and one file from many tasks."""

import random
import struct

import pyarrow as pa
from pyspark.sql import functions as F

from strandlake.functions import tags
from strandlake.session import batches_of
from strandlake.sources import bam, bam_batches, register
from strandlake.sources.files import list_files

HEADER = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:536870912\n@SQ\tSN:chr2\tLN:500\n"


def tag(kind, **held):
    return dict.fromkeys(("i", "f", "s", "ia", "fa")) | {"type": kind} | held


def odd_rows():
    rng = random.Random(5)
    every = {"NM": tag("C", i=200), "AS": tag("i", i=-5), "XS": tag("s", i=-3), "XL": tag("I", i=1 << 31), "MD": tag("Z", s="8A"), "XE": tag("Z", s=""), "XA": tag("A", s="x"), "XF": tag("f", f=1.5), "XH": tag("H", s="1AE3"), "CG": tag("BI", ia=[1, 2]), "FZ": tag("BS", ia=[65535]), "XB": tag("Bf", fa=[0.5, 2.0]), "XN": tag("Bc", ia=[])}
    for i in range(300):
        n = rng.choice((0, 1, 2, 7, 100))
        seq = "".join(rng.choices("ACGTNacgt=x", k=n)) or rng.choice((None, ""))
        some = dict(rng.sample(sorted(every.items()), rng.randint(0, len(every))))
        yield {"qname": rng.choice((None, "", f"q{i}")), "flag": rng.choice((None, 0, 4, 16)), "ref_id": rng.choice((None, -1, 0, 1)), "pos": rng.choice((None, 1, 16384, 200_000_000)), "mapq": rng.choice((None, 60, 255)), "cigar": rng.choice((None, "*", "", "5M", "3S70M2D1N", "x1M?")), "next_ref_id": None, "next_pos": 7, "tlen": -9, "seq": seq, "qual": "I" * n if n and i % 2 else None, "tags": rng.choice((None, some))}


SCHEMA = pa.schema([("qname", pa.string()), *[(k, pa.int32()) for k in ("flag", "ref_id", "pos", "mapq")], ("cigar", pa.string()), *[(k, pa.int32()) for k in ("next_ref_id", "next_pos", "tlen")], ("seq", pa.string()), ("qual", pa.string()), ("tags", pa.map_(pa.string(), bam_batches.TAG))])


def batch_of(rows):
    return pa.RecordBatch.from_pylist([r | {"tags": list(r["tags"].items()) if r["tags"] else r["tags"]} for r in rows], SCHEMA)


def test_batches_have_the_bytes_of_single_records():
    rows = list(odd_rows())
    want = b"".join(bam.encode_record(r) for r in rows)
    assert b"".join(bam_batches.encode(batch_of(rows))) == want
    assert b"".join(bam_batches.encode(batch_of(rows).slice(7, 100))) == b"".join(bam.encode_record(r) for r in rows[7:107])
    # What numpy can't hold goes record by record.
    beyond = [rows[0] | {"qname": "é", "tags": {"CO": tag("Z", s="ü")}}]
    assert b"".join(bam_batches.encode(batch_of(beyond))) == bam.encode_record(beyond[0])


def test_tags_of_many_records_are_those_of_each():
    import numpy as np

    raws = [bam.encode_tags(r["tags"]) for r in odd_rows()] + [b"NMC\x01NMC\x02", b"COZ\xe9\0", b"XYBi" + struct.pack("<i", 0), b"ab"]
    for some in (raws[:300], raws):
        ends = np.cumsum([len(r) for r in some])
        got = bam_batches.decode_tags(np.frombuffer(b"".join(some), np.uint8), ends - [len(r) for r in some], ends).to_pylist()
        assert [dict(x) for x in got] == [bam.decode_tags(r) for r in some]


def test_tasks_write_one_file_in_order(spark, tmp_path):
    register(spark)
    rows = spark.range(5000).select(F.concat(F.lit("q"), "id").alias("qname"), F.lit(0).alias("flag"), F.lit(0).alias("ref_id"), (F.col("id") * 7 % 5000 + 1).cast("int").alias("pos"), F.lit("5M").alias("cigar"))
    rows.repartitionByRange(4, "pos").sortWithinPartitions("pos").write.format("bam").options(header=HEADER, single="true").mode("append").save(str(tmp_path / "one"))
    assert [p.name[-4:] for p in (tmp_path / "one").iterdir()] == [".bam"]
    path = list_files(str(tmp_path / "one"))[0][0]
    got = spark.read.format("bam").option("split", 0).load(path).orderBy("voffset").select("pos").collect()
    assert [r[0] for r in got] == list(range(1, 5001))
    # Small parts share tasks; each is still found by itself.
    split = spark.read.format("bam").options(split=20, lazy="true").load(path)
    assert 1 < split.rdd.getNumPartitions() <= bam.TASKS * 2 < list_files(path)[0][1] / 20
    assert sorted(r[0] for r in split.select("pos").collect()) == list(range(1, 5001))
    rows.limit(0).write.format("bam").options(header=HEADER, single="true").mode("append").save(str(tmp_path / "none"))
    assert spark.read.format("bam").load(str(tmp_path / "none")).count() == 0


def test_batches_of_tags_are_bounded_by_rows(spark, tmp_path):
    register(spark)
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    made = F.create_map(F.lit("NM"), tags.make_tag("C", F.col("id") % 200), F.lit("RG"), tags.make_tag("Z", F.lit("g")))
    rows = spark.range(50).select(F.col("id").cast("string").alias("qname"), F.lit(4).alias("flag"), made.alias("tags"))
    with batches_of(spark, 10):
        rows.write.format("bam").options(header=HEADER).mode("append").save(str(tmp_path / "tags"))
        assert rows.mapInArrow(lambda it: (b.select([0]).slice(0, 1) for b in it), "qname string").count() >= 5
    assert spark.conf.get(key) == before
    got = spark.read.format("bam").load(str(tmp_path / "tags")).select("qname", tags.int_tag(F.col("tags"), "NM"), tags.read_group(F.col("tags"))).collect()
    assert sorted(map(tuple, got)) == sorted((str(i), i, "g") for i in range(50))


def test_queries_write_records_in_large_batches(spark, tmp_path, monkeypatch):
    from strandlake.plans import round_trips

    asked = []
    monkeypatch.setattr(round_trips, "batches_of", lambda spark, rows: asked.append(rows) or batches_of(spark, rows))
    lines = spark.range(30).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") + 190).alias("l_suppkey"), F.col("id").alias("l_partkey"), F.lit("R").alias("l_returnflag"), F.lit(2.5).alias("l_quantity"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = round_trips.q_tags_roundtrip(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((f"{i}/1", (i + 190) % 200, -i, "g1", "R", 2.5, f"{(i + 190) % 7},65535") for i in range(30))
    assert asked == [round_trips.BATCH] and round_trips.BATCH >= 10_000


def test_an_index_of_many_bins_is_made_in_linear_time():
    import time

    bins = [(ref, 4681 + b, (ref << 40) + b, (ref << 40) + b + 1) for ref in range(4) for b in range(25_000)]
    linear = [(ref, w, (ref << 40) + w) for ref in range(4) for w in range(25_000)]
    began = time.process_time()
    data = bam.index_bytes(4, bins, linear, 3)
    assert time.process_time() - began < 5
    told = bam.read_index(data)
    assert sorted((r, b, *c) for (r, b), (c,) in told["bins"].items()) == bins and told["unplaced"] == 3
    assert [(r, w, at) for r, offsets in told["linear"].items() for w, at in enumerate(offsets)] == linear


def test_an_index_is_made_of_stored_places(spark, tmp_path):
    register(spark)
    rows = spark.range(3000).select(F.concat(F.lit("q"), "id").alias("qname"), F.when(F.col("id") % 5 == 0, 4).otherwise(0).alias("flag"), F.lit(0).alias("ref_id"), (F.col("id") * 90 + 1).cast("int").alias("pos"), F.lit("50M").alias("cigar"))
    rows.orderBy("pos").write.format("bam").options(header=HEADER, single="true").mode("append").save(str(tmp_path / "x"))
    path = list_files(str(tmp_path / "x"))[0][0]
    bam.make_index(spark, path, path + ".bai")
    with open(path + ".bai", "rb") as f:
        told = bam.read_index(f.read())
    assert told["bins"][0, bam.UNMAPPED_BIN][1] == (2400, 600) and told["n_ref"] == 2
    got = spark.read.format("bam").load(path).filter("ref_id = 0 and pos < 9000 and end_pos > 4000").select("qname").collect()
    assert sorted(r[0] for r in got) == sorted(f"q{i}" for i in range(3000) if i % 5 and i * 90 + 1 < 9000 and i * 90 + 50 > 4000)


def test_an_index_of_merged_runs_is_that_of_all_records(spark, tmp_path, monkeypatch):
    from strandlake.operators import intervals

    register(spark)
    mixed = F.col("id") * 7919 % 20_000
    rows = spark.range(20_000).select(
        F.concat(F.lit("q"), "id").alias("qname"),
        F.when(F.col("id") % 11 == 0, 4).otherwise(16).alias("flag"),
        F.when(F.col("id") < 400, -1).otherwise((F.col("id") % 2).cast("int")).alias("ref_id"),
        F.when(F.col("id") % 3 == 0, mixed * 900 + 1).otherwise(F.col("id") * 5 + 1).cast("int").alias("pos"),
        F.when(F.col("id") % 500 == 1, "9M300000N9M").when(F.col("id") % 13 == 0, "*").otherwise("50M").alias("cigar"),
    )
    rows.write.format("bam").options(header=HEADER, single="true").mode("append").save(str(tmp_path / "x"))
    path = list_files(str(tmp_path / "x"))[0][0]
    records, refs = spark.read.format("bam").option("lazy", "true").load(path), spark.read.format("bam").option("part", "refs").load(path)
    want = [sorted(map(tuple, df.collect())) for df in intervals.build_index(records, refs)]
    for split in (20_000, 0):
        parts = spark.read.format("bam").options(part="index", split=split).load(path)
        got = intervals.join_index(parts)
        assert [sorted(map(tuple, df.select(*names).collect())) for df, names in zip(got, (["ref_id", "bin", "chunk_beg", "chunk_end"], ["ref_id", "win", "voffset"], ["unplaced", "last_mapped"]))] == want
    # Windows are listed piece by piece.
    with open(path, "rb") as f:
        from strandlake.sources.bgzf import MemberReader

        stream = MemberReader(f, list_files(path)[0][1])
        bam.read_header(stream)
        runs = list(bam_batches.Runs(stream, None))
    least = lambda: sorted({(r, w): v for run in reversed(runs) for b in reversed(list(bam_batches.index_parts(*run, 2))) for k, r, w, v, _ in zip(*b.to_pydict().values()) if k == "win"}.items())
    whole = least()
    monkeypatch.setattr(bam_batches, "WINDOWS", 50)
    assert least() == whole == [((r, w), v) for r, w, v in want[1]]


def test_an_index_is_made_from_few_rows(spark, tmp_path):
    register(spark)
    rows = spark.range(30_000).select(F.lit("q").alias("qname"), F.lit(0).alias("flag"), F.lit(0).alias("ref_id"), (F.col("id") + 1).cast("int").alias("pos"), F.lit("50M").alias("cigar"))
    rows.coalesce(1).write.format("bam").options(header=HEADER, single="true").mode("append").save(str(tmp_path / "x"))
    assert spark.read.format("bam").option("part", "index").load(str(tmp_path / "x")).count() < 100


def test_tags_are_written_from_and_read_as_typed_columns(spark, tmp_path):
    register(spark)
    some = lambda n, value: F.when(F.col("id") % n > 0, value)
    made = {"NM:C": some(2, F.col("id") % 200), "AS:i": -F.col("id"), "RG:Z": some(3, F.concat(F.lit("g"), "id")), "XA:A": F.lit("x"), "XF:f": some(5, F.col("id") / 4), "FZ:BS": some(7, F.array(F.col("id") % 7, F.lit(65535)))}
    rows = spark.range(3000).select(F.concat(F.lit("q"), "id").alias("qname"), F.lit(4).alias("flag"), *[x.alias(name) for name, x in made.items()])
    rows.write.format("bam").options(header=HEADER, level=1).mode("append").save(str(tmp_path / "x"))
    maps = {r["qname"]: {k: next(v for v in (t["i"], t["f"], t["s"], t["ia"]) if v is not None) for k, t in r["tags"].items()} for r in spark.read.format("bam").load(str(tmp_path / "x")).collect()}
    want = {r["qname"]: {name[:2]: r[name] for name in made if r[name] is not None} for r in rows.collect()}
    assert maps == want and len(want) == 3000
    schema = "FZ array<bigint>, qname string, NM int, AS bigint, RG string, XA string, XF float, pos bigint, ZZ string"
    got = spark.read.format("bam").schema(schema).load(str(tmp_path / "x"))
    assert got.columns == [c.split()[0] for c in schema.split(", ")]
    for r in got.collect():
        assert {k: v for k, v in r.asDict().items() if v is not None} == want[r["qname"]] | {"qname": r["qname"], "pos": 0}


def test_typed_columns_have_the_bytes_and_values_of_maps():
    import numpy as np

    rows = [{"NM:C": 3, "CO:Z": "a", "XB:Bf": [0.5], "tags": {"XA": tag("A", s="x")}}, {"NM:C": None, "CO:Z": "ü", "XB:Bf": [], "tags": None}, {"NM:C": 255, "CO:Z": None, "XB:Bf": None, "tags": None}]
    typed = pa.schema([("NM:C", pa.int64()), ("CO:Z", pa.string()), ("XB:Bf", pa.list_(pa.float32())), ("tags", SCHEMA.field("tags").type)])
    single = lambda r: bam.encode_record(dict.fromkeys(bam_batches.FIELDS) | {"tags": (r["tags"] or {}) | {k[:2]: tag(k[3:], **{p: r[k]}) for k, p in (("NM:C", "i"), ("CO:Z", "s"), ("XB:Bf", "fa")) if r[k] is not None}})
    for some in (rows, rows[:1], rows[1:], rows[2:]):
        batch = pa.RecordBatch.from_pylist([r | {"tags": list((r["tags"] or {}).items())} for r in some], typed)
        assert b"".join(bam_batches.encode(batch)) == b"".join(map(single, some))
    # The last of repeated tags counts, and a value of another type is none.
    raws = [bam.encode_tags(r["tags"]) for r in odd_rows()] + [b"NMC\x01NMC\x02", b"MDZ\xe9\0", b"CGBi" + struct.pack("<i", 0), b"NMZ7\0", b"ab"]
    ends = np.cumsum([len(r) for r in raws])
    wanted = pa.schema([("NM", pa.int64()), ("XL", pa.int64()), ("XF", pa.float32()), ("MD", pa.string()), ("XA", pa.string()), ("CG", pa.list_(pa.int64())), ("FZ", pa.list_(pa.int64())), ("XB", pa.list_(pa.float32()))])
    got = bam_batches.tag_columns(np.frombuffer(b"".join(raws), np.uint8), ends - [len(r) for r in raws], ends, wanted)
    maps = [bam.decode_tags(r) for r in raws]
    for key, place in {"NM": "i", "XL": "i", "XF": "f", "MD": "s", "XA": "s", "CG": "ia", "FZ": "ia", "XB": "fa"}.items():
        assert got[key].to_pylist() == [m.get(key, {}).get(place) for m in maps]


def test_a_region_by_end_leaves_out_the_span_of_unmapped_records(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan

    register(spark)
    rows = spark.range(40_000).select(F.concat(F.lit("q"), "id").alias("qname"), F.when(F.col("id") % 4 == 0, 4).otherwise(0).alias("flag"), F.lit(0).alias("ref_id"), (F.col("id") * 90 + 1).cast("int").alias("pos"), F.lit("50M").alias("cigar"))
    rows.coalesce(1).write.format("bam").options(header=HEADER, single="true").mode("append").save(str(tmp_path / "x"))
    path = list_files(str(tmp_path / "x"))[0][0]
    bam.make_index(spark, path, path + ".bai")

    def read(*filters):
        reader = bam.BamReader({"path": path}, spark.read.format("bam").load(path).schema)
        reader.pushFilters([EqualTo(("ref_id",), 0), LessThan(("pos",), 90_000), *filters])
        return sum((p.end - p.begin) >> 16 for p in reader.partitions())

    whole = read()
    assert read(GreaterThan(("end_pos",), 20_000)) < whole / 5 and read(GreaterThanOrEqual(("end_pos",), 1)) < whole / 5
    # Unmapped records end at 0 and may lie anywhere.
    assert read(GreaterThan(("pos",), 20_000)) == read(GreaterThan(("end_pos",), -1)) == read(GreaterThanOrEqual(("end_pos",), 0)) == whole
    got = spark.read.format("bam").load(path)
    for where in ("end_pos > 20000", "end_pos >= 0", "end_pos > -1", "pos > 20000", "end_pos >= 1"):
        want = got.filter(f"pos < 90000 and {where}").count()
        assert got.filter(f"ref_id = 0 and pos < 90000 and {where}").count() == want > 500
