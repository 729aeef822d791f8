"""Queries that write a table in a format and read it back, and that run the structures behind the formats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import bits, cigar, dna, gzip, sam_header, tags
from ..operators import blocks, fmindex, search, textindex
from ..session import batches_of, partitions_of, shared_dir, ship
from ..sources import bam, register, sniff
from ..sources.files import list_files
from .catalog import ALN, ALN_BIN, DOC_PLACES, PATTERN, QUERIES, SQL, addresses, alignments, big, query, sequences, table

# Sequence files


@query("SELECT CAST(page_id AS VARCHAR) AS header, repeat('ACGT', page_id % 5 + 1) AS seq, repeat('@I>+', page_id % 5 + 1) AS quality FROM pages")
def q_fastq_roundtrip(spark, sf_dir):
    register(spark)
    path, times = shared_dir(spark, "fastq"), (F.col("page_id") % 5 + 1).cast("int")
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("header"), F.repeat(F.lit("ACGT"), times).alias("seq"), F.repeat(F.lit("@I>+"), times).alias("quality"))
    rows.write.format("fastq").option("path", path).mode("append").save()
    return spark.read.format("fastq").options(four_lines="true", split=500).load(path).select("header", "seq", "quality")


@query("SELECT CAST(doc_id AS VARCHAR) AS header, regexp_replace(text, '[\\r\\n]', '', 'g') AS seq FROM documents")
def q_blocked_fasta_roundtrip(spark, sf_dir):
    register(spark)
    path = shared_dir(spark, "fasta-gz")
    rows = sequences(spark, sf_dir).select(F.col("header").cast("string").alias("header"), dna.strip_line_ends(F.col("seq")).alias("seq"))
    rows.write.format("fasta").options(gzip="true", markers=">").option("path", path).mode("append").save()
    return spark.read.format("fasta").options(markers=">", split=100_000).load(path).select("header", "seq")


def _address_file(spark, sf_dir, **options) -> str:
    """Addresses in the order of their ids, in one FASTA file."""
    register(spark)
    path = shared_dir(spark, "addresses")
    rows = addresses(spark, sf_dir).orderBy("header").coalesce(1).select(F.col("header").cast("string").alias("header"), "seq")
    rows.write.format("fasta").options(**options).option("path", path).mode("append").save()
    return list_files(path)[0][0]


@query("SELECT CAST(page_id AS VARCHAR) AS header, url AS seq FROM pages WHERE page_id >= 10")
def q_fasta_resume(spark, sf_dir):
    path = _address_file(spark, sf_dir)
    at = spark.read.format("fasta").load(path).filter("header = '10'").first()["file_offset"]
    return spark.read.format("fasta").option("offset", at).load(path).select("header", "seq")


@query("SELECT CAST(page_id AS VARCHAR) AS header, url AS seq FROM pages WHERE page_id >= 10")
def q_blocked_fasta_resume(spark, sf_dir):
    path = _address_file(spark, sf_dir, gzip="true")
    at = spark.read.format("fasta").load(path).filter("header = '10'").first()["file_offset"]
    return spark.read.format("fasta").option("offset", at).load(path).select("header", "seq")


@query("SELECT CAST(page_id AS VARCHAR) AS header, CAST(length(url) AS BIGINT) AS seq_len, CAST(NULL AS VARCHAR) AS seq FROM pages")
def q_lazy_fasta(spark, sf_dir):
    return spark.read.format("fasta").option("lazy", "true").load(_address_file(spark, sf_dir, width=7)).select("header", "seq_len", "seq")


@query("SELECT CAST(page_id AS VARCHAR) AS header, url AS seq, page_id % 2 = 0 AND length(url) > 20 AS multiline FROM pages")
def q_multiline_roundtrip(spark, sf_dir):
    register(spark)
    path = shared_dir(spark, "lines")
    a = addresses(spark, sf_dir)
    # Rows of one line and of many; the short width isn't given where a row is to have one line.
    many = a.filter("header % 2 = 0").select(F.col("header").cast("string").alias("header"), "seq")
    many.write.format("fasta").option("path", path).option("width", 20).mode("append").save()
    a.filter("header % 2 <> 0").select(F.col("header").cast("string").alias("header"), "seq", F.lit(False).alias("multiline")).write.format("fasta").option("path", path).mode("append").save()
    return spark.read.format("fasta").load(path).select("header", "seq", "multiline")


@query("SELECT * FROM (VALUES ('fasta', 'fasta'), ('fastq', 'fastq'), ('gzip', 'gzip'), ('bam', 'bam'), ('store', 'store')) t(written, told)")
def q_sniff(spark, sf_dir):
    register(spark)
    rows = addresses(spark, sf_dir).coalesce(1).select(F.col("header").cast("string").alias("header"), "seq", F.lit(0).cast("bigint").alias("block_id"), F.lit(0).cast("bigint").alias("ord"))
    told = []
    for kind, form, options, data in (("fasta", "fasta", {}, rows), ("fastq", "fastq", {}, rows.withColumn("quality", F.col("seq"))), ("gzip", "fasta", {"gzip": "true"}, rows), ("bam", "bam", {"header": BAM_HEADER}, _bam_rows(spark, sf_dir).coalesce(1))):
        path = shared_dir(spark, kind)
        data.write.format(form).options(**options).option("path", path).mode("append").save()
        told.append((kind, sniff(list_files(path)[0][0])))
    store = shared_dir(spark, "store")
    blocks.write_blocks(rows, store)
    return spark.createDataFrame([*told, ("store", sniff(store))], "written string, told string")


# Gzip members


@query("SELECT page_id, 'page-' || page_id AS file_name, page_id + 5 AS mtime, CAST(8 AS INT) AS flags, html AS content FROM pages WHERE html IS NOT NULL")
def q_gzip_members(spark, sf_dir):
    ship(spark)
    p = table(spark, sf_dir, "pages").filter("html is not null")
    made = p.select("page_id", gzip.gzip_member(F.col("html").cast("binary"), F.concat(F.lit("page-"), F.col("page_id").cast("string")), F.col("page_id") + 5).alias("m"))
    told = made.select("page_id", gzip.member_header(F.col("m")).alias("h"), gzip.inflated(F.col("m")).cast("string").alias("content"))
    return told.select("page_id", "h.file_name", "h.mtime", "h.flags", "content")


@query("SELECT doc_id, CAST((octet_length(encode(text)) + 65279) // 65280 + 1 AS BIGINT) AS n_blocks, sha256(text) AS digest, '1f8b08040000000000ff0600424302001b0003000000000000000000' AS last FROM documents")
def q_blocked_members(spark, sf_dir):
    ship(spark)
    made = table(spark, sf_dir, "documents").select("doc_id", gzip.blocked(F.col("text").cast("binary")).alias("m"))
    last = F.lower(F.hex(F.substring(F.col("m"), -28, 28)))
    return made.select("doc_id", big(F.size(gzip.block_offsets(F.col("m")))).alias("n_blocks"), F.sha2(gzip.inflated(F.col("m")), 256).alias("digest"), last.alias("last"))


# Alignment files

BAM_HEADER = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:ref{i}\tLN:536870912\n" for i in range(1, 8)) + "@RG\tID:g1\n@RG\tID:g2\n"
#: Rows of a batch that is written; they are short, and each batch has costs of its own.
BATCH = 10_000
#: The files are read once or twice and dropped, so they are compressed as fast as zlib can.
LEVEL = 1
QNAME = "l_orderkey || '/' || ref_id"


def _bam_rows(spark, sf_dir, ordered=False):
    a = alignments(spark, sf_dir, ordered)
    i32 = lambda c: c.cast("int")
    return a.select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("ref_id").cast("string")).alias("qname"), i32(F.col("flag")).alias("flag"), i32(F.col("ref_id") - 1).alias("ref_id"), i32(F.col("pos")).alias("pos"), i32(F.col("mapq")).alias("mapq"), "cigar")


def _bam_file(spark, sf_dir) -> str:
    """The alignments in the order of reference and position, in one file, as an index is about one."""
    register(spark)
    path = shared_dir(spark, "bam")
    rows = _bam_rows(spark, sf_dir, ordered=True)
    with batches_of(spark, BATCH), partitions_of(spark, "8m"):
        rows.write.format("bam").options(header=BAM_HEADER, single="true", level=LEVEL).option("path", path).mode("append").save()
    return list_files(path)[0][0]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{line}')" for i, line in enumerate(BAM_HEADER.replace("\t", " ").strip().split("\n"))) + ") t(line_no, line)")
def q_bam_header(spark, sf_dir):
    lines = spark.read.format("bam").option("part", "header").load(_bam_file(spark, sf_dir))
    return lines.select(F.col("line_no").cast("int").alias("line_no"), F.replace("line", F.lit("\t"), F.lit(" ")).alias("line"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, 'ref{i + 1}', 536870912)" for i in range(7)) + ") t(ref_id, name, length)")
def q_bam_references(spark, sf_dir):
    return spark.read.format("bam").option("part", "refs").load(_bam_file(spark, sf_dir))


@query("SELECT * FROM (VALUES ('g1'), ('g2')) t(group_id)")
def q_group_ids(spark, sf_dir):
    lines = spark.read.format("bam").option("part", "header").load(_bam_file(spark, sf_dir))
    return sam_header.group_ids(sam_header.parse_header(lines))


@query(f"SELECT {QNAME} AS qname, CAST(pos AS INT) AS pos, cigar, CAST(NULL AS VARCHAR) AS seq FROM {ALN}")
def q_lazy_alignments(spark, sf_dir):
    return spark.read.format("bam").options(lazy="true", split=60_000).load(_bam_file(spark, sf_dir)).select("qname", "pos", "cigar", "seq")


@query("""SELECT l_orderkey || '/' || l_linenumber AS qname, l_suppkey % 200 AS nm, -l_partkey AS score, 'g' || l_linenumber AS rg, l_returnflag AS one, CAST(l_quantity AS FLOAT) AS number, CAST(l_suppkey % 7 AS VARCHAR) || ',65535' AS numbers FROM lineitem""")
def q_tags_roundtrip(spark, sf_dir):
    register(spark)
    path, l = shared_dir(spark, "tags"), table(spark, sf_dir, "lineitem")  # noqa: E741
    made = {"NM:C": F.col("l_suppkey") % 200, "AS:i": -F.col("l_partkey"), "RG:Z": F.concat(F.lit("g"), F.col("l_linenumber").cast("string")), "XA:A": F.col("l_returnflag"), "XF:f": F.col("l_quantity").cast("float"), "FZ:BS": F.array(F.col("l_suppkey") % 7, F.lit(65535).cast("bigint"))}
    rows = l.select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("qname"), F.lit(4).alias("flag"), F.lit(-1).alias("ref_id"), F.lit("*").alias("cigar"), *[value.alias(name) for name, value in made.items()])
    with batches_of(spark, BATCH):
        rows.write.format("bam").options(header=BAM_HEADER, level=LEVEL).option("path", path).mode("append").save()
    told = spark.read.format("bam").schema("qname string, NM bigint, AS bigint, RG string, XA string, XF float, FZ array<bigint>").load(path)
    return told.select("qname", F.col("NM").alias("nm"), F.col("AS").alias("score"), F.col("RG").alias("rg"), F.col("XA").alias("one"), F.col("XF").alias("number"), F.array_join(F.col("FZ").cast("array<string>"), ",").alias("numbers"))


@query(f"""SELECT CAST(ref_id - 1 AS INT) AS ref_id, CAST(count(DISTINCT bin) FILTER (WHERE flag & 4 = 0) AS BIGINT) AS n_bins, CAST(count(*) FILTER (WHERE flag & 4 = 0) AS BIGINT) AS n_mapped, CAST(count(*) FILTER (WHERE flag & 4 <> 0) AS BIGINT) AS n_unmapped,
  CAST(max(((greatest(end_pos, pos) - 1) >> 14) + 1) FILTER (WHERE flag & 4 = 0) AS BIGINT) AS n_windows FROM {ALN_BIN} GROUP BY ref_id""")
def q_bai_roundtrip(spark, sf_dir):
    path = _bam_file(spark, sf_dir)
    bam.make_index(spark, path, path + ".bai")
    told = spark.read.format("bai").load(path + ".bai").withColumn("at", F.monotonically_increasing_id())
    pseudo = F.col("bin") == bam.UNMAPPED_BIN
    counts = F.max(F.when(pseudo, F.struct("at", "chunk_beg", "chunk_end")))
    found = told.groupBy("ref_id").agg(F.count_distinct(F.when(~pseudo, F.col("bin"))).alias("n_bins"), counts.alias("c"))
    windows = spark.read.format("bai").option("part", "linear").load(path + ".bai").groupBy(F.col("ref_id").alias("r")).agg(F.count(F.lit(1)).alias("n_windows"))
    return found.join(windows, F.col("ref_id") == F.col("r")).select("ref_id", "n_bins", F.col("c.chunk_beg").alias("n_mapped"), F.col("c.chunk_end").alias("n_unmapped"), "n_windows")


@query(f"SELECT {QNAME} AS qname, CAST(pos AS INT) AS pos, CAST(end_pos AS INT) AS end_pos FROM {ALN_BIN} WHERE ref_id = 3 AND pos < 90000 AND end_pos > 20000")
def q_region_built_index(spark, sf_dir):
    path = _bam_file(spark, sf_dir)
    return bam.indexed(spark, path).filter("ref_id = 2 and pos < 90000 and end_pos > 20000").select("qname", "pos", "end_pos")


@query(f"SELECT ref_id, bin, row_number() OVER (PARTITION BY ref_id ORDER BY bin) AS place FROM (SELECT DISTINCT CAST(ref_id - 1 AS INT) AS ref_id, CAST(bin AS BIGINT) AS bin FROM {ALN_BIN} WHERE flag & 4 = 0)")
def q_bins_ordered(spark, sf_dir):
    path = _bam_file(spark, sf_dir)
    bam.make_index(spark, path, path + ".bai")
    told = spark.read.format("bai").load(path + ".bai").filter(F.col("bin") != bam.UNMAPPED_BIN).withColumn("at", F.monotonically_increasing_id())
    # The place of a bin is where the file has it.
    first = told.groupBy("ref_id", "bin").agg(F.min("at").alias("at"))
    lists = first.groupBy("ref_id").agg(F.array_sort(F.collect_list(F.struct("at", "bin"))).alias("l"))
    return lists.select("ref_id", F.posexplode("l").alias("i", "x")).select("ref_id", "x.bin", (F.col("i") + 1).cast("bigint").alias("place"))


# Stores and text output


@query("SELECT source, doc_id AS header, CAST(dense_rank() OVER (ORDER BY source) - 1 AS BIGINT) AS block_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS ord, text AS seq FROM documents")
def q_store_roundtrip(spark, sf_dir):
    s = sequences(spark, sf_dir)
    names = s.select("source").distinct()
    ids = names.agg(F.array_sort(F.collect_list("source")).alias("l")).select(F.posexplode("l").alias("block_id", "source"))
    placed = s.join(ids.withColumn("block_id", F.col("block_id").cast("bigint")), "source")
    starts = placed.groupBy("block_id").agg(F.array_sort(F.collect_list("header")).alias("l"))
    ords = starts.select("block_id", F.posexplode("l").alias("ord", "header"))
    path = shared_dir(spark, "store")
    blocks.write_blocks(placed.join(ords.withColumn("ord", F.col("ord").cast("bigint")), ["block_id", "header"]).select("block_id", "ord", "header", "source", "seq"), path)
    return spark.read.schema("block_id bigint, ord bigint, header bigint, source string, seq string").parquet(path)


@query("SELECT block_id, source, count(*) AS n_sequences, CAST(sum(length(text) + 1) AS BIGINT) AS block_size FROM (SELECT *, CAST(dense_rank() OVER (ORDER BY source) - 1 AS BIGINT) AS block_id FROM documents) WHERE block_id = 1 GROUP BY ALL")
def q_store_block(spark, sf_dir):
    one = q_store_roundtrip(spark, sf_dir).filter("block_id = 1").withColumn("seq_len", F.length("seq"))
    names = one.select("block_id", "source").distinct()
    return blocks.block_catalog(one).join(names, "block_id").select("block_id", "source", "n_sequences", "block_size")


@query("SELECT page_id AS header, CAST((length(url) - length(replace(url, 'th', ''))) // 2 AS BIGINT) AS n_matches, substring(url, 3, 8) AS part FROM pages")
def q_index_store(spark, sf_dir):
    path = shared_dir(spark, "fm")
    fmindex.build_indexes(addresses(spark, sf_dir)).write.parquet(path)
    fm = spark.read.parquet(path)
    return fm.select("header", fmindex.fm_count(F.col("fm"), "th").alias("n_matches"), fmindex.fm_extract(F.col("fm"), 2, 10).alias("part"))


@query('SELECT seqid || chr(9) || source || chr(9) || type || chr(9) || "start" || chr(9) || "end" || chr(9) || score || chr(9) || strand || chr(9) || phase || chr(9) || attributes AS line FROM (' + SQL["q_gff_both_strands"].replace("FROM benchmark", "FROM (SELECT item_id, regexp_replace(text, '[\\r\\n]', '', 'g') AS text FROM benchmark)") + ")")
def q_query_file_to_gff(spark, sf_dir):
    register(spark)
    path = shared_dir(spark, "queries")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("header"), dna.strip_line_ends(F.col("text")).alias("seq"))
    asked.write.format("fasta").option("path", path).option("markers", ">").mode("append").save()
    queries = spark.read.format("fasta").option("markers", ">").load(path).select("header", "seq")
    return search.gff_lines(search.gff_search(sequences(spark, sf_dir), queries))


@query("SELECT substring(text, 11, 40) AS bases FROM documents WHERE doc_id = 3")
def q_region_dump(spark, sf_dir):
    path = shared_dir(spark, "region")
    part = search.extract(sequences(spark, sf_dir), 3, 10, 50).select("bases")
    part.write.option("lineSep", "\x00").text(path)
    return spark.read.option("lineSep", "\x00").text(path).withColumnRenamed("value", "bases")


# Functions


@query("SELECT doc_id, source || lang AS header FROM documents")
def q_strip_header(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", dna.strip_header(F.concat(F.col("source"), F.lit("\r"), F.col("lang"), F.lit("\r"))).alias("header"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey % 3 = 0 AND l_partkey % 2 = 0 AS says_nothing FROM lineitem")
def q_zero_quality(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", dna.quality_is_zero(F.array(F.col("l_suppkey") % 3, F.col("l_partkey") % 2)).alias("says_nothing"))


@query(f"SELECT l_orderkey, ref_id, array_to_string(regexp_extract_all(cigar, '[MIDNSHP=X]'), '') AS ops, array_to_string(regexp_extract_all(cigar, '[0-9]+'), ',') AS lengths FROM {ALN}")
def q_cigar_arrays(spark, sf_dir):
    a = alignments(spark, sf_dir)
    return a.select("l_orderkey", "ref_id", F.array_join(cigar.cigar_ops(F.col("ops")), "").alias("ops"), F.array_join(cigar.cigar_lengths(F.col("ops")).cast("array<string>"), ",").alias("lengths"))


@query("SELECT event_id, CAST(NULL AS BIGINT) AS nm, event_type AS rg, CAST(1 AS INT) AS n_left FROM events")
def q_tag_remove(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    made = F.create_map(F.lit("NM"), tags.make_tag("C", F.col("user_id") % 100), F.lit("RG"), tags.make_tag("Z", F.col("event_type")))
    held = e.withColumn("t", tags.remove_tag(made, "NM"))
    return held.select("event_id", tags.int_tag(F.col("t"), "NM").alias("nm"), tags.read_group(F.col("t")).alias("rg"), F.size("t").alias("n_left"))


@query("SELECT * FROM (VALUES ('B', 2), ('Z', 32), ('i', 18)) t(kind, n)")
def q_tag_catalogue(spark, sf_dir):
    rows = spark.createDataFrame(sorted(tags.tag_types().items()), "tag string, kind string")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'unsorted' WHEN 2 THEN 'queryname' ELSE 'coordinate' END AS sorting, CASE s_suppkey % 2 WHEN 0 THEN 'ILLUMINA' ELSE 'PACBIO' END AS platform FROM supplier")
def q_header_enums(spark, sf_dir):
    k = F.col("s_suppkey")
    given = F.when(k % 4 == 0, "UNKNOWN").when(k % 4 == 1, "Unsorted").when(k % 4 == 2, "queryname").otherwise("CoordinatE")
    return table(spark, sf_dir, "supplier").select("s_suppkey", sam_header.one_of(given, sam_header.SORTING).alias("sorting"), sam_header.one_of(F.when(k % 2 == 0, "ILLUMINA").otherwise("PACBIO"), sam_header.PLATFORMS, exact=True).alias("platform"))


@query(f"SELECT header, pos FROM {DOC_PLACES} WHERE i < n")
def q_locate_table_function(spark, sf_dir):
    search.register_locate(spark)
    sequences(spark, sf_dir).createOrReplaceTempView("strandlake_sequences")
    return spark.sql(f"SELECT header, pos FROM strandlake_sequences, LATERAL locate_pattern(seq, '{PATTERN}')")


# Bits, ranks and codes


def _per_text(df, kind: str, run):
    """One row for each (key, text), made by run(text) in the order of kind's columns after the key."""
    ship(df.sparkSession)

    def each(batches):
        for b in batches:
            rows = [(k, *run(t or "")) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in f"header bigint, {kind}".split(", ")])

    return df.select(F.col("header").cast("bigint"), "seq").mapInArrow(each, f"header bigint, {kind}")


@query("SELECT page_id AS header, url AS text, CAST(length(url) + 1 AS BIGINT) AS n_bytes, CAST(5 AS BIGINT) AS peeked FROM pages")
def q_bit_stream(spark, sf_dir):
    def run(text):
        out = bits.BitWriter()
        out.write(5, 3)
        out.align()
        for c in text.encode():
            out.write(c, 8)
        source = bits.BitReader(out.bytes())
        peeked = source.peek(3)
        source.read(3)
        source.align()
        return bytes(source.read(8) for _ in text.encode()).decode(), len(source.data), peeked

    return _per_text(addresses(spark, sf_dir), "text string, n_bytes bigint, peeked bigint", run)


@query("""SELECT page_id AS header, CAST(length(h) - length(replace(h, 'e', '')) AS BIGINT) AS ones, CAST(length(h) - (length(h) - length(replace(h, 'e', ''))) AS BIGINT) AS zeros, CAST(CASE WHEN contains(url, 'e') THEN strpos(url, 'e') - 1 ELSE -1 END AS BIGINT) AS first
FROM (SELECT *, left(url, length(url) // 2) AS h FROM pages)""")
def q_bit_ranks(spark, sf_dir):
    def run(text):
        vector, half = bits.BitVector(np.array([c == "e" for c in text], np.uint8)), len(text) // 2
        return vector.rank(1, half), vector.rank(0, half), vector.select(1, 1)

    return _per_text(addresses(spark, sf_dir), "ones bigint, zeros bigint, first bigint", run)


@query("""SELECT page_id AS header, substring(url, 3, 1) AS third, CAST(length(h) - length(replace(h, 't', '')) AS BIGINT) AS rank, CAST(CASE WHEN contains(url, 't') THEN strpos(url, 't') - 1 ELSE -1 END AS BIGINT) AS first
FROM (SELECT *, left(url, length(url) // 2) AS h FROM pages)""")
def q_wavelet(spark, sf_dir):
    def run(text):
        data = text.encode()
        codes = textindex.canonical_codes(textindex.code_lengths({c: data.count(c) for c in set(data)}))
        tree = bits.WaveletTree(data, codes)
        return chr(tree.get(2)), tree.rank(ord("t"), len(data) // 2), tree.select(ord("t"), 1)

    return _per_text(addresses(spark, sf_dir), "third string, rank bigint, first bigint", run)


@query("SELECT header, string_agg(CAST(sa_rank AS VARCHAR), ',' ORDER BY pos) AS ranks FROM (SELECT header, sa_rank, pos FROM (" + SQL["q_suffix_array"] + ")) GROUP BY header")
def q_inverse_suffix_array(spark, sf_dir):
    def run(text):
        return (",".join(map(str, bits.inverse(textindex.suffix_order(text.encode())).tolist())),)

    return _per_text(addresses(spark, sf_dir), "ranks string", run)


@query("SELECT page_id AS header, url AS text FROM pages")
def q_code_roundtrip(spark, sf_dir):
    counts = {r["ch"]: r["n"] for r in textindex.histogram(addresses(spark, sf_dir)).collect()}
    codes = textindex.canonical_codes(textindex.code_lengths(counts))
    return _per_text(addresses(spark, sf_dir), "text string", lambda t: (textindex.decode_text(textindex.encode_text(t, codes), len(t), codes),))


#: Codes of given lengths, from 7 bits on: each is the sum of what the shorter and earlier ones take up.
@query("""WITH c AS (SELECT ch, CAST(7 + unicode(ch) % 4 AS BIGINT) AS bits FROM (SELECT DISTINCT unnest(string_split(url, '')) AS ch FROM pages) WHERE ch <> ''),
s AS (SELECT ch, bits, coalesce(sum(CAST(1 AS BIGINT) << CAST(10 - bits AS INT)) OVER (ORDER BY bits, ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT ch, bits, lpad(bin(CAST(before AS BIGINT) >> CAST(10 - bits AS INT)), CAST(bits AS INT), '0') AS code FROM s""")
def q_canonical_codes(spark, sf_dir):
    lengths = {r["ch"]: 7 + ord(r["ch"]) % 4 for r in textindex.histogram(addresses(spark, sf_dir)).collect()}
    return spark.createDataFrame([(s, lengths[s], c) for s, c in textindex.canonical_codes(lengths).items()], "ch string, bits bigint, code string")


__all__ = ["QUERIES"]
