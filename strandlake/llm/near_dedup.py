"""Near-duplicate documents by HyperMinHash registers, bands of them, and a check on full sets.

A document's shingles fall into buckets by the first bits of their hash. A bucket's register keeps its least hash
in short: the number of leading zeros of what follows the bucket's bits, and the mantissa bits after the first one.
Documents with equal sets are one class from the start. Bands of registers deal classes to groups, apart by size, as
sets whose sizes differ by more than a quarter can't be linked. In each group all members are paired with the
smallest; pairs whose Jaccard estimate (corrected for chance collisions of short registers) may reach the threshold
are checked on the full sets. Sets of a few shingles leave most registers empty, so these are dealt to groups by a prefix
of their shingles as well, which misses no link. Groups that then still hold several components are searched for links between these,
against every member, so that no link is lost to the choice of the smallest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, discard, fresh, mix64, shuffles_freed, splittable, stored, tune
from .components import components
from .shingles import linked, shingle_sets

#: Estimates read 2**9 short registers: 6 bits of leading zeros and 10 of mantissa.
BUCKET_BITS, MANTISSA_BITS = 9, 10
BUCKETS, EMPTY = 1 << BUCKET_BITS, np.uint16(0xFFFF)
#: Bands read 2**7 registers of 6 and 26 bits, so that a band with one register in use still tells texts apart.
BAND_BUCKET_BITS, BAND_MANTISSA_BITS = 7, 26
BAND_EMPTY = np.uint32(0xFFFFFFFF)
#: Registers of a band. A pair at 0.75 shares one of the 32 bands but for 5 cases in a million.
BAND_REGISTERS = 4
N_BANDS = (1 << BAND_BUCKET_BITS) // BAND_REGISTERS
#: Sets of at most so many shingles also have a key for each of the first of their hashes that a linked set must share one of.
SMALL = 16
PREFIX = SMALL - -(-3 * SMALL // 4) + 1
#: Estimates this many standard deviations below the threshold are dropped without a check.
DEVIATIONS = 4.5
THRESHOLD = 0.75
#: Members of a tile, and of a stretch of a group that streams past it; pairs that a member gives in a first round.
TILE, STRETCH, FIRST = 512, 4096, 8
#: The same while no texts are held.
WIDE_TILE, WIDE_STRETCH = 2048, 8192
#: One in so many groups gives pairs in the first round.
PARTS = 8
#: Hash buckets that tell which texts a check needs.
SIEVE = 1 << 18

SIGNATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("registers", pa.binary()), ("bands", pa.binary())])
BANDS = pa.schema([("band", pa.int64()), ("doc", pa.int64()), ("n", pa.int64())])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
MARKS = pa.schema([("band", pa.int64()), ("tile", pa.int64()), ("stretch", pa.int64()), ("kind", pa.int32()), ("doc", pa.int64())])


def minima(hashes: np.ndarray, bits: int, mantissa_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets (first ``bits`` bits) in use by ascending 64-bit hashes, and the short form of each one's least hash."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    lead = np.concatenate([[True], bucket[1:] != bucket[:-1]]) if len(hashes) else np.zeros(0, bool)
    rest = hashes[lead] << np.uint64(bits)
    # frexp tells the place of the first one, exactly for each half of 32 bits.
    upper, lower = (rest >> np.uint64(32)).astype(np.float64), (rest & np.uint64(0xFFFFFFFF)).astype(np.float64)
    zeros = np.where(upper > 0, 32 - np.frexp(upper)[1], 64 - np.where(lower > 0, np.frexp(lower)[1], 0)).astype(np.uint64)
    zeros = np.minimum(zeros, np.uint64(62))
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - mantissa_bits)
    return bucket[lead], zeros << np.uint64(mantissa_bits) | mantissa


def registers(hashes: np.ndarray) -> np.ndarray:
    """The short registers of a set of ascending hashes; EMPTY where a bucket has none."""
    out = np.full(BUCKETS, EMPTY, np.uint16)
    used, value = minima(hashes, BUCKET_BITS, MANTISSA_BITS)
    out[used] = value.astype(np.uint16)
    return out


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of long registers; 0 where none of its registers is in use."""
    out = np.full(1 << BAND_BUCKET_BITS, BAND_EMPTY, np.uint32)
    used, value = minima(hashes, BAND_BUCKET_BITS, BAND_MANTISSA_BITS)
    out[used] = value.astype(np.uint32)
    out = out.reshape(-1, BAND_REGISTERS)
    key = np.arange(len(out), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(BAND_REGISTERS):
        key = mix64(key + out[:, k] + np.uint64(1))
    return np.where((out != BAND_EMPTY).any(1), key | np.uint64(1), np.uint64(0))


def prefix_keys(hashes: np.ndarray) -> np.ndarray:
    """PREFIX keys of a small set: its least hashes; 0 where there are fewer, and for other sets.

    Linked sets share at least three quarters of either, so at most a quarter of a set's hashes come before the least
    shared one: that is among the first n - ceil(3 n / 4) + 1 of both.
    """
    out, n = np.zeros(PREFIX, np.uint64), len(hashes)
    if 0 < n <= SMALL:
        some = hashes[: n - -(-3 * n // 4) + 1] | np.uint64(1)
        out[: len(some)] = some
    return out


def keys_of(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set's groups, without its size: N_BANDS bands, then PREFIX hashes."""
    return np.concatenate([band_keys(hashes), prefix_keys(hashes)])


def first_shared(some: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The first key that each row of keys shares with ``own``: bands by place, then the least shared hash."""
    same = (some[:, :N_BANDS] == own[:N_BANDS]) & (some[:, :N_BANDS] != 0)
    key, lone = own[same.argmax(1)], ~same.any(1)
    if lone.any():
        prefix = some[lone, N_BANDS:]
        hit = (prefix[:, :, None] == own[None, None, N_BANDS:]).any(2) & (prefix != 0)
        key[lone] = prefix[np.arange(len(prefix)), hit.argmax(1)]
    return key


def cell(n: np.ndarray) -> np.ndarray:
    """The size class: sets that can be linked are in the same or in neighbouring ones. A set goes to its own and the next."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(4 / 3) + 1e-9).astype(np.int64)


def group_key(keys: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return mix64(keys ^ mix64(cells.astype(np.uint64) + np.uint64(77))).view(np.int64)


def collision_rate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The chance that two registers of unrelated sets of n and m shingles agree though neither is empty.

    A bucket's least hashes are about exponential, with the numbers x and y of its shingles as rates. At a value c
    hashes agree within at most c * 2**-MANTISSA_BITS, and the integral of x e^-xc * y e^-yc * c is xy / (x + y)**2.
    """
    x, y = np.maximum(n, 1) / BUCKETS, np.maximum(m, 1) / BUCKETS
    return 2.0**-MANTISSA_BITS * x * y / (x + y) ** 2


def estimates(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of rows of registers, and the number of buckets behind each."""
    buckets, agree = ((a != EMPTY) | (b != EMPTY)).sum(-1), ((a == b) & (a != EMPTY)).sum(-1)
    chance, full = collision_rate(n, m), ((a != EMPTY) & (b != EMPTY)).sum(-1)
    return (agree - chance * full) / (1 - chance) / np.maximum(buckets, 1), buckets


def may_link(a, b, n, m) -> np.ndarray:
    """Whether pairs' estimates and sizes leave room for the threshold.

    The least hashes of the buckets in use are a sample of the union without replacement, so that agreements are
    hypergeometric; a pair at the threshold has a union of (n + m) / 1.75.
    """
    found, buckets = estimates(a, b, n, m)
    union = (n + m) / (1 + THRESHOLD)
    unseen = np.clip((union - buckets) / np.maximum(union - 1, 1), 0, 1)
    margin = DEVIATIONS * np.sqrt(THRESHOLD * (1 - THRESHOLD) / np.maximum(buckets, 1) * unseen) + 1 / np.maximum(buckets, 1) + 0.005
    return (found >= THRESHOLD - margin) & (100 * np.minimum(n, m) >= 75 * np.maximum(n, m))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest (equal for equal sets), registers and band keys of each row of docs (doc_id, text)."""
    tune(docs.sparkSession)

    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column(1).to_pylist())
            yield arrow_rows(SIGNATURES, doc_id=b.column(0), n_shingles=[len(s) for s in sets], digest=[hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], registers=[registers(s).tobytes() for s in sets], bands=[keys_of(s).tobytes() for s in sets])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, registers binary, bands binary")


def bands(classes: DataFrame) -> DataFrame:
    """(band, doc, n) rows of classes (doc, n, bands): each key in use, for both of the class's sizes."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                keys = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(b.num_rows, -1)
                docs, n = b.column(0).to_numpy(), b.column(1).to_numpy()
                row, place = np.nonzero(keys)
                at = cell(n)[row]
                both = np.concatenate([group_key(keys[row, place], at), group_key(keys[row, place], at + 1)])
                yield arrow_rows(BANDS, band=both, doc=np.tile(docs[row], 2), n=np.tile(n[row], 2))

    return classes.select("doc", "n", "bands").mapInArrow(run, "band long, doc long, n long")


def _with_registers(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    side = lambda c: classes.select(F.col("doc").alias(c), F.col("n").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "r_a", "r_b")


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose estimate leaves room for a link."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n, m = (b.column(i).to_numpy() for i in (2, 3))
            left, right = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(b.num_rows, -1) for i in (4, 5))
            keep = pa.array(may_link(left, right, n, m))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], schema=PAIRS)

    return _with_registers(pairs, classes).mapInArrow(run, "a long, b long")


def _sought(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of texts whose doc may be among docs (doc), so that few other texts are shuffled.

    Ids are held against a set of hash buckets, of which there are SIEVE at most, whatever docs holds.
    """
    bucket = F.pmod(F.xxhash64("doc"), F.lit(SIEVE))
    buckets = docs.select(bucket.alias("_bucket")).distinct()
    return texts.join(F.broadcast(buckets), bucket == F.col("_bucket"), "left_semi")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets; docs has one row (doc, text) for each class."""

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            # Rows come in the order of a, whose text repeats: its set is made once for each run.
            own, other = b.column(2).to_pylist(), b.column(3).to_pylist()
            new = list({t for t in own if t not in held})
            held |= dict(zip(new, shingle_sets(new), strict=True))
            keep = pa.array([linked(held[t], s) for t, s in zip(own, shingle_sets(other), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], schema=PAIRS)
            held = {own[-1]: held[own[-1]]} if own else held

    docs = _sought(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc")))
    right, left = docs.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), docs.select(F.col("doc").alias("a"), F.col("text").alias("text_a"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _labels(links: DataFrame) -> DataFrame:
    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    labels = stored(found.select("node", "component"), "labels")
    discard(links.sparkSession, found)
    return labels


def _open_groups(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, doc, label, main, others, n) of the members of groups that hold several components."""
    labelled = members.join(labels, F.col("doc") == F.col("node"), "left").select("band", "doc", F.coalesce("component", "doc").alias("label"))
    sizes = labelled.groupBy("band", "label").agg(F.count(F.lit(1)).alias("c"))
    groups = sizes.groupBy("band").agg(F.sum("c").alias("n"), F.max(F.struct("c", "label")).alias("top")).filter("n > 2 and n > top.c").select(F.col("band").alias("g"), "n", F.col("top.label").alias("main"), (F.col("n") - F.col("top.c")).alias("others"))
    return labelled.join(splittable(groups), F.col("band") == F.col("g")).drop("g")


def _tiled(open_: DataFrame, tile: int, stretch: int) -> DataFrame:
    """(band, tile, stretch, kind, doc, label, main): kind 0 rows are a tile's members, kind 1 rows stream past it.

    The members outside a group's largest component are cut to tiles; all members stream past each tile, in stretches.
    A large group of n members, o of them outside, gives some n * o * (1 / tile + 1 / stretch) rows.
    """
    tiles, stretches = F.ceil(F.col("others") / tile).cast("long"), F.ceil(F.col("n") / stretch).cast("long")
    pick = lambda n, seed: F.pmod(F.xxhash64("doc", F.lit(seed)), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    held = open_.filter("label <> main").select("band", pick(tiles, 1).alias("tile"), each(stretches).alias("stretch"), F.lit(0).alias("kind"), "doc", "label", "main")
    streamed = open_.select("band", each(tiles).alias("tile"), pick(stretches, 2).alias("stretch"), F.lit(1).alias("kind"), "doc", "label", "main")
    return held.unionByName(streamed)


KEY = ["band", "tile", "stretch"]


def _dealt(tiled: DataFrame, classes: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    sets = classes.select(F.col("doc").alias("d"), F.col("n").alias("size"), "registers", "bands")
    rows = tiled.join(sets, F.col("doc") == F.col("d")).select(*KEY, "kind", "doc", "label", "main", "size", "registers", "bands")
    if texts is not None:
        rows = rows.join(texts.select(F.col("doc").alias("d"), "text"), F.col("doc") == F.col("d")).drop("d")
    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "kind", "doc")


def _meetings(batches):
    """(key, tile, doc, label, text, rows): a member that streams past a tile, and where those it may be linked to are in it.

    A tile is (docs, labels, sizes, registers, band keys, texts) arrays. Only members of different components meet, and
    only in the first group that they share; of two outside the main component the smaller one's tile counts.
    """
    at, tile = None, None
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(4)]
        docs, label, main, size = (b.column(i).to_numpy() for i in range(4, 8))
        regs, keys = (np.frombuffer(b"".join(b.column(i).to_pylist()), kind).reshape(b.num_rows, -1) for i, kind in ((8, np.uint16), (9, np.uint64)))
        texts = b.column(10).to_pylist() if b.num_columns > 10 else [None] * b.num_rows
        for k in range(b.num_rows):
            here = tuple(c[k] for c in cols[:3])
            if here != at:
                at, tile = here, []
            if cols[3][k] == 0:
                tile.append((docs[k], label[k], size[k], regs[k], keys[k], texts[k]))
                continue
            if isinstance(tile, list):
                if not tile:
                    continue
                tile = (*(np.array(x) for x in list(zip(*tile, strict=True))[:5]), [t[5] for t in tile])
            t_docs, t_label, t_size, t_regs, t_keys, _ = tile
            other = (t_label != label[k]) & ((label[k] == main[k]) | (t_docs < docs[k]))
            rows = np.flatnonzero(other & (100 * np.minimum(t_size, size[k]) >= 75 * np.maximum(t_size, size[k])))
            if len(rows):
                rows = rows[may_link(t_regs[rows], regs[k][None, :], t_size[rows], size[k])]
            if len(rows):
                rows = rows[group_key(first_shared(t_keys[rows], keys[k]), np.maximum(cell(t_size[rows]), cell(size[k]))) == here[0]]
            if len(rows):
                yield here, tile, regs[k], int(docs[k]), int(label[k]), texts[k], rows


def _best_across(open_: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) across components: for each member of a tile the FIRST that look nearest."""

    def run(batches):
        at, best = None, {}

        def flush():
            pairs = [(min(x, y), max(x, y)) for x, found in best.items() for _, y in sorted(found, reverse=True)[:FIRST]]
            best.clear()
            return [arrow_rows(PAIRS, **dict(zip(PAIRS.names, zip(*pairs, strict=True), strict=True)))] if pairs else []

        for here, tile, regs, doc, _, _, rows in _meetings(batches):
            if here != at:
                yield from flush()
                at = here
            score = (tile[3][rows] == regs[None, :]).sum(1).tolist()
            for s, x in zip(score, tile[0][rows].tolist(), strict=True):
                found = best.setdefault(x, [])
                found.append((s, doc))
                if len(found) > 8 * FIRST:
                    found.sort(reverse=True)
                    del found[FIRST:]
        yield from flush()

    return _dealt(_tiled(open_, WIDE_TILE, WIDE_STRETCH), classes).mapInArrow(run, "a long, b long")


def _linked_across(open_: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) across components, checked on full sets where members meet; enough to join all that are linked.

    No pair leaves a task unless it is a link that joins two components there. A first pass finds which members
    have anyone to meet in which tile, so that only their texts are brought.
    """

    def mark(batches):
        at, seen = None, set()

        def flush():
            rows = [(*at, kind, doc) for kind, doc in seen]
            seen.clear()
            return [arrow_rows(MARKS, **dict(zip(MARKS.names, zip(*rows, strict=True), strict=True)))] if rows else []

        for here, tile, _, doc, _, _, rows in _meetings(batches):
            if here != at:
                yield from flush()
                at = here
            seen.add((1, doc))
            seen.update((0, x) for x in tile[0][rows].tolist())
        yield from flush()

    def check(batches):
        at, joined, sets = None, {}, {}

        def root(x):
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        for here, tile, _, doc, label, text, rows in _meetings(batches):
            if here != at:
                at, joined = here, {}
                sets = dict(enumerate(shingle_sets(tile[5])))
            own, out = None, []
            for i in rows.tolist():
                a, b = root(int(tile[1][i])), root(label)
                if a != b:
                    own = shingle_sets([text])[0] if own is None else own
                    if linked(sets[i], own):
                        joined[max(a, b)] = min(a, b)
                        out.append((min(int(tile[0][i]), doc), max(int(tile[0][i]), doc)))
            if out:
                yield arrow_rows(PAIRS, **dict(zip(PAIRS.names, zip(*out, strict=True), strict=True)))

    tiled = _tiled(open_, TILE, STRETCH)
    marks = stored(_dealt(tiled, classes).mapInArrow(mark, "band long, tile long, stretch long, kind int, doc long").distinct(), "marks")
    meeting = tiled.join(marks, [*KEY, "kind", "doc"], "left_semi")
    return _dealt(meeting, classes, _sought(texts, marks.select("doc"))).mapInArrow(check, "a long, b long")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components."""
    side = lambda c: labels.select(F.col("node").alias(f"_{c}"), F.col("component").alias(f"_l{c}"))
    both = pairs.join(side("a"), F.col("a") == F.col("_a"), "left").join(side("b"), F.col("b") == F.col("_b"), "left")
    return both.filter(F.coalesce("_la", "a") != F.coalesce("_lb", "b")).select("a", "b")


def link_classes(classes: DataFrame, texts: DataFrame, known: DataFrame) -> DataFrame:
    """node and component for the classes (doc, n, registers, bands) that are linked to another.

    texts has (doc, text); known are links (a, b) given beforehand. What is written on the way is deleted at the end.
    """
    spark, made = classes.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(stored(df, name))
        return made[-1]

    def labelled(links: DataFrame) -> DataFrame:
        made.append(_labels(links))
        return made[-1]

    def extended(fresh_: DataFrame) -> None:
        """tested, links and labels after a check of fresh pairs."""
        nonlocal tested, links, labels
        if not fresh_.isEmpty():
            found = kept(_verified(fresh_, texts), "near")
            tested, links = tested.union(fresh_), links.union(found)
            labels = labels if found.isEmpty() else labelled(links)

    rows = bands(classes)
    groups = rows.groupBy("band").agg(F.min(F.struct("doc", "n")).alias("h"), F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("band").alias("g"), F.col("h.doc").alias("a"), F.col("h.n").alias("n_a"), "c")
    members = kept(rows.join(splittable(groups), F.col("band") == F.col("g")).select("band", "doc", "n", "a", "n_a", "c"), "members")
    stars = members.filter("doc <> a and 100 * least(n, n_a) >= 75 * greatest(n, n_a)").select("band", "a", F.col("doc").alias("b"))
    # A part of the groups links most of what there is to link; the others then add pairs of different components only.
    tested = kept(_estimated(stars.filter(F.pmod(F.xxhash64("band"), F.lit(PARTS)) == 0).select("a", "b").distinct(), classes), "pairs")
    links = kept(_verified(tested, texts).union(known), "near")
    labels = labelled(links)
    apart = _apart(stars.select("a", "b").distinct(), labels).join(tested, ["a", "b"], "left_anti")
    extended(kept(_estimated(apart, classes), "pairs"))
    larger = members.filter("c > 2").select("band", "doc")
    open_, known_labels = kept(_open_groups(larger, labels), "open"), labels
    if not open_.isEmpty():
        extended(kept(_best_across(open_, classes).distinct().join(tested, ["a", "b"], "left_anti"), "pairs"))
        if labels is not known_labels:
            open_ = kept(_open_groups(larger, labels), "open")
        found = kept(_linked_across(open_, classes, texts), "near")
        if not found.isEmpty():
            labels = labelled(links.union(found))
    discard(spark, *[df for df in made if df is not labels])
    return labels


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs (doc_id, text).

    Documents are linked if 100 * intersection >= 75 * union of their sets of five-word shingles; component_id is the
    smallest doc_id reachable, itself included, and kept says that it is the row's own. Documents without words
    (null, empty, white space) have an empty set and are linked with nothing. Rows that repeat a doc_id are one
    document, linked wherever one of its texts is. A row without a doc_id has a null component_id, is kept and links nothing. An empty
    table gives no rows. Columns other than doc_id and text are ignored.
    """
    signed = stored(signatures(docs), "signatures")
    table = stored(signed.select("doc_id", "n_shingles", "digest"), "digests")
    named = table.filter("doc_id is not null and n_shingles > 0")
    # One row for each set: groups of equal sets of any size are brought down by partial aggregates.
    sets = signed.filter("doc_id is not null and n_shingles > 0").groupBy("digest")
    best = F.min(F.struct("doc_id", "n_shingles", "registers", "bands")).alias("b")
    classes = stored(sets.agg(best).select("digest", F.col("b.doc_id").alias("doc"), F.col("b.n_shingles").alias("n"), "b.registers", "b.bands"), "classes")
    discard(spark, signed)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").filter("doc is not null")
    # A doc_id that stands for several texts links the classes of these.
    several = named.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high").select(F.col("doc_id").alias("b"))
    by_name = named.join(several, F.col("doc_id") == F.col("b")).join(classes.select(F.col("digest").alias("_d"), F.col("doc").alias("a")), F.col("digest") == F.col("_d")).select("a", "b").distinct()
    with shuffles_freed(spark):
        labels = link_classes(classes, texts, by_name)
    by_class = stored(classes.select("digest", "doc").join(labels, F.col("doc") == F.col("node"), "left").select(F.col("digest").alias("_d"), F.coalesce("component", "doc").alias("found")), "components")
    discard(spark, classes, labels)
    out = table.join(by_class, F.col("digest") == F.col("_d"), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("found")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def distinct_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' columns: of each group of near duplicates that of the smallest doc_id.

    Each row is a document of its own, also where it repeats a doc_id or has none: it goes only if its own text is
    linked to another row's. Ties go to any one; a row without a doc_id stays if all of its group are such. Rows
    without words stay. An empty table gives no rows.
    """
    own = fresh(docs, "_row")
    rows = stored(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(spark, rows.select(F.col(own).alias("doc_id"), "text")).select(F.col("doc_id").alias("_own"), "component_id")
    named = found.join(rows.select(F.col(own).alias("_id"), F.col("doc_id").cast("long").alias("doc_id")), F.col("_own") == F.col("_id"))
    best = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_own")).alias("b")).select(F.col("b._own").alias("_kept"))
    return rows.join(best, F.col(own) == F.col("_kept"), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
