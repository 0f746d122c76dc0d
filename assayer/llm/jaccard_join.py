"""Links between texts whose shingle sets have a Jaccard similarity of at least a threshold, and their components.

Parity sketches: every shingle flips one bit of a text's sketch, so the number of
bits in which two sketches differ is at most the size of the symmetric difference
of the sets. Two sets of a and b shingles that link differ in at most
``most_different(a, b)`` shingles, so in at most as many of the P segments of
their sketches. Sizes fall into bands, each with one P beyond that number; two
linked sets of a band agree in about a quarter of the segments at least (a sketch
has 65,536 bits in each segment and is stored as the hash of the bits that are
set). Where two sets have to agree in t segments, each may leave out the t - 1 of
its own that most texts share: the rarest segment they have in common is left in
both. So a passage that many texts share makes no candidates, unless it is long
enough to be most of a link, and the join on the segments left finds all links.
Candidates also have to agree well enough in a second sketch of 512 bits, and are
then verified on the shingle sets.

Equal sets become one node first. In a segment shared by many texts not all
pairs are formed: all its texts are compared with the smallest id, verified links
are contracted to components, and only texts of different components that still
share a segment are compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.bitmap import bitmap_of, may_hold
from assayer.llm.common import attached, id_and_text, pinned, released, unused
from assayer.llm.components import components
from assayer.llm.wordhash import mix, windows, words_of
from assayer.operators.ordered import fits_broadcast

PORTION = 256
SKETCH_WORDS = 8
#: Of the sketches that are compared before whole sets are: enough for sets of some 20,000 shingles.
WIDE_BITS = 8192
#: Segments are told apart by how many texts share them: more than so many of these numbers.
SHARED_BY = (1, 4, 16, 64, 256)
#: With each key of a set go so many of the keys in front of it, to tell pairs that have met already.
BEFORE = 4


def agreed(segments: int) -> int:
    """Segments of a band, empty unnamed ones aside, that two linked sets share in some band at least."""
    return max(2, segments // 4)


class Rule:
    """Linked if 100 * intersection >= percent * union; everything that follows from that."""

    def __init__(self, percent: int, width: int):
        self.percent, self.width = percent, width

    def most_different(self, a: int, b: int) -> int:
        """Largest symmetric difference of linked sets of these sizes, as union = (a + b + difference) / 2."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def partners(self, n: int) -> tuple[int, int]:
        """Smallest and largest set that can link with a set of ``n``."""
        return -(-self.percent * n // 100), 100 * n // self.percent

    def bands(self, n: int) -> tuple[tuple[int, int, int, int], ...]:
        """(band, segments, segments that may be empty unsaid, segments it shares with a partner) of all bands a set of ``n`` can meet a partner in."""
        return _bands(self.percent, n)

    def _bands(self, n: int) -> tuple[tuple[int, int, int, int], ...]:
        least, most = self.partners(n)
        lo, hi = self.most_different(n, least), self.most_different(n, most)
        found, band, segments = [], 0, 1
        while True:
            spare = segments // 25
            served = segments - spare - agreed(segments)
            if served >= lo:
                # Two sets meet in the first band that serves their difference, which is at most ``hi``.
                found.append((band, segments, spare, segments - spare - min(served, hi)))
            if served >= hi:
                return tuple(found)
            band, segments = band + 1, max(segments + 1, segments * 3 // 2)


@lru_cache(maxsize=20_000)
def _bands(percent: int, n: int) -> tuple[tuple[int, int, int, int], ...]:
    """Kept by numbers: a worker gets another ``Rule`` with each task, and would keep the bands of all of them."""
    return Rule(percent, 1)._bands(n)


def shingles_of(texts: list[str], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle, one without words none."""
    words = words_of(texts, lower=True)
    runs = windows(words.hashes, width)
    for first, end in zip(words.firsts[:-1].tolist(), words.firsts[1:].tolist(), strict=True):
        if end - first >= width:
            yield np.unique(runs[first : end - width + 1])
        else:
            yield windows(words.hashes[first:end], end - first) if end > first else runs[:0]


def small_sketch(shingles: np.ndarray) -> np.ndarray:
    bits = np.zeros(SKETCH_WORDS * 64, np.uint8)
    np.bitwise_xor.at(bits, (shingles >> np.uint64(20)) % np.uint64(len(bits)), 1)
    return np.packbits(bits).view(np.int64)


def keys_by_band(shingles: np.ndarray, rule: Rule) -> Iterator[tuple[np.ndarray, int]]:
    """Keys of the segments of the parity sketches of a set in each of its bands, and how many a partner shares.

    Bits that are flipped twice cancel, in the sketch and in the xor. Empty
    segments are only named if there are more than the band has to spare: P
    segments, at most P - spare - t of them different, leave spare + t
    equal ones, so a set with no more than ``spare`` empty ones shares t that
    aren't empty.
    """
    place = shingles & np.uint64(0xFFFF)
    for band, segments, spare, shared in rule.bands(len(shingles)):
        segment = (shingles >> np.uint64(24)) % np.uint64(segments)
        bits = np.zeros(segments, np.uint64)
        np.bitwise_xor.at(bits, segment, mix(place + (segment << np.uint64(16)) + np.uint64(band << 56)))
        named = np.flatnonzero(bits)
        if segments - len(named) > spare:
            named = np.arange(segments)
        yield mix(bits[named] ^ mix(named.astype(np.uint64) + np.uint64((band + 1) << 48))), shared


def segment_keys(shingles: np.ndarray, rule: Rule) -> np.ndarray:
    """The keys of all bands of a set."""
    return np.concatenate([np.zeros(0, np.uint64), *(keys for keys, _ in keys_by_band(shingles, rule))])


def rare_keys(shingles: np.ndarray, rule: Rule, shared_by: list[np.ndarray]) -> np.ndarray:
    """The keys of ``ranked_keys``."""
    return ranked_keys(shingles, rule, shared_by)[:, 0]


def ranked_keys(shingles: np.ndarray, rule: Rule, shared_by: list[np.ndarray]) -> np.ndarray:
    """A row (key, the BEFORE keys in front of it, 0 for none) for each of the keys of a set that other sets have, in each band without as many of the most shared as one less than a partner has too.

    ``shared_by``: bitmaps of the keys of more than 1, 4, 16, ... texts. Of the keys
    that two linked sets have in common, the first by (bitmaps it is in, key) has all
    others behind it in both, so neither set leaves it out. What decides is the same
    for a key in all sets, so false positives of the bitmaps lose nothing.
    """
    out = [np.zeros((0, BEFORE + 1), np.uint64)]
    for keys, shared in keys_by_band(shingles, rule):
        keys = keys[may_hold(shared_by[0], keys)]
        if len(keys) >= shared:
            often = sum(may_hold(bits, keys).astype(np.int8) for bits in shared_by)
            left = keys[np.lexsort((keys, often))[: len(keys) - shared + 1]]
            padded = np.concatenate([np.zeros(BEFORE, np.uint64), left])
            out.append(np.stack([padded[BEFORE - k : len(padded) - k] for k in range(BEFORE + 1)], axis=1))
    return np.concatenate(out)


def shingle_sets(rows: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, two fingerprints and the small sketch of every set."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PORTION):
                some = batch.slice(at, PORTION)
                sets = list(shingles_of(some.column("text").to_pylist(), rule.width))
                one = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                two = np.array([np.bitwise_xor.reduce(mix(~s)) if len(s) else 0 for s in sets], np.uint64)
                sketches = pa.array(np.concatenate([small_sketch(s) for s in sets]))
                ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SKETCH_WORDS)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        pa.ListArray.from_arrays(ends, sketches),
                    ],
                    ["doc_id", "n_shingles", "one", "two", "sketch"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(released(described), f"doc_id {kind}, n_shingles long, one long, two long, sketch array<long>")


def _some_sets(rows: DataFrame, rule: Rule, wanted, each, names: list[str], schema: str) -> DataFrame:
    """``each`` (a set -> array, one row for each row made) exploded, for the texts whose id the bitmap ``wanted`` may hold."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            batch = batch.take(pa.array(np.flatnonzero(may_hold(wanted.value, ids))))
            for at in range(0, batch.num_rows, PORTION):
                some = batch.slice(at, PORTION)
                found = [each(s) for s in shingles_of(some.column("text").to_pylist(), rule.width)]
                owners = np.repeat(np.arange(len(found)), [len(f) for f in found])
                values = np.concatenate(found).view(np.int64).reshape(len(owners), len(names) - 1)
                yield pa.RecordBatch.from_arrays([some.column("doc_id").take(pa.array(owners)), *(pa.array(v) for v in values.T)], names)

    return rows.mapInArrow(released(made), schema)


def _full_sets(rows: DataFrame, rule: Rule, wanted) -> DataFrame:
    """doc_id and the sorted set, for the texts whose id the bitmap ``wanted`` may hold."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            batch = batch.take(pa.array(np.flatnonzero(may_hold(wanted.value, ids))))
            for at in range(0, batch.num_rows, PORTION):
                some = batch.slice(at, PORTION)
                sets = list(shingles_of(some.column("text").to_pylist(), rule.width))
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), lists], ["doc_id", "shingles"])

    return rows.mapInArrow(released(made), "doc_id long, shingles array<long>")


def may_link(rule: Rule, a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """Sizes and small sketches allow a link."""
    differing = sum(
        (F.bit_count(sketch_a[i].bitwiseXOR(sketch_b[i])) for i in range(1, SKETCH_WORDS)), F.bit_count(sketch_a[0].bitwiseXOR(sketch_b[0]))
    )
    sizes = (F.least(a, b) * 100 >= F.greatest(a, b) * rule.percent) & (F.least(a, b) > 0)
    return sizes & (differing * (100 + rule.percent) <= (a + b) * (100 - rule.percent))


def _ids_of(pairs: DataFrame):
    """A bitmap of all ids in stored pairs (a, b), broadcast."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    return pairs.sparkSession.sparkContext.broadcast(bitmap_of(ids, "doc_id", ids.agg(F.approx_count_distinct("doc_id")).first()[0]))


def wide_sketch(shingles: np.ndarray) -> bytes:
    """A parity sketch of WIDE_BITS bits, which also tells large sets apart."""
    bits = np.zeros(WIDE_BITS, np.uint8)
    np.bitwise_xor.at(bits, (shingles >> np.uint64(20)) % np.uint64(WIDE_BITS), 1)
    return np.packbits(bits).tobytes()


def agreeing(rows: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """Those of the pairs (a, b) whose wide sketches allow a link; a sketch has 1 KB, whatever the size of its set."""
    wanted, percent = _ids_of(pairs), rule.percent

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            batch = batch.take(pa.array(np.flatnonzero(may_hold(wanted.value, ids))))
            for at in range(0, batch.num_rows, PORTION):
                some = batch.slice(at, PORTION)
                sets = list(shingles_of(some.column("text").to_pylist(), rule.width))
                sizes, sketches = pa.array([len(s) for s in sets], pa.int64()), pa.array([wide_sketch(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), sizes, sketches], ["doc_id", "n", "sketch"])

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
            differing = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
            sizes = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(differing * (100 + percent) <= sizes * (100 - percent)))

    # Stored, so that a task of the join needs one Python worker, not one for each side and one for itself.
    sketches = pinned(rows.mapInArrow(released(made), "doc_id long, n long, sketch binary"), "jaccard-sketches")
    both = pairs.join(sketches.toDF("a", "n_a", "sketch_a"), "a").join(sketches.toDF("b", "n_b", "sketch_b"), "b")
    return both.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(released(allowed), "a long, b long").distinct()


def verified(rows: DataFrame, candidates: DataFrame, rule: Rule) -> DataFrame:
    """Those of the pairs (a, b) whose sets link; only pairs that agree in their wide sketches are compared set by set."""
    pairs = pinned(agreeing(rows, candidates, rule), "jaccard-agreeing")
    sets = pinned(_full_sets(rows, rule, _ids_of(pairs)), "jaccard-full-sets")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b"
    )
    percent = rule.percent

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                a, b = (batch.column(c)[i].values.to_numpy() for c in ("set_a", "set_b"))
                shared = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(released(linked), "b long, a long" if both.columns[0] == "b" else "a long, b long").distinct()


def linked_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id.

    Words are runs without white space, A-Z lower-cased; a set holds the distinct
    shingles of ``width`` words, or the whole sequence of fewer words. Sets link
    if 100 * intersection >= percent * union. Texts without words, empty and null
    texts have no shingles and link with nothing. component_id is the smallest id
    reachable by links, itself included. Ids are integers or texts of integers.
    Rows that share an id are one node, with
    the links of all their texts; rows without an id link with nothing and have a
    null component. An empty table gives no rows; other columns are not looked at.
    """
    rule = Rule(percent, width)
    spark = docs.sparkSession
    everything = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = everything.where("doc_id IS NOT NULL")
    sets = pinned(shingle_sets(everything, rule), "jaccard-sets")
    known = sets.where("doc_id IS NOT NULL AND n_shingles > 0")
    keys = ["n_shingles", "one", "two"]
    # Equal sets are one node, named by their smallest id.
    classes = pinned(known.groupBy(*keys).agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("size"), F.first("sketch").alias("sketch")), "jaccard-classes")
    nodes = classes.select(F.col("node").alias("doc_id"), "n_shingles", "sketch")
    reps = spark.sparkContext.broadcast(bitmap_of(nodes, "doc_id", classes.count()))

    def all_keys(shingles: np.ndarray) -> np.ndarray:
        return segment_keys(shingles, rule)

    counted = _some_sets(rows, rule, reps, all_keys, ["doc_id", "key"], "doc_id long, key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    shared = pinned(counted.where("n > 1"), "jaccard-keys")
    by_number = [shared.where(F.col("n") > least) for least in SHARED_BY]
    shared_by = spark.sparkContext.broadcast([bitmap_of(keys, "key", keys.count()) for keys in by_number])

    def keys_left(shingles: np.ndarray) -> np.ndarray:
        return ranked_keys(shingles, rule, shared_by.value)

    names = ["doc_id", "key", *(f"before_{k}" for k in range(1, BEFORE + 1))]
    segments = pinned(_some_sets(rows, rule, reps, keys_left, names, ", ".join(f"{name} long" for name in names)), "jaccard-segments")
    near = pinned(_allowed(_star(segments.select("doc_id", "key")), nodes, rule), "jaccard-star")
    links = pinned(verified(rows, near, rule), "jaccard-links")
    labels = components(links)

    others = pinned(_across(segments, labels, nodes, rule), "jaccard-across")
    more = pinned(verified(rows, others, rule), "jaccard-more")
    same_id = _classes_of_shared_ids(known, classes, keys)
    # The first links are done with: only their components are linked further.
    merged = components(_labelled(_labelled(more.unionByName(same_id), "a", labels), "b", labels))

    named = _labelled(_labelled(classes.withColumn("component_id", F.col("node")), "component_id", labels), "component_id", merged)
    final = pinned(named.select(*keys, "size", "component_id"), "jaccard-final")
    linked = attached(sets.where("doc_id IS NOT NULL AND n_shingles > 0").drop("sketch"), final, keys, "size")
    alone = sets.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n_shingles", "component_id").unionByName(alone)


def _classes_of_shared_ids(known: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """Links between the nodes of different sets that carry the same id."""
    shared = known.select("doc_id", *keys).distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    own = known.select("doc_id", *keys).join(shared, "doc_id").distinct()
    return own.join(classes.select(*keys, "node"), keys).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))


def _labelled(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """``rows`` with the labels of the ids in ``column``; ids without one stay."""
    own = labels.select(F.col("doc_id").alias("_of"), F.col("label").alias("_label"))
    return rows.join(own, F.col(column) == F.col("_of"), "left").withColumn(column, F.coalesce("_label", column)).drop("_of", "_label")


def _allowed(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    a = nodes.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("sketch_a"))
    b = nodes.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("sketch_b"))
    both = pairs.join(a, "a").join(b, "b")
    return both.where(may_link(rule, F.col("n_a"), F.col("n_b"), F.col("sketch_a"), F.col("sketch_b"))).select("a", "b").distinct()


def _star(segments: DataFrame) -> DataFrame:
    """Pairs (a, b) of every text of a segment with its first and its last by id."""
    classes = segments.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    members = attached(segments, pinned(classes.where("first < last"), "jaccard-ends"), ["key"], "n")
    both = members.select("doc_id", F.explode(F.array("first", "last")).alias("end")).where("doc_id <> end")
    return both.select(F.least("doc_id", "end").alias("a"), F.greatest("doc_id", "end").alias("b")).distinct()


def _across(segments: DataFrame, labels: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs that share a segment, but no component, and may link.

    In each segment texts outside its first component meet all others. So a pair of
    two components would meet once in every segment it shares; where both have one of
    the last BEFORE keys in front of it, too, it has met there and doesn't meet again.
    """
    small = pinned(labels, "jaccard-labels")
    before = [f"before_{k}" for k in range(1, BEFORE + 1)]
    labelled = segments.join(F.broadcast(small) if fits_broadcast(small) else small, "doc_id", "left").select(
        "key", "doc_id", F.coalesce("label", "doc_id").alias("label"), F.filter(F.array(*before), lambda key: key != 0).alias("before")
    )
    mixed = labelled.groupBy("key").agg(F.min("label").alias("main"), F.max("label").alias("last")).where("main < last").select("key", "main")
    held = labelled.join(mixed, "key").join(nodes, "doc_id")
    held = pinned(held, "jaccard-mixed")
    left = held.where("label <> main").select("key", *[F.col(c).alias(f"l_{c}") for c in ("doc_id", "label", "n_shingles", "sketch", "before")])
    fits = may_link(rule, F.col("l_n_shingles"), F.col("n_shingles"), F.col("l_sketch"), F.col("sketch"))
    once = (F.col("label") == F.col("main")) | (F.col("l_doc_id") < F.col("doc_id"))
    new = ~F.arrays_overlap("l_before", "before")
    met = left.join(held, (left["key"] == held["key"]) & (F.col("l_label") != F.col("label")) & once & new & fits)
    return met.select(F.least("l_doc_id", "doc_id").alias("a"), F.greatest("l_doc_id", "doc_id").alias("b")).distinct()


def one_of_each_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is the smallest of its component.

    Rows without an id and texts without words stay, and so does every row of an
    id that stays. An empty table stays empty.
    """
    found = linked_components(docs, id_col, text_col, percent, width)
    own = unused(docs, "gone_id")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, docs[id_col].cast("long") == F.col(own), "left_anti")
