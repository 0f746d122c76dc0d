"""Collocations: phrases whose words stand together more often than their parts suggest.

Counting goes level by level. A phrase is at most as frequent as any part of it, so
longer phrases are only counted where both phrases that are one word shorter reach
the least count. Blocks of text are counted in the tasks, sums are grouped by phrase.

The counts that remain are a stream of (language, words, count), which is read in
two orders, as external estimation of language models does. In prefix order a phrase
comes right behind the phrases it begins with: one pass keeps the counts of the
current path and so merges each phrase with its left parts in lockstep, and tells
each phrase whether an extension by one word is frequent enough to stand for it. In
suffix order (words reversed) the same pass gives the right parts. Nothing is looked
up by hash: both passes read sorted slices from front to back. Slices are cut
anywhere by range; what a slice needs from before its beginning are the counts on
one path, at most as many as a phrase has words, which are fetched for all slices
together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from assayer.llm.bitmap import bitmap_of, may_hold
from assayer.llm.common import in_small_batches, pinned
from assayer.llm.wordhash import mix

NO_LANGUAGE = "und"
#: Bytes of text that are counted at once, cut at ends of pieces.
BLOCK = 4 << 20
_ENDS = b".,;:!?\n\v\f\r"
_PLAIN = bytes.maketrans(
    _ENDS + b"\t" + bytes(range(ord("A"), ord("Z") + 1)), b"\n" * len(_ENDS) + b" " + bytes(range(ord("a"), ord("z") + 1))
)


class Numbers(dict):
    """Numbers words as they come; the end of a piece is 0."""

    def __init__(self):
        super().__init__({b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def blocks_of(texts: list[str]) -> Iterator[bytes]:
    """The texts in plain form (lower case, pieces end with a line feed), in blocks that end where pieces end."""
    data = "\n".join([*texts, ""]).encode().translate(_PLAIN)
    at = 0
    while at < len(data):
        end = data.rfind(b"\n", at, at + BLOCK)
        if end < 0:
            end = data.find(b"\n", at + BLOCK)
        yield data[at : end + 1]
        at = end + 1


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    head = lang.encode() + b"\n"
    return np.array([xxhash.xxh64_intdigest(head + word) for word in words], np.uint64)


def extended(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases that are one word longer."""
    return mix(hashes * np.uint64(0x9E3779B97F4A7C15) + words)


def counted(lang: str, block: bytes, length: int, frequent: list[np.ndarray]) -> tuple[int, pa.Array, np.ndarray]:
    """Number of words of a block, its phrases of ``length`` words and their numbers.

    ``frequent`` holds a bitmap of phrases for each shorter length; phrases with a part that isn't in them are left out.
    """
    numbers = Numbers()
    tokens = np.array([numbers[word] for word in block.replace(b"\n", b" \n ").split(b" ") if word], np.int64)
    words = list(numbers)
    hashes = word_hashes(lang, words) if frequent else np.zeros(0, np.uint64)
    total, own = int((tokens != 0).sum()), hashes
    strings = words_array = pa.array(words, pa.binary())
    places, ids = np.flatnonzero(tokens), tokens
    ids = ids[places]
    for k in range(1, length):
        # phrases of k words at `places` are `ids`; only frequent ones go on
        good = may_hold(frequent[k - 1], own)[ids]
        places, ids = places[good], ids[good]
        # both the phrase and the one that begins a word later are needed, and the word behind
        follows = np.flatnonzero(places[1:] == places[:-1] + 1) if len(places) else places
        ahead = tokens[places[follows] + k]
        codes, inverse = np.unique(ids[follows] * len(words) + ahead, return_inverse=True)
        before, behind = codes // len(words), codes % len(words)
        strings = pc.binary_join_element_wise(strings.take(pa.array(before)), words_array.take(pa.array(behind)), b" ")
        own = extended(own[before], hashes[behind])
        places, ids = places[follows], inverse
    amounts = np.bincount(ids, minlength=len(strings))
    some = np.flatnonzero(amounts)
    return total, strings.take(pa.array(some)), amounts[some]


def level(rows: DataFrame, length: int, bitmaps: list) -> DataFrame:
    """lang, phrase, n: sums over all texts of the phrases of ``length`` words; with length 1 also each language's number of words, as the empty phrase."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        size, maps = 0, [bitmap.value for bitmap in bitmaps]

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                for block in blocks_of(texts):
                    total, phrases, amounts = counted(lang, block, length, maps)
                    if length == 1 and total:
                        phrases = pa.concat_arrays([phrases, pa.array([b""], pa.binary())])
                        amounts = np.append(amounts, total)
                    for at in range(0, len(phrases), 50_000):
                        some = phrases[at : at + 50_000].cast(pa.string())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(some), pa.string()), some, pa.array(amounts[at : at + 50_000], pa.int64())], ["lang", "phrase", "n"]
                        )
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= BLOCK:
                    yield from flushed()
                    size = 0
        yield from flushed()

    return rows.mapInArrow(counts, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


def phrase_counts(rows: DataFrame, longest: int, least: int) -> DataFrame:
    """lang, words, a: all phrases of up to ``longest`` words with at least ``least`` occurrences, and each language's number of words (no words)."""
    bitmaps, out = [], None
    for length in range(1, longest + 1):
        found = pinned(level(rows, length, bitmaps).where((F.col("a") >= least) | (F.col("phrase") == "")), f"collocations-{length}")
        words = F.when(F.col("phrase") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split("phrase", " "))
        part = found.select("lang", words.alias("words"), "a")
        out = part if out is None else out.unionByName(part)
        if length < longest:
            hashed = pinned(part.where("size(words) > 0").mapInArrow(_hashed, "hash long"), "collocations-hashes")
            bitmaps.append(rows.sparkSession.sparkContext.broadcast(bitmap_of(hashed, "hash", hashed.count())))
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = []
        for lang, words in zip(batch.column("lang").to_pylist(), batch.column("words").to_pylist(), strict=True):
            one, *more = word_hashes(lang, [w.encode() for w in words])
            own = np.array([one], np.uint64)
            for word in more:
                own = extended(own, np.array([word], np.uint64))
            hashes.append(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes or [np.zeros(0, np.uint64)]).view(np.int64))], ["hash"])


def merged(stream: DataFrame, into: str, backwards: bool, share: int) -> DataFrame:
    """``stream`` (lang, words, a, covered, ...) with the array ``into``: the counts of the first 0, 1, 2 ... words of each phrase.

    With ``backwards`` it is the last words. ``covered`` becomes true where an
    extension of the phrase by one word, on the other end, has at least ``share`` in a hundred of its count.
    A count that lies before the slice is null.
    """
    names = [*stream.columns, into]
    at_lang, at_words, at_a, at_covered = (stream.columns.index(c) for c in ("lang", "words", "a", "covered"))
    schema = StructType([*stream.schema.fields, StructField(into, ArrayType(LongType()))])

    def lockstep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[str] = []  # the language and words of the last phrase
        open_: list[list | None] = []  # by number of words, the phrases on that path; None if one lies before the slice
        done: list[list] = []
        types = None

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
            done.clear()
            return batch

        for batch in batches:
            types = [*(field.type for field in batch.schema), pa.list_(pa.int64())]
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                words = row[at_words]
                key = [row[at_lang], *(reversed(words) if backwards else words)]
                same = 0
                while same < min(len(key), len(path)) and key[same] == path[same]:
                    same += 1
                done += [old for old in open_[same:] if old is not None]
                del open_[same:]
                open_ += [None] * (len(key) - 1 - len(open_))
                record = [*row, [above and above[at_a] for above in open_]]
                parent = open_[-1] if open_ else None
                if len(key) > 2 and parent is not None and 100 * row[at_a] >= share * parent[at_a]:
                    parent[at_covered] = True
                open_.append(record)
                path = key
            if len(done) >= 5000:
                yield flushed()
        done += [old for old in open_ if old is not None]
        if done:
            yield flushed()

    parts = int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("lang"), F.reverse("words") if backwards else F.col("words")]
    placed = stream.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return placed.mapInArrow(lockstep, schema)


def completed(stream: DataFrame, counts: DataFrame, into: str, backwards: bool, share: int) -> tuple[DataFrame, DataFrame]:
    """``stream`` (stored) with the counts that lay before a slice, and the phrases (lang, words) that are covered across the edge of a slice.

    For each slice these are the counts on one path: as many as a phrase has words, at most.
    """
    own = "slice(words, greatest(size(words) - {0} + 1, 1), {0})" if backwards else "slice(words, 1, {0})"
    part = lambda n: F.expr(own.format(n))
    gaps = F.expr(f"filter(sequence(0, size(words) - 1), j -> {into}[j] IS NULL)")
    # The phrase without words has no parts.
    missing = stream.where(f"size(words) > 0 AND exists({into}, x -> x IS NULL)")
    missing = missing.withColumn("edge", F.expr(f"get({into}, size(words) - 1) IS NULL"))
    wanted = missing.select("lang", "words", F.explode(gaps).alias("j")).select("lang", part("j").alias("words")).distinct()
    found = pinned(counts.join(F.broadcast(wanted), ["lang", "words"]).select("lang", "words", F.col("a").alias("known")), "collocations-edges")
    longest = stream.agg(F.max(F.size("words"))).first()[0] or 0
    full = missing
    for n in range(longest):
        edge = found.where(F.size("words") == n).select(F.col("lang").alias("e_lang"), F.col("words").alias("e_words"), "known")
        here = (F.size("words") > n) & F.expr(f"get({into}, {n}) IS NULL")
        full = full.join(F.broadcast(edge), here & (F.col("lang") == F.col("e_lang")) & (part(n) == F.col("e_words")), "left")
        filled = F.when(F.col("known").isNotNull(), F.expr(f"transform({into}, (x, j) -> if(j = {n}, known, x))"))
        full = full.withColumn(into, filled.otherwise(F.col(into))).drop("e_lang", "e_words", "known")
    frequent = 100 * F.col("a") >= share * F.expr(f"get({into}, size(words) - 1)")
    covered = full.where(F.col("edge") & (F.size("words") > 1) & frequent).select("lang", part("greatest(size(words) - 1, 0)").alias("words")).distinct()
    whole = stream.where(f"size(words) = 0 OR NOT exists({into}, x -> x IS NULL)").unionByName(full.drop("edge"))
    return whole, covered


def scored(candidates: DataFrame) -> DataFrame:
    """lang, words, a, l, r, n, score of the cut with the lowest score; whole numbers of any size."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = []
            columns = (batch.column(c).to_pylist() for c in ("a", "lefts", "rights"))
            for a, lefts, rights in zip(*columns, strict=True):
                k = len(lefts)
                cuts = ((1_000_000 * a * a // (lefts[i] * rights[k - i]), i) for i in range(1, k))
                score, i = min(cuts)
                best.append((lefts[i], rights[k - i], lefts[0], score))
            more = [pa.array(c, pa.int64()) for c in zip(*best, strict=True)] if best else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("words"), batch.column("a"), *more], ["lang", "words", "a", "l", "r", "n", "score"]
            )

    return candidates.select("lang", "words", "a", "lefts", "rights").mapInArrow(
        cut, "lang string, words array<string>, a long, l long, r long, n long, score long"
    )


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, least: int = 10, share: int = 50, first: int | None = 2000
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of 2 to ``longest`` words of each language.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends, pieces
    into words at blanks and tabs. a is the number of occurrences of the phrase, n that
    of all words. Cut in two, a phrase scores floor(1000000 * a * a / (l * r)) with the
    counts l and r of its parts; its lowest cut counts, of equal ones the first. Phrases
    with a < ``least`` are no candidates; those inside a longer candidate with at least
    ``share`` percent of their count are left out. ``first`` of each language are
    returned (all with None), by score and a descending and phrase ascending.

    Null texts count as empty, a null language as ``und``. Repeated rows count each. An
    empty table and texts without words give no rows. Other columns are not looked at.
    """
    rows = in_small_batches(docs).select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    counts = phrase_counts(rows, longest, least)
    stream = counts.withColumn("covered", F.lit(False))
    edges = []
    for into, backwards in (("lefts", False), ("rights", True)):
        stored = pinned(merged(stream, into, backwards, share), f"collocations-{into}")
        stream, covered = completed(stored, counts, into, backwards, share)
        edges.append(covered)
    # As many phrases as there are slices, at most, in each of the two orders.
    edge = F.broadcast(edges[0].unionByName(edges[1]))
    candidates = stream.where("size(words) > 1 AND NOT covered").join(edge, ["lang", "words"], "left_anti")
    best = scored(candidates).withColumn("phrase", F.array_join("words", " ")).drop("words")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    ranked = best.withColumn("rank", place)
    if first is not None:
        ranked = ranked.where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
