"""Passages that another text holds too, found level by level with windows of doubling length.

Level 12: of the windows of 12 words only those are looked at that winnowing
selects, at least one inside every 50 words, and the same ones wherever the same
50 words stand. Windows that more than one text holds survive. Level 25: the
survivors are extended to both sides; a shared window of 50 words around a
survivor holds one of the two. Level 50: starts within reach of a surviving
window of 25. Each level ends the work if nothing survives.

Starts of the last level come in runs, which are cut at places their words
decide. A run that a text with a smaller id holds as a whole is settled. Of equal
runs, only that of the smallest id goes on; its windows of 50 words are compared
one by one. That is enough: a window inside any other run also stands in the run
of the smallest id.

Survivors of a level are passed on as a bitmap of bounded size, so that texts
are read again instead of being shuffled; it only saves work, as the last level
compares 128-bit hashes of the windows themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.bitmap import bitmap_of, may_hold
from assayer.llm.common import id_and_text, pinned, with_class
from assayer.llm.wordhash import Words, mix, windows, words_of

WIDTH, HALF, QUARTER = 50, 25, 12
#: Texts of a batch are handled in portions of so many.
PORTION = 256
#: A null id counts as larger than all others.
NO_ID = (1 << 63) - 1
_CUT = np.uint64(15)


def _slide(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each run of ``width`` values."""
    have = 1
    while have * 2 <= width:
        values = pick(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def _whole_windows(words: Words, width: int) -> np.ndarray:
    """For each word: does a window of ``width`` words of one text start here?"""
    starts = np.zeros(len(words.hashes), np.bool_)
    text_of = words.text_of_word()
    if len(starts) >= width:
        starts[: len(starts) - width + 1] = text_of[: len(starts) - width + 1] == text_of[width - 1 :]
    return starts


def selected(words: Words, short: np.ndarray) -> np.ndarray:
    """Winnowing: the places of windows of 12 words that are the least inside some window of 50 words; ties go left."""
    reach = WIDTH - QUARTER + 1
    if len(short) < reach:
        return np.zeros(0, np.int64)
    order = (short & ~np.uint64((1 << 28) - 1)) | np.arange(len(short), dtype=np.uint64)
    least = _slide(order, reach, np.minimum)
    least[~_whole_windows(words, WIDTH)[: len(least)]] = 0
    wide = np.concatenate((np.zeros(reach - 1, np.uint64), least, np.zeros(reach - 1, np.uint64)))
    return np.flatnonzero(_slide(wide, reach, np.maximum)[: len(order)] == order)


def extensions(words: Words, short: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Starts of the windows of 25 words that begin or end with the windows of 12 words at ``places``."""
    whole = _whole_windows(words, HALF)
    right = places[whole[places]]
    left = places + QUARTER - HALF
    left = left[left >= 0]
    return np.unique(np.concatenate((right, left[whole[left]])))


def starts_within_reach(words: Words, halves: np.ndarray) -> np.ndarray:
    """For each word: does a window of 50 words start here that holds one of the windows of 25 words?"""
    steps = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(steps, np.maximum(0, halves - (WIDTH - HALF)), 1)
    np.add.at(steps, halves + 1, -1)
    return (np.cumsum(steps)[:-1] > 0) & _whole_windows(words, WIDTH)


def runs_of(words: Words, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the runs of neighbouring starts, cut where the word hash says so."""
    if not starts.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text_of = words.text_of_word()
    begins = starts.copy()
    begins[1:] &= ~starts[:-1] | (words.hashes[1:] & _CUT == 0) | (text_of[1:] != text_of[:-1])
    places = np.flatnonzero(starts)
    firsts = np.flatnonzero(begins)
    ends = np.append(places[np.searchsorted(places, firsts[1:]) - 1], places[-1]) + 1
    return firsts, ends


def run_hashes(values: np.ndarray, firsts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of the values [first, end) of each run."""
    powers = np.full(len(values) + 1, base, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    back = np.full(len(values) + 1, pow(base, -1, 1 << 64), np.uint64)
    back[0] = 1
    back = np.cumprod(back)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * powers[:-1])))
    return mix((sums[ends] - sums[firsts]) * back[firsts] + (ends - firsts).astype(np.uint64) * np.uint64(base))


def second(hashes: np.ndarray) -> np.ndarray:
    """An independent hash of the same words, for the upper 64 bits of a 128-bit hash."""
    return mix(hashes * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        for at in range(0, batch.num_rows, PORTION):
            some = batch.slice(at, PORTION)
            yield some, words_of(some.column("text").to_pylist())


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _repeated(rows: DataFrame, level: str) -> tuple[DataFrame, int]:
    """The hashes that more than one id has, stored, and their number."""
    found = rows.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    stored = pinned(found.select("hash"), f"substring-{level}")
    return stored, stored.count()


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = id_and_text(docs, id_col, text_col)
    return rows.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("text_key"), "text"
    )


_SPANS = "doc_id long, text_key long, spans array<struct<first:int,end:int>>"


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key and spans [first, end) of words that windows of 50 words cover that a smaller id holds too.

    One row for each text with such words; spans are sorted and may touch or
    overlap. text_key is Spark's xxhash64 of the text and tells texts apart that
    share an id. Ids are integers; a null id counts as larger than all others and
    is returned as 2**63 - 1. Rows that share an id take nothing from each other.
    Null, empty and short texts have no row. Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    ids = rows.select("doc_id", "text")

    def level_12(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, words in _portions(batches):
            short = windows(words.hashes, QUARTER)
            places = selected(words, short)
            owners = words.text_of_word()[places]
            yield pa.RecordBatch.from_arrays([_signed(short[places]), some.column(0).take(pa.array(owners))], ["hash", "doc_id"])

    twelve, n = _repeated(ids.mapInArrow(level_12, "hash long, doc_id long"), "12")
    if not n:
        return spark.createDataFrame([], _SPANS)
    short_map = spark.sparkContext.broadcast(bitmap_of(twelve, "hash", n))

    def survivors_25(words: Words) -> tuple[np.ndarray, np.ndarray]:
        short = windows(words.hashes, QUARTER)
        places = selected(words, short)
        starts = extensions(words, short, places[may_hold(short_map.value, short[places])])
        return starts, windows(words.hashes, HALF)[starts] if len(starts) else np.zeros(0, np.uint64)

    def level_25(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, words in _portions(batches):
            starts, hashes = survivors_25(words)
            owners = words.text_of_word()[starts]
            yield pa.RecordBatch.from_arrays([_signed(hashes), some.column(0).take(pa.array(owners))], ["hash", "doc_id"])

    twenty_five, n = _repeated(ids.mapInArrow(level_25, "hash long, doc_id long"), "25")
    if not n:
        return spark.createDataFrame([], _SPANS)
    half_map = spark.sparkContext.broadcast(bitmap_of(twenty_five, "hash", n))

    def level_50_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, words in _portions(batches):
            starts, hashes = survivors_25(words)
            within = starts_within_reach(words, starts[may_hold(half_map.value, hashes)])
            firsts, ends = runs_of(words, within)
            full = windows(words.hashes, WIDTH)
            owners = words.text_of_word()[firsts]
            base = words.firsts[owners]
            yield pa.RecordBatch.from_arrays(
                [
                    _signed(run_hashes(full, firsts, ends, 0x9E3779B97F4A7C15)),
                    _signed(run_hashes(second(full), firsts, ends, 0xD6E8FEB86659FD93)),
                    some.column(0).take(pa.array(owners)),
                    some.column(1).take(pa.array(owners)),
                    pa.array((firsts - base).astype(np.int32)),
                    pa.array((ends - base).astype(np.int32)),
                ],
                ["hash", "hash2", "doc_id", "text_key", "first", "end"],
            )

    runs = pinned(rows.mapInArrow(level_50_runs, "hash long, hash2 long, doc_id long, text_key long, first int, end int"), "substring-runs")
    settled = pinned(with_class(runs, ["hash", "hash2"], "doc_id", "least").drop("hash", "hash2"), "substring-settled")
    spans = settled.where("doc_id > least").select("doc_id", "text_key", "first", (F.col("end") + (WIDTH - 1)).alias("end"))

    open_runs = settled.where("doc_id = least").groupBy("doc_id", "text_key").agg(_list("first", "end").alias("spans"))
    texts = joined_texts(rows, pinned(open_runs, "substring-open"))

    def level_50(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, words in _portions(batches):
            full = windows(words.hashes, WIDTH)
            lists = some.column("spans").to_pylist()
            places = [np.arange(s["first"], s["end"]) + words.firsts[i] for i, runs in enumerate(lists) for s in runs]
            at = np.unique(np.concatenate([np.zeros(0, np.int64), *places]))
            owners = words.text_of_word()[at]
            yield pa.RecordBatch.from_arrays(
                [
                    _signed(full[at]),
                    _signed(second(full[at])),
                    some.column("doc_id").take(pa.array(owners)),
                    some.column("text_key").take(pa.array(owners)),
                    pa.array((at - words.firsts[owners]).astype(np.int32)),
                ],
                ["hash", "hash2", "doc_id", "text_key", "first"],
            )

    single = pinned(texts.mapInArrow(level_50, "hash long, hash2 long, doc_id long, text_key long, first int"), "substring-single")
    later = with_class(single, ["hash", "hash2"], "doc_id", "least", repeated_only=True).where("doc_id > least")
    more = later.select("doc_id", "text_key", "first", (F.col("first") + WIDTH).alias("end"))
    return spans.unionByName(more).groupBy("doc_id", "text_key").agg(_list("first", "end").alias("spans"))


def _list(first: str, end: str):
    """Spans of one text, sorted: as many as the text has words at most."""
    return F.sort_array(F.collect_list(F.struct(F.col(first).alias("first"), F.col(end).alias("end"))))


def joined_texts(rows: DataFrame, stored: DataFrame, how: str = "inner") -> DataFrame:
    """The rows whose (doc_id, text_key) is in ``stored``, with its columns; only texts that a bitmap lets through are shuffled."""
    bitmap = rows.sparkSession.sparkContext.broadcast(bitmap_of(stored, "text_key", stored.count()))

    def let_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(bitmap.value, _keys(batch))))

    return rows.mapInArrow(let_through, rows.schema).join(stored, ["doc_id", "text_key"], how)


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("text_key").to_numpy(zero_copy_only=False)


_KEPT = "doc_id long, n_words long, n_removed long, text string"


def kept_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed and text, the words that stay, joined by one blank.

    What goes is what ``repeated_spans`` covers. Texts without such words keep all
    of them; null and empty texts have none.
    """
    rows = keyed(docs, id_col, text_col)
    spans = pinned(repeated_spans(docs, id_col, text_col), "substring-spans")
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(spans, "text_key", spans.count()))

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.filter(pa.array(~may_hold(bitmap.value, _keys(batch))))
            for at in range(0, rest.num_rows, PORTION):
                part = rest.slice(at, PORTION)
                yield _kept(part, [None] * part.num_rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PORTION):
                part = batch.slice(at, PORTION)
                yield _kept(part, part.column("spans").to_pylist())

    some = joined_texts(rows, spans, "left").mapInArrow(cut, _KEPT)
    out = rows.mapInArrow(untouched, _KEPT).unionByName(some)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def _kept(part: pa.RecordBatch, spans: list) -> pa.RecordBatch:
    done = [_without(text, own) for text, own in zip(part.column("text").to_pylist(), spans, strict=True)]
    counts = (pa.array([d[k] for d in done], pa.int64()) for k in (0, 1))
    return pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, pa.array([d[2] for d in done], pa.string())], ["doc_id", "n_words", "n_removed", "text"])


def _without(text: str, spans: list[dict] | None) -> tuple[int, int, str]:
    words = text.encode("utf-8").split()  # bytes: splits at the six ASCII white space bytes only
    n = len(words)
    if spans:
        stays = np.ones(n, np.bool_)
        for span in spans:
            stays[span["first"] : span["end"]] = False
        words = [words[i] for i in np.flatnonzero(stays)]
    return n, n - len(words), b" ".join(words).decode("utf-8")
