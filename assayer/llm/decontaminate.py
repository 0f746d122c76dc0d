"""Benchmark passages in training texts, found by spaced seeds and verified with substitutions.

A mask is laid over every place of an item and of a text; the words it selects
are hashed, the others are ignored. The masks are lossless: in any ``WINDOW``
aligned words with at most ``SUBSTITUTIONS`` changed, one of them meets only
unchanged words at some place. Texts send a place on only if its hash is in a
bitmap of all seeds (of fixed size, whatever the size of the benchmark); these
hits carry the words around them, are joined with the seeds on (mask, hash), and
each joined pair is verified word by word around the hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import id_and_text, pinned, released, unused
from assayer.llm.wordhash import NON_ALPHANUMERIC, mix, words_of
from assayer.operators.ordered import fits_broadcast

WINDOW, SUBSTITUTIONS = 13, 2
#: Lossless for 13 words with 2 substitutions (tests enumerate all of them).
MASKS = ("1110111", "11001001011")
#: Items shorter than WINDOW are compared as a whole: 7 to 12 words with one substitution, 5 and 6 words without.
SHORT_MASKS = {7: "111", 5: "11111"}
SHORTEST = 5
_BITMAP_BITS = 25

_SEEDS = "mask int, hash long, item_id {item}, place int, words array<long>"
_HITS = "doc_id {doc}, mask int, hash long, place int, first int, words array<long>"


def masks_for(n_words: int) -> list[str]:
    if n_words >= WINDOW:
        return list(MASKS)
    return [SHORT_MASKS[least] for least in sorted(SHORT_MASKS) if least <= n_words][-1:]


def allowed(window: int) -> int:
    """Substitutions allowed in so many aligned words."""
    return SUBSTITUTIONS * window // WINDOW


def seed_hashes(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the selected words for each place the mask fits."""
    n = max(0, len(hashes) - len(mask) + 1)
    out = np.full(n, len(mask), np.uint64)
    for at, selected in enumerate(mask):
        if selected == "1":
            out = mix(out + hashes[at : at + n]) if at else out + hashes[:n]
    return out


def normalised(texts: list[str]):
    """Words are runs of letters and digits, A-Z lower-cased; all bytes from 128 on count as letters."""
    return words_of(texts, NON_ALPHANUMERIC, lower=True)


def overlap(item: np.ndarray, item_place: int, text: np.ndarray, text_place: int, span: int) -> tuple[int, int, int] | None:
    """The best window around an aligned hit: (equal words, first and end place in ``text``), or None.

    A window has WINDOW words (a shorter item: all its words), holds the hit and
    differs in at most ``allowed`` places.
    """
    width = min(WINDOW, len(item))
    shift = text_place - item_place
    lo = max(0, item_place + span - width, -shift)
    hi = min(len(item) - width, item_place, len(text) - width - shift)
    if hi < lo:
        return None
    equal = item[lo : hi + width] == text[lo + shift : hi + width + shift]
    counts = np.convolve(equal, np.ones(width, np.int64), "valid")
    good = np.flatnonzero(counts >= width - allowed(width))
    if not len(good):
        return None
    return int(counts[good].max()), int(lo + good[0] + shift), int(lo + good[-1] + width + shift)


def seeds_of(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each mask and place of each item, with the words that a window around the place can reach.

    ``place`` counts from the first of these words, of which there are fewer than 2 * WINDOW, however long the item is.
    """

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = (pa.int32(), pa.int64(), batch.column(0).type, pa.int32(), pa.list_(pa.int64()))
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = normalised([text]).hashes
                words = hashes.view(np.int64)
                for mask in masks_for(len(hashes)):
                    code, out = int(mask, 2), []
                    for place, value in enumerate(seed_hashes(hashes, mask).view(np.int64).tolist()):
                        first = max(0, place + len(mask) - WINDOW)
                        out.append((code, value, item_id, place - first, words[first : place + WINDOW]))
                    columns = list(zip(*out, strict=True)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["mask", "hash", "item_id", "place", "words"])

    rows = id_and_text(items, id_col, text_col)
    return rows.mapInArrow(released(seeded), _SEEDS.format(item=rows.schema["doc_id"].dataType.simpleString()))


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """Which hashes, by their low bits, belong to a seed: 2**25 bits, 4 MB, for a benchmark of any size."""
    place = F.expr(f"hash & {(1 << _BITMAP_BITS) - 1}")
    parts = (
        seeds.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit"))
        .groupBy("part")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    out = np.zeros((1 << _BITMAP_BITS) // 8 + 4096 * 2, np.uint8)
    for row in parts.toLocalIterator():  # at most 1025 parts of 4 KB
        out[row.part * 4096 : (row.part + 1) * 4096] = np.frombuffer(bytes(row.bits), np.uint8)
    return out


def _spark_bit(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit where bitmap_construct_agg puts a value: bucket n holds the 32768 values from (n - 1) * 32768 + 1 on."""
    low = (hashes & np.uint64((1 << _BITMAP_BITS) - 1)).astype(np.int64)
    bucket = np.where(low > 0, 1 + (low - 1) // 32768, 0)
    position = np.where(low > 0, (low - 1) % 32768, 0)
    return bucket * 4096 + position // 8, (position % 8).astype(np.uint8)


def contaminations(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row for each text and benchmark item that overlap: doc_id, item_id, equal_words, first_word, end_word.

    An overlap is a window of 13 aligned words (a shorter item: all its words) of
    which at most 2 (in proportion, rounded down) differ. ``equal_words`` is the
    best count of equal words in one window; the windows lie in the words
    [first_word, end_word) of the text. Null and empty texts and items of fewer
    than 5 words match nothing. Rows that share an id are reported under it once
    for each item; null ids are reported as null. An empty table on either side
    gives no rows. Other columns are not looked at.
    """
    seeds = pinned(seeds_of(benchmark, item_id_col, item_text_col), "decontaminate-seeds")
    codes = [row.mask for row in seeds.select("mask").distinct().collect()]  # at most four masks
    masks = {int(mask, 2): mask for mask in (*MASKS, *SHORT_MASKS.values())}
    used = [(code, masks[code]) for code in sorted(codes)]
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(seeds))
    rows = id_and_text(docs, id_col, text_col)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield from _hits(batch.slice(at, 256), used, bits)

    kind = rows.schema["doc_id"].dataType.simpleString()
    # Stored, so that a task needs one Python worker, not one for finding and one for verifying: workers live on in later stages.
    found = pinned(rows.mapInArrow(released(hits), _HITS.format(doc=kind)), "decontaminate-hits")
    known = seeds.select("mask", "hash", "item_id", F.col("place").alias("item_place"), F.col("words").alias("item_words"))
    joined = found.join(F.broadcast(known) if fits_broadcast(seeds) else known, ["mask", "hash"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            column = {name: batch.column(name) for name in batch.schema.names}
            plain = {name: column[name].to_pylist() for name in ("mask", "place", "first", "item_place")}
            for i in range(batch.num_rows):
                item = column["item_words"][i].values.to_numpy(zero_copy_only=False)
                text = column["words"][i].values.to_numpy(zero_copy_only=False)
                place, first = plain["place"][i], plain["first"][i]
                best = overlap(item, plain["item_place"][i], text, place - first, len(masks[plain["mask"][i]]))
                if best:
                    out.append((i, best[0], best[1] + first, best[2] + first))
            picked = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [column["doc_id"].take(picked), column["item_id"].take(picked), *(pa.array([o[k] for o in out], pa.int32()) for k in (1, 2, 3))],
                ["doc_id", "item_id", "equal_words", "first_word", "end_word"],
            )

    item_kind = seeds.schema["item_id"].dataType.simpleString()
    checked = joined.select("mask", "place", "first", "words", "item_place", "item_words", "doc_id", "item_id").mapInArrow(
        released(verified), f"doc_id {kind}, item_id {item_kind}, equal_words int, first_word int, end_word int"
    )
    return checked.groupBy("doc_id", "item_id").agg(
        F.max("equal_words").alias("equal_words"), F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word")
    )


def _hits(batch: pa.RecordBatch, used: list[tuple[int, str]], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Places of the texts whose seed hash is in the bitmap, with the words a window around them can reach."""
    words = normalised(batch.column(1).to_pylist())
    text_of, n = words.text_of_word(), len(words.hashes)
    for code, mask in used:
        hashes = seed_hashes(words.hashes, mask)
        at_byte, at_bit = _spark_bit(hashes)
        places = np.flatnonzero(bits[at_byte] >> at_bit & 1)
        places = places[text_of[places] == text_of[places + len(mask) - 1]]
        if not len(places):
            continue
        own = text_of[places]
        first = np.maximum(places + len(mask) - WINDOW, words.firsts[own])
        end = np.minimum(places + WINDOW, words.firsts[own + 1])
        sizes = end - first
        flat = np.repeat(first - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        around = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(words.hashes.view(np.int64)[flat]))
        base = words.firsts[own]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(own)),
                pa.array(np.full(len(places), code, np.int32)),
                pa.array(hashes.view(np.int64)[places]),
                pa.array((places - base).astype(np.int32)),
                pa.array((first - base).astype(np.int32)),
                around,
            ],
            ["doc_id", "mask", "hash", "place", "first", "words"],
        )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that overlap with no benchmark item; all rows of an id go if one of them does."""
    own = unused(docs, "found_id")
    found = contaminations(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(F.col(own)), "left_anti")
