"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its words (white space separates them, A-Z lower-cased) and an end. A
frequent word, the end and the escape are symbols of one prefix code, the bytes
of other words and the end of a word symbols of a second one. Every symbol is a
path of bits through its code tree, and a bit is predicted from its node under
several contexts: each context is hashed together with the node to a slot that
holds how often the training texts went either way there. Three levels of a tree
share one hash and stand side by side, so that a look-up serves three bits.

The predictions (as log odds) are mixed by weights. Which weights is gated by
how well the contexts are known; on top of them every text adapts its own
correction, online, by the gradient of what it has seen so far. A last stage
refines the mixed log odds by interval, again adapted along the text.

Slots are sums over all training texts: every task counts into tables of a fixed
size, and the tables are added up in groups of bounded size. Weights are fitted
on all training texts, in groups that a hash of the text makes: each distinct
text counts as often as it occurs, and the bits of all its copies are taken out
of the slots. The weights of the groups are averaged by what each has seen.

The loops over words and bits run compiled in the JVM (kernel.py), where there is one
in reach; the numpy code of each step does the same, only much slower.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import in_small_batches, pinned, release
from assayer.llm.kernel import Counts, Kernel, kernel_of
from assayer.llm.wordhash import Words, byte_hashes, mix, words_of


@dataclass(frozen=True)
class Size:
    """Bounds of the model: words with a symbol of their own and their least count (so that the training
    texts hold words to be spelled), words whose count every task knows, slots, texts and bytes fitted in one group."""

    words: int = 65_534
    least_count: int = 3
    counted: int = 1_000_000
    slot_bits: int = 20
    fit_texts: int = 1_200
    fit_bytes: int = 6_000_000


CONTEXTS, LEVELS = 4, 3
GATES = 9
#: So many of the most frequent words count as very common.
COMMON = 128
#: Portions of texts and chunks of symbols handled at once, bits between two adaptations, tables added at once.
PORTION_BYTES, CHUNK, BLOCK, ADDED = 400_000, 150_000, 1024, 32
#: The first adaptations of a text, after so many bits.
STEPS = np.array([32, 64, 128, 256, 512, BLOCK])
INTERVALS = 32
#: Counts from which on a slot is known, and well known.
KNOWN = (3, 60)
END = 0x0E0D0E0D0E0D0E0D
_U, _U32 = np.uint64, np.uint32


class Code:
    """A prefix code: for symbol s the nodes and bits [first[s], first[s + 1])."""

    def __init__(self, counts: list[int]):
        heap = [(max(1, c), i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        parent, side, n = {}, {}, len(counts)
        while len(heap) > 1:
            (c0, a), (c1, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[a] = parent[b] = n
            side[a], side[b] = 0, 1
            heapq.heappush(heap, (c0 + c1, n))
            n += 1
        nodes, places, bits, sizes = [], [], [], []
        for symbol in range(len(counts)):
            path, at = [], symbol
            while at in parent:
                path.append((parent[at], side[at]))
                at = parent[at]
            path.reverse()
            sizes.append(len(path))
            place = 1
            for depth, (_, bit) in enumerate(path):
                place = 1 if depth % LEVELS == 0 else 2 * place + path[depth - 1][1]
                nodes.append(path[depth - depth % LEVELS][0])
                places.append(place)
                bits.append(bit)
        #: Of LEVELS levels the uppermost node, by a 32-bit hash, and the place below it: their slots are side by side.
        self.nodes = (mix(np.array(nodes, np.uint64) + _U(1)) >> _U(32)).astype(np.uint32)
        self.places = np.array(places, np.uint8)
        self.bits = np.array(bits, np.uint8)
        self.sizes = np.array(sizes, np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))


@dataclass
class Corpus:
    """What the words of the training texts say: totals, the counted words by hash, the symbols, both codes."""

    tokens: int
    distinct: int
    hashes: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    words: Code
    letters: Code

    def __post_init__(self) -> None:
        #: Where the hashes with the same first bits begin; there is about one word for each beginning.
        self.shift = np.uint64(64 - min(20, max(1, len(self.hashes).bit_length())))
        self.begins = np.searchsorted(self.hashes >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Where the hashes stand among the counted words, -1 for others."""
        out = np.full(len(hashes), -1, np.int64)
        beginning = (hashes >> self.shift).astype(np.intp)
        at, end = self.begins.take(beginning), self.begins.take(beginning + 1)
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            same = self.hashes.take(here) == hashes[left]
            out[left[same]] = here[same]
            at[left] += 1
            left = left[~same & (here + 1 < end[left])]
        return out


@dataclass
class Stream:
    """Symbols in order: text, symbol, context hashes (one row for each context)."""

    code: Code
    owner: np.ndarray
    symbol: np.ndarray
    contexts: list[np.ndarray]


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Texts in portions of about PORTION_BYTES, a longer text alone."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= PORTION_BYTES):
                size += len(texts[to])
                to += 1
            yield batch.slice(at, to - at), words_of(texts[at:to], lower=True)
            at = to


def _with_ends(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end behind each text, the text and the word (-1: end) of each token."""
    texts = len(words.firsts) - 1
    owner = words.text_of_word()
    place = np.arange(len(owner)) + owner
    ends = words.firsts[1:] + np.arange(texts)
    hashes = np.full(len(owner) + texts, END, np.uint64)
    hashes[place] = words.hashes
    word = np.full(len(hashes), -1, np.int64)
    word[place] = np.arange(len(owner))
    owners = np.empty(len(hashes), np.int64)
    owners[place], owners[ends] = owner, np.arange(texts)
    return hashes, owners, word


def streams(words: Words, corpus: Corpus, tokens: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[Stream, Stream]:
    """The symbols of the texts of a portion and the contexts they stand in."""
    hashes, owner, word = tokens
    at = corpus.place(hashes)
    symbol = np.where(at >= 0, corpus.symbols[at] if len(corpus.symbols) else 0, 1)  # symbol 1 is the escape, 0 the end
    symbol[word < 0] = 0

    def earlier(values: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(values)
        out[by:] = values[:-by]
        out[by:][owner[by:] != owner[:-by]] = 0
        return out

    one, two = earlier(hashes, 1), earlier(hashes, 2)
    # The last very common word tells the language.
    is_common = (symbol > 1) & (symbol < COMMON + 2)
    last = np.maximum.accumulate(np.where(is_common, np.arange(len(symbol)), -1))
    before = np.concatenate(([-1], last[:-1]))
    before[np.concatenate(([True], owner[1:] != owner[:-1]))] = -1
    language = np.where((before >= 0) & (owner[before] == owner), symbol[before], 0).astype(np.uint64)
    known_one = np.where(earlier(symbol, 1) > 1, one, _U(1))
    contexts = [np.zeros(len(symbol), np.uint64), mix(language + _U(1 << 40)), mix(known_one * _U(3)), mix(mix(one) + two)]
    whole = Stream(corpus.words, owner, symbol, [(c >> _U(32)).astype(np.uint32) for c in contexts])

    # Escaped words, byte by byte; 256 ends a word.
    spelled = np.flatnonzero(symbol == 1)
    of = word[spelled]
    sizes = words.ends[of] - words.starts[of] + 1
    total = int(sizes.sum())
    begin = np.cumsum(sizes) - sizes
    flat = np.arange(total) - np.repeat(begin, sizes)
    raw = np.frombuffer(words.data, np.uint8)
    letter = raw[np.minimum(np.repeat(words.starts[of], sizes) + flat, len(raw) - 1)].astype(np.int64)
    letter[(letter >= 65) & (letter <= 90)] += 32
    letter[begin + sizes - 1] = 256

    def back(by: int) -> np.ndarray:
        out = np.zeros(total, np.uint64)
        out[by:] = letter[:-by] if by < total else 0
        out[flat < by] = 300
        return out

    c1 = back(1)
    c2 = c1 + (back(2) << _U(9))
    c3 = c2 + (back(3) << _U(18))
    c5 = c3 + (back(4) << _U(27)) + (back(5) << _U(36))
    tongue = np.repeat(language[spelled], sizes) << _U(48)
    spelling = Stream(corpus.letters, np.repeat(owner[spelled], sizes), letter, [(mix(c) >> _U(32)).astype(np.uint32) for c in (c1 + tongue, c2 + tongue, c3, c5)])
    return whole, spelling


def expanded(stream: Stream, part: slice | np.ndarray, slot_bits: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Bits, slots for each context and the owning text of all bits of the symbols of ``part``."""
    symbol = stream.symbol[part]
    sizes = stream.code.sizes[symbol]
    total = int(sizes.sum())
    at = np.arange(total) + np.repeat(stream.code.first[symbol] - (np.cumsum(sizes) - sizes), sizes)
    node, place = stream.code.nodes.take(at), stream.code.places.take(at)
    shift = _U32(32 - slot_bits)
    slots = [(((np.repeat(c[part], sizes) ^ node) * _U32(0x9E3779B1) >> shift) ^ place).astype(np.intp) for c in stream.contexts]
    return stream.code.bits.take(at), slots, np.repeat(stream.owner[part], sizes)


@dataclass
class Slots:
    """For each stream and context: the log odds of every slot and how well it is known (0, 1, 2)."""

    odds: np.ndarray | None  # stream, context, slot
    known: np.ndarray | None
    counts: np.ndarray | None  # stream, context, slot, bit

    @classmethod
    def of(cls, counts: np.ndarray) -> Slots:
        odds, known = np.empty(counts.shape[:3], np.float16), np.empty(counts.shape[:3], np.int8)
        for place in np.ndindex(counts.shape[:2]):
            zero, one = counts[place][:, 0].astype(np.float32), counts[place][:, 1].astype(np.float32)
            odds[place] = np.log((one + 0.3) / (zero + 0.3))
            known[place] = np.digitize(zero + one, KNOWN)
        return cls(odds, known, counts)


@dataclass
class Weights:
    """For each stream: weights by gate, and the refinement of each interval by gate."""

    mixing: np.ndarray
    refining: np.ndarray

    @classmethod
    def first(cls) -> Weights:
        return cls(np.full((2, GATES, CONTEXTS + 1), 0.35, np.float32), np.zeros((2, GATES * INTERVALS), np.float32))


def block_of(bit: np.ndarray) -> np.ndarray:
    """The block a bit of a text falls in: blocks end after STEPS bits, then every BLOCK bits, so that short texts adapt too."""
    return np.where(bit < BLOCK, np.searchsorted(STEPS, bit, "right"), len(STEPS) - 1 + bit // BLOCK)


class Scorer:
    """Total bits of each text of a portion; with ``fit`` the weights move along and own bits are taken out of the slots,
    those of all ``copies`` of a text."""

    #: Of the fitted weights in one pass after the other, of a text's own correction, of its own refinement.
    RATES, OWN_RATE, REFINE_RATE = (0.01, 0.003), 0.0015, 0.3

    def __init__(self, corpus: Corpus, slots: Slots, weights: Weights, slot_bits: int, fit: bool = False):
        self.corpus, self.slots, self.weights, self.slot_bits, self.fit = corpus, slots, weights, slot_bits, fit
        self.rate = self.RATES[0]
        self.copies = np.zeros(0)
        #: How many bits, times copies, moved the weights of each gate and the refinement of each interval.
        self.seen, self.seen_refining = np.zeros((2, GATES)), np.zeros((2, GATES * INTERVALS))

    def cost(self, words: Words, tokens: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        texts = len(words.firsts) - 1
        cost = np.zeros(texts)
        for kind, stream in enumerate(streams(words, self.corpus, tokens)):
            own = np.zeros((texts, CONTEXTS + 1), np.float32)
            own_refining = np.zeros((texts, INTERVALS), np.float32)
            bits = stream.code.sizes[stream.symbol]
            # Blocks of about BLOCK bits of a text; all texts go on together from block to block.
            sums = np.cumsum(bits) - bits
            if not len(sums):
                continue
            begins = np.flatnonzero(np.concatenate(([True], stream.owner[1:] != stream.owner[:-1])))
            block = block_of(sums - np.repeat(sums[begins], np.diff(np.append(begins, len(sums)))))
            order = np.argsort(block, kind="stable")
            edges = np.searchsorted(block[order], np.arange(int(block.max()) + 2))
            at = 0
            while at < len(edges) - 1:  # several blocks are expanded at once, and mixed one after the other
                to = at + 1
                while to < len(edges) - 1 and edges[to + 1] - edges[at] <= CHUNK:
                    to += 1
                part = order[edges[at] : edges[to]]
                taken = np.concatenate(([0], np.cumsum(bits[part])))
                self._blocks(kind, expanded(stream, part, self.slot_bits), taken[edges[at : to + 1] - edges[at]], own, own_refining, cost)
                at = to
        return cost

    def _blocks(self, kind: int, data: tuple, cuts: np.ndarray, own: np.ndarray, own_refining: np.ndarray, cost: np.ndarray) -> None:
        bits, slots, owner = data
        n = len(bits)
        inputs = np.empty((CONTEXTS + 1, n), np.float32)
        known = []
        if self.fit:
            copies = self.copies.take(owner)
            own_bits = np.stack((copies * (bits == 0), copies * (bits == 1)), axis=1)
        for k, slot in enumerate(slots):
            if self.fit:  # without the bit itself, in all copies
                left = np.maximum(self.slots.counts[kind, k].take(slot, axis=0) - own_bits, 0)
                inputs[k] = np.log((left[:, 1] + 0.3) / (left[:, 0] + 0.3))
                if k > 1:
                    total = left[:, 0] + left[:, 1]
                    known.append((total >= KNOWN[0]).astype(np.intp) + (total >= KNOWN[1]))
            else:
                inputs[k] = self.slots.odds[kind, k].take(slot)
                if k > 1:
                    known.append(self.slots.known[kind, k].take(slot))
        inputs[CONTEXTS] = 0.3
        gate = (known[0] * 3 + known[1]).astype(np.intp)
        sign = bits.astype(np.float32) * 2 - 1
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            x, g, s = inputs[:, a:b], gate[a:b], sign[a:b]
            starts = np.concatenate(([0], np.flatnonzero(owner[a + 1 : b] != owner[a : b - 1]) + 1))
            who, sizes = owner[a:b][starts], np.diff(np.append(starts, b - a))
            # The weights of every text and gate side by side: one look-up for each input.
            row = np.repeat(np.arange(len(who), dtype=np.intp) * GATES, sizes) + g
            mixed = np.zeros(b - a, np.float32)
            for k in range(CONTEXTS + 1):
                table = own[who, k][:, None] + self.weights.mixing[kind][:, k]
                mixed += table.ravel().take(row) * x[k]
            np.clip(mixed, -14, 14, out=mixed)
            interval = np.clip((mixed + 8) * 2, 0, INTERVALS - 1).astype(np.intp)
            where = g * INTERVALS + interval
            place = np.repeat(who * INTERVALS, sizes) + interval
            refined = mixed + self.weights.refining[kind].take(where) + own_refining.ravel().take(place)
            against = np.exp(-s * refined)
            cost[who] += np.add.reduceat(np.log1p(against), starts)
            missed = s * against / (1 + against)
            own[who] += self.OWN_RATE * np.stack([np.add.reduceat(missed * x[k], starts) for k in range(CONTEXTS + 1)], axis=1)
            seen = np.bincount(place, minlength=own_refining.size)
            own_refining += (self.REFINE_RATE * np.bincount(place, missed, own_refining.size) / (8 + seen)).reshape(own_refining.shape)
            if self.fit:  # mean gradients over bits and copies, as far as the bits of a block carry
                w = copies[a:b]
                missed = missed * w
                seen, weight = np.bincount(g, minlength=GATES), np.bincount(g, w, GATES)
                for k in range(CONTEXTS + 1):
                    mean = np.bincount(g, missed * x[k], GATES) / np.maximum(weight, 1)
                    self.weights.mixing[kind][:, k] += self.rate * mean * seen / np.sqrt(1 + seen)
                self.seen[kind] += weight
                seen, weight = np.bincount(where, minlength=GATES * INTERVALS), np.bincount(where, w, GATES * INTERVALS)
                mean = np.bincount(where, missed, GATES * INTERVALS) / np.maximum(weight, 1)
                self.weights.refining[kind] += 0.05 * mean * seen / (4 + seen)
                self.seen_refining[kind] += weight


def arrays_of(corpus: Corpus, size: Size) -> list[np.ndarray]:
    """A corpus as MixingKernel.java reads it."""
    base, values = byte_hashes(lower=True)
    numbers = [base, END, int(corpus.shift), COMMON, size.slot_bits, BLOCK, PORTION_BYTES, *KNOWN]
    codes = [part for code in (corpus.words, corpus.letters) for part in levels_of(code)]
    return [
        np.array(numbers, np.uint64).view(np.int64), values.view(np.int64), corpus.hashes.view(np.int64), corpus.begins, corpus.symbols.astype(np.int32),
        np.log10(corpus.counts + 1.0), STEPS.astype(np.int64), np.array([Scorer.OWN_RATE, Scorer.REFINE_RATE]), *codes,
    ]


def levels_of(code: Code) -> tuple[np.ndarray, np.ndarray]:
    """For every LEVELS levels of a symbol the node's hash, and their number with four bits for each: place and bit; where symbols begin."""
    groups = -(-code.sizes // LEVELS)
    begins = np.concatenate(([0], np.cumsum(groups)))
    inside = np.arange(begins[-1]) - np.repeat(begins[:-1], groups)
    at = np.repeat(code.first[:-1], groups) + LEVELS * inside
    number = np.minimum(np.repeat(code.sizes, groups) - LEVELS * inside, LEVELS)
    out = np.zeros((len(at), 2), np.int32)
    out[:, 0], out[:, 1] = code.nodes.view(np.int32)[at], number
    for level in range(LEVELS):
        here = np.minimum(at + level, len(code.bits) - 1)
        out[:, 1] |= np.where(level < number, code.places[here].astype(np.int32) * 2 + code.bits[here], 0) << (2 + 4 * level)
    return out.ravel(), (2 * begins).astype(np.int32)


def with_margin(values: np.ndarray) -> np.ndarray:
    """The table of a stream, behind the unused numbers that MixingKernel.java calls MARGIN."""
    return np.concatenate((np.zeros(12, np.int32), values.ravel()))


def packed(slots: Slots) -> Iterator[np.ndarray]:
    """For each stream the log odds as floats, with how well they are known in the last two bits, which halves leave empty."""
    return (with_margin(odds.astype(np.float32).view(np.int32) | known) for odds, known in zip(slots.odds, slots.known, strict=True))


def nothing_learned(size: Size) -> Corpus:
    none = np.zeros(0, np.int64)
    return Corpus(0, 0, none.view(np.uint64), none, none, Code([1, 1]), Code([1] * 257))


def bytes_of(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns, F.col("text").cast("binary").alias("text"))


def rows_of(docs: DataFrame, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    return in_small_batches(docs).select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held")
    )


def learned_counts(rows: DataFrame, size: Size, kernel: Kernel | None) -> tuple[DataFrame, np.ndarray]:
    """The count of every token of the training texts by its hash (stored), and how often each byte occurs in them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = [], []
        letters, size = np.zeros(256, np.int64), 0

        def flush() -> pa.RecordBatch:
            values, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
            sums = np.bincount(inverse, np.concatenate(counts), len(values)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(sums), pa.array(np.full(len(values), -1))], ["hash", "n", "letter"])

        for _, words in portions(batches):
            tokens = _with_ends(words)[0]
            values, n = np.unique(tokens, return_counts=True)
            hashes.append(values)
            counts.append(n)
            letters += np.bincount(np.frombuffer(words.data.lower(), np.uint8), minlength=256)
            size += len(values)
            if size > 3_000_000:
                yield flush()
                hashes, counts, size = [], [], 0
        if hashes:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(256, np.int64)), pa.array(letters), pa.array(np.arange(256))], ["hash", "n", "letter"])

    if kernel:
        found = kernel.mapped(bytes_of(rows.where("not held")), kernel.object.counting(kernel.arrays(arrays_of(nothing_learned(size), size))), "hash long, n long, letter long")
    else:
        found = rows.where("not held").select("text").mapInArrow(counted, "hash long, n long, letter long")
    stored = pinned(found.groupBy("letter", "hash").agg(F.sum("n").alias("n")), "mixing-counts")
    letters = np.zeros(256, np.int64)
    for row in stored.where("letter >= 0").collect():  # 256 rows
        letters[row.letter] = row.n
    return stored.where("letter < 0").select("hash", "n"), letters


def learned_corpus(counts: DataFrame, letters: np.ndarray, size: Size) -> Corpus:
    """Totals over all counts; the ``size.counted`` most frequent words by hash, at most 16 bytes each."""
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("distinct")).first()
    ends = counts.where(F.col("hash") == END).first()
    words = counts.where(F.col("hash") != END)
    # The least count that lets at most `counted` words in: a histogram of counts decides, not a sort of all words.
    spread = words.groupBy(F.least("n", F.lit(100_000)).alias("c")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("c")).collect()
    least, sum_words = 1, 0
    for row in spread:  # at most 100,000 rows
        sum_words += row.words
        if sum_words > size.counted:
            least = row.c + 1
            break
    top = words.where(F.col("n") >= least).toArrow()
    hashes, n = top["hash"].to_numpy().view(np.uint64), top["n"].to_numpy()
    by_count = np.lexsort((hashes, -n))
    symbol_of = np.ones(len(hashes), np.int64)
    best = by_count[: min(size.words, int((n >= size.least_count).sum()))]
    symbol_of[best] = np.arange(len(best)) + 2
    escaped = int(totals.tokens - n[best].sum() - (ends.n if ends else 0))
    code = Code([ends.n if ends else 1, max(1, escaped), *n[best].tolist()])
    letter_counts = [*letters.tolist(), int(letters[32] + letters[10])]
    order = np.argsort(hashes)
    return Corpus(
        totals.tokens, totals.distinct, hashes[order], n[order], symbol_of[order], code, Code(letter_counts)
    )


def learned_slots(rows: DataFrame, corpus, size: Size, kernel: Kernel | None) -> np.ndarray:
    """How often the bits of all training texts went either way in each slot: stream, context, slot, bit."""
    cells = 1 << size.slot_bits
    shape = (2, CONTEXTS, cells, 2)
    pieces = 2 * CONTEXTS * 4

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = corpus.value
        table = np.zeros((2, CONTEXTS, cells * 2), np.uint32)
        for _, words in portions(batches):
            for kind, stream in enumerate(streams(words, own, _with_ends(words))):
                for at in range(0, len(stream.symbol), CHUNK):
                    bits, slots, _ = expanded(stream, slice(at, at + CHUNK), size.slot_bits)
                    for k, slot in enumerate(slots):
                        np.add.at(table[kind, k], slot * 2 + bits, np.uint32(1))
        task = TaskContext.get().partitionId()
        for piece, values in enumerate(table.reshape(pieces, -1)):
            yield _piece(piece, task, values.astype(np.float32))

    if kernel:
        tables = kernel.mapped(bytes_of(rows.where("not held")), kernel.object.counting_slots(corpus, pieces), "piece int, task long, counts binary")
    else:
        tables = rows.where("not held").select("text").mapInArrow(counted, "piece int, task long, counts binary")
    return _added(tables, pieces, kernel).reshape(shape)


def _piece(piece: int, task: int, values: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array([piece], pa.int32()), pa.array([task], pa.int64()), pa.array([values.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["piece", "task", "counts"])


def _added(tables: DataFrame, pieces: int, kernel: Kernel | None) -> np.ndarray:
    """The sum of all tables, piece by piece, at most ADDED pieces of one place at a time; the result has a fixed size."""

    def add(table: pa.Table) -> pa.Table:
        total = None
        for value in table.column("counts"):
            one = np.frombuffer(value.as_buffer(), np.float32)
            total = one.copy() if total is None else np.add(total, one, out=total)
        arrays = [table.column("piece")[:1], table.column("part")[:1].cast(pa.int64()), pa.array([total.tobytes()], pa.binary())]
        return pa.table(arrays, ["piece", "task", "counts"])

    while True:
        grouped = tables.withColumn("part", F.floor(F.col("task") / ADDED).cast("long")).select("piece", "part", "counts")
        kind = "piece int, task long, counts binary"
        sums = kernel.mapped(grouped.repartition("piece", "part"), kernel.object.adding(), kind) if kernel else grouped.groupBy("piece", "part").applyInArrow(add, kind)
        tables = pinned(sums, "mixing-tables")
        if tables.count() <= pieces:
            break
    out = np.zeros((pieces, 0), np.float32)
    for row in tables.toLocalIterator():  # one after the other, as they stand side by side at once in the result
        if not out.size:
            out = np.zeros((pieces, len(row.counts) // 4), np.float32)
        out[row.piece] = np.frombuffer(row.counts, np.float32)
    return out.ravel()


def fitted_weights(rows: DataFrame, corpus, slots, size: Size, kernel: Kernel | None) -> Weights:
    """The mean weights of groups of about ``size.fit_texts`` texts or ``size.fit_bytes``, after online passes over all texts of each.

    The groups are made by a hash of the text and hold all training texts, equal ones once with the number of their copies.
    """
    distinct = rows.where("not held").groupBy("key", "text").agg(F.count(F.lit(1)).alias("copies"))
    distinct = pinned(distinct, "mixing-distinct")
    whole = distinct.agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    groups = max(1, -(-whole.texts // size.fit_texts), -(-whole.bytes // size.fit_bytes))

    def fit(table: pa.Table) -> pa.Table:
        scorer = Scorer(corpus.value, slots.value, Weights.first(), size.slot_bits, fit=True)
        table = table.sort_by([("key", "ascending"), ("text", "ascending")])
        for scorer.rate in Scorer.RATES:
            for some, words in portions(iter(table.to_batches())):
                scorer.copies = some.column("copies").to_numpy().astype(np.float32)
                scorer.cost(words, _with_ends(words))
        w = scorer.weights
        values = np.concatenate((w.mixing.ravel(), w.refining.ravel())).astype(np.float64)
        seen = np.concatenate((np.repeat(scorer.seen.ravel(), CONTEXTS + 1), scorer.seen_refining.ravel()))
        return pa.table([pa.array(np.arange(len(values))), pa.array(values * seen), pa.array(seen)], ["place", "value", "seen"])

    out, dealt = Weights.first(), distinct.withColumn("chunk", F.pmod("key", F.lit(groups)).cast("long"))
    if kernel:
        first = kernel.arrays([out.mixing.ravel(), out.refining.ravel(), np.array(Scorer.RATES)])
        dealt = dealt.repartition("chunk").sortWithinPartitions("chunk", "key", "text")
        grouped = kernel.mapped(dealt.select("chunk", F.col("text").cast("binary"), "copies"), kernel.object.fitting(corpus, slots, first), "place long, value double, seen double")
    else:
        grouped = dealt.groupBy("chunk").applyInArrow(fit, "place long, value double, seen double")
    flat = np.concatenate((out.mixing.ravel(), out.refining.ravel()))
    for row in grouped.groupBy("place").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen")).where("seen > 0").collect():  # as many rows as weights
        flat[row.place] = row.value / row.seen
    return Weights(flat[: out.mixing.size].reshape(out.mixing.shape).copy(), flat[out.mixing.size :].reshape(out.refining.shape).copy())


def scored(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", size: Size = Size()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Learns from the rows that are not ``held_out`` (null: not held out) and scores
    all. Null and empty texts are just an end. base_score sums
    log10((c + 1) / (N + V + 1)) over tokens, score is the model's log10
    probability of the same tokens. Repeated rows are scored each and, if they
    train, counted each; null ids stay null. An empty table gives no rows; without
    training rows all slots are empty. Other columns are not looked at.
    """
    kernel, context = kernel_of(docs.sparkSession), docs.sparkSession.sparkContext
    rows = rows_of(docs, held_out, id_col, text_col).withColumn("key", F.xxhash64("text"))
    counts, letters = learned_counts(rows, size, kernel)
    corpus = learned_corpus(counts, letters, size)
    # At most size.counted words of 24 bytes, and two codes.
    shared = kernel.broadcast(arrays_of(corpus, size)) if kernel else context.broadcast(corpus)
    log_all, train_tokens = math.log10(corpus.tokens + corpus.distinct + 1), corpus.tokens
    del corpus
    release()  # the driver, too, holds little beside the slots
    table = learned_slots(rows, shared, size, kernel)
    if not len(table):
        table = np.zeros((2, CONTEXTS, 1 << size.slot_bits, 2), np.float32)
    # Both have a fixed size: 64 and 24 MB (32 MB for the kernel) with 20 slot bits.
    made = Slots.of(table)
    full = kernel.written(map(Counts, table)) if kernel else context.broadcast(Slots(None, None, table))
    made.counts = table = None
    release()
    if kernel:  # only now, when the driver's Python has let go of it
        full = context._jsc.broadcast(kernel.read(full))
    weights = fitted_weights(rows, shared, full, size, kernel)
    full.destroy()
    slots = kernel.written(packed(made)) if kernel else context.broadcast(Slots(made.odds, made.known, None))
    del made
    release()
    if kernel:
        slots = context._jsc.broadcast(kernel.read(slots))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        scorer = Scorer(own, slots.value, weights, size.slot_bits)
        logs = np.log10(own.counts + 1.0)
        end_count = float(end)
        for some, words in portions(batches):
            tokens = _with_ends(words)
            hashes, owner, word = tokens
            texts = some.num_rows
            at = own.place(hashes)
            found = at >= 0
            value = np.where(found, logs[at] if len(logs) else 0.0, 0.0)
            value[word < 0] = math.log10(end_count + 1)
            rest = np.bincount(owner[~found & (word >= 0)], minlength=texts)
            n = np.bincount(owner, minlength=texts)
            bits = scorer.cost(words, tokens) / math.log(2)
            yield pa.RecordBatch.from_arrays(
                [
                    some.column("doc_id"), some.column("held"), some.column("key"), pa.array(n.astype(np.int64)),
                    pa.array(n - rest - (end_count == 0)), pa.array(rest.astype(np.int64)),
                    pa.array(np.bincount(owner, value, texts)), pa.array(bits), pa.array(_bytes(words)),
                ],
                ["doc_id", "held_out", "key", "n_tokens", "n_top", "n_rest", "top_logs", "bits", "n_bytes"],
            )

    end = next((row.n for row in counts.where(F.col("hash") == END).collect()), 0)
    kind = rows.schema["doc_id"].dataType.simpleString()
    ids = f"doc_id {kind}, held_out boolean, key long, n_tokens long, n_top long, n_rest long, top_logs double, bits double, n_bytes long"
    if kernel:
        learned = kernel.arrays([weights.mixing.ravel(), weights.refining.ravel(), np.array([float(end)])])
        out = kernel.mapped(bytes_of(rows, "doc_id", "held", "key"), kernel.object.scoring(shared, slots, learned), ids)
    else:
        out = rows.mapInArrow(score, ids)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for some, words in portions(batches):
            owner = words.text_of_word()
            out = own.place(words.hashes) < 0
            pairs = np.stack((owner[out].astype(np.uint64), words.hashes[out]))
            order = np.lexsort((pairs[1], pairs[0]))
            pairs = pairs[:, order]
            new = np.concatenate(([True], (pairs[:, 1:] != pairs[:, :-1]).any(0))) if pairs.shape[1] else np.zeros(0, np.bool_)
            first = np.flatnonzero(new)
            freq = np.diff(np.append(first, pairs.shape[1]))
            who = pa.array(pairs[0][first].astype(np.int64))
            yield pa.RecordBatch.from_arrays([some.column("doc_id").take(who), some.column("key").take(who), pa.array(pairs[1][first].view(np.int64)), pa.array(freq)], ["r_id", "r_key", "hash", "freq"])

    # Words that tasks don't know: their counts come by a join, and are added up for each text.
    pairs = f"r_id {kind}, r_key long, hash long, freq long"
    rest = kernel.mapped(bytes_of(rows, "doc_id", "key"), kernel.object.other_words(shared), pairs) if kernel else rows.mapInArrow(others, pairs)
    rest = rest.join(counts, "hash", "left")
    known = F.coalesce("n", F.lit(0))
    sums = rest.groupBy("r_id", "r_key").agg(
        F.sum("freq").alias("r_freq"), F.sum(F.when(known > 0, F.col("freq")).otherwise(0)).alias("r_known"), F.sum(F.col("freq") * F.log10(known + 1)).alias("r_logs")
    )
    both = out.join(sums, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("key") == F.col("r_key")), "left")
    share = F.coalesce(F.col("n_rest") / F.col("r_freq"), F.lit(0.0))  # repeated rows share their sums
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_top") + F.coalesce(F.round(F.col("r_known") * share), F.lit(0))).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("top_logs") + F.coalesce(F.col("r_logs") * share, F.lit(0.0)) - F.col("n_tokens") * log_all).alias("base_score"),
        (-F.col("bits") * math.log10(2)).alias("score"),
        "n_bytes",
        (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _bytes(words: Words) -> np.ndarray:
    """Bytes of each normalised text: its words, one byte behind each, and one for the end."""
    sizes = np.bincount(words.text_of_word(), words.ends - words.starts + 1, len(words.firsts) - 1)
    return sizes.astype(np.int64) + 1
