"""Token counts of whole texts with a public tokenizer, huge texts in overlapping chunks.

A text of more than ``chunk`` characters is encoded in chunks that overlap, with
the offsets of all tokens. Two neighbours are spliced inside their overlap at a
boundary where a token starts in both encodings, where the tokenizer cannot look
across (next to white space or a decimal digit, which no token shares with a
neighbour), and behind which both encodings agree up to the last such boundary
of the overlap. If there is none, the overlap is doubled and the chunk encoded
again; in a text without any such place this ends with one chunk.

Encoding a span asks the library for each word between white space once and
remembers the answer; white space is dropped by the tokenizer and separates
tokens, so a span is the sequence of its words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import WORD_PATTERN, id_and_text

#: Words whose tokens a Python worker remembers, and as many of those before that it has not met since; longer words are encoded each time.
WORDS_KEPT, LONGEST_KEPT = 500_000, 64
#: Words whose tokens are remembered with their offsets, for texts in chunks.
OFFSETS_KEPT = 100_000
BARRIERS = frozenset(" \t\n\v\f\r0123456789")

#: (first character, id) of each token of a span.
Tokens = list[tuple[int, int]]


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.words = re.compile(WORD_PATTERN)
        self.counts: dict[str, int] = {}
        self.earlier: dict[str, int] = {}
        self.known: dict[str, Tokens] = {}

    def count_all(self, texts: list[str]) -> list[int]:
        """Numbers of tokens of many texts; what is new goes to the library in one batch."""
        split = [self.words.findall(text) for text in texts]
        if len(self.counts) > WORDS_KEPT:
            self.counts, self.earlier = {}, self.counts
        counts, earlier = self.counts, self.earlier
        new = []
        for word in {w for words in split for w in words if w not in counts}:
            known = earlier.get(word)
            if known is None:
                new.append(word)
            else:
                counts[word] = known
        extra = {}
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for word, encoding in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                (counts if len(word) <= LONGEST_KEPT else extra)[word] = len(encoding)
        if extra:
            return [sum(extra[w] if w in extra else counts[w] for w in words) for words in split]
        return [sum(map(counts.__getitem__, words)) for words in split]

    def tokens(self, text: str) -> Tokens:
        """The tokens of a span with their offsets."""
        found = [(m.start(), m[0]) for m in self.words.finditer(text)]
        if len(self.known) > OFFSETS_KEPT:
            self.known.clear()
        known, extra = self.known, {}
        new = list({word for _, word in found if word not in known})
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for word, encoding in zip(some, self.library.encode_batch(some, add_special_tokens=False), strict=True):
                own = [(a, i) for (a, _), i in zip(encoding.offsets, encoding.ids, strict=True)]
                (known if len(word) <= LONGEST_KEPT else extra)[word] = own
        return [(start + a, i) for start, word in found for a, i in (known.get(word) or extra.get(word) or ())]


def splice_point(text: str, left: Tokens, right: Tokens, start: int, end: int) -> int | None:
    """The first proven boundary in text[start:end], the overlap of two encodings; None where they don't align."""
    proven = [i for i in range(start + 1, end) if text[i - 1] in BARRIERS or text[i] in BARRIERS]
    if not proven:
        return None
    first, last = proven[0], proven[-1]
    if [t for t in left if first <= t[0] < last] != [t for t in right if first <= t[0] < last]:
        return None
    return first


def count_in_chunks(text: str, tokens: Callable[[str], Tokens], chunk: int, overlap: int) -> int:
    """Number of tokens of one text, from overlapping chunks spliced together."""
    count, at, taken_from = 0, 0, 0
    end = min(len(text), chunk)
    left = tokens(text[:end])
    while end < len(text):
        width = overlap
        while True:
            start = max(at, end - width)
            next_end = min(len(text), end + chunk)
            right = [(start + a, i) for a, i in tokens(text[start:next_end])]
            cut = splice_point(text, left, right, max(start, taken_from), end)
            if cut is not None or start == at:
                break
            width *= 2
        if cut is None:  # no boundary in the whole chunk: encode both chunks as one
            left = [(at + a, i) for a, i in tokens(text[at:next_end])]
        else:
            count += sum(1 for a, _ in left if taken_from <= a < cut)
            at, taken_from, left = start, cut, right
        end = next_end
    return count + sum(1 for a, _ in left if a >= taken_from)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def count_tokens(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 32_768, overlap: int = 256
) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every whole text, row by row.

    Null and empty texts have no bytes and no tokens; null ids and repeated rows
    stay as they are; other columns are not looked at. Strings of special tokens
    inside a text count as the library counts them by default.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = some.column(1).to_pylist()
                counts = own.count_all([text if len(text) <= chunk else "" for text in texts])
                counts = [
                    n if len(text) <= chunk else count_in_chunks(text, own.tokens, chunk, overlap)
                    for n, text in zip(counts, texts, strict=True)
                ]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = id_and_text(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long")
