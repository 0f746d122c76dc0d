"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by a UTF-8 state machine.

A token sequence is the BPE encoding of its bytes exactly when each token
encodes to itself and each neighbouring pair encodes to that pair. The merges
therefore compile into a transducer whose states are the tokens: in the state of
the token just read, it looks ahead through the tree of all tokens, at most as
far as the longest one, and goes on to a token that may follow. Which pairs may
follow each other is worked out when a pair is first met, and kept.

The longest token that may follow is tried first. Every boundary inside a piece
is reached by one token sequence at most, so a boundary from which nothing goes
on is no boundary at all: the transducer steps back and never tries it again.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import id_and_text, kept_by_worker, released

#: Pieces and pairs of tokens that a Python worker remembers; what comes later is worked out each time.
PIECES_KEPT, PAIRS_KEPT = 250_000, 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


NEVER = 1 << 60


class MergeTransducer:
    """Encodes the bytes of one piece. Tokens, and so the states, are named by their ranks; -1 is the start."""

    def __init__(self, ranks: dict[bytes, int], pairs_kept: int = PAIRS_KEPT):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pairs_kept = pairs_kept
        #: The tree of tokens: place * 256 + byte -> place, and the token that ends at a place.
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        for token, rank in ranks.items():
            place = 0
            for byte in token:
                below = self.child.get(place << 8 | byte)
                if below is None:
                    below = self.child[place << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                place = below
            self.token_at[place] = rank
        self.edges: dict[tuple[int, bool], list[tuple[bytes, int]] | None] = {}
        self.fits: dict[int, bool] = {}

    def edge(self, token: int, right: bool) -> list[tuple[bytes, int]] | None:
        """The parts on one edge of a token as its merges build it, each with the rank of the merge that uses it up.

        None for a token that merging does not rebuild.
        """
        found = self.edges.get((token, right), False)
        if found is False:
            whole = self.tokens[token]
            parts = [whole[i : i + 1] for i in range(len(whole))]
            seen = {parts[-right]: None}
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], NEVER))
                if parts[best] + parts[best + 1] not in self.ranks:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
                seen[parts[-right]] = None
            found = None
            if len(parts) == 1:
                found = list(zip(seen, [*(self.ranks[part] for part in [*seen][1:]), NEVER], strict=True))
            self.edges[token, right] = found
        return found

    def may_follow(self, left: int, token: int) -> bool:
        """Does merging the two tokens' bytes end in just these two? Each must be rebuilt, and nothing merge across.

        A merge across two edge parts happens if its rank comes before the
        merges that use up these parts; on equal ranks the one further left wins.
        """
        starts, ends = self.edge(token, False), self.edge(left, True) if left >= 0 else []
        if starts is None or ends is None:
            return False
        for a, use_a in ends:
            for b, use_b in starts:
                across = self.ranks.get(a + b)
                if across is not None and across < use_a and across <= use_b:
                    return False
        return True

    def ahead(self, piece: bytes, at: int) -> list[tuple[int, int]]:
        """(end, token) of all tokens that begin at ``at``, the longest last."""
        found, place, child, token_at = [], 0, self.child.get, self.token_at
        for end in range(at, len(piece)):
            place = child(place << 8 | piece[end])
            if place is None:
                break
            if token_at[place] >= 0:
                found.append((end + 1, token_at[place]))
        return found

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:  # a piece that is a token is that token, reachable by merges or not
            return [whole]
        ids: list[int] = []
        state, at, size, fits = -1, 0, len(piece), self.fits
        begun: list[int] = []
        closed: set[int] = set()
        while at < size:
            for end, token in reversed(self.ahead(piece, at)):
                if end in closed:
                    continue
                pair = state << 32 | token
                fit = fits.get(pair)
                if fit is None:
                    fit = self.may_follow(state, token)
                    if len(fits) < self.pairs_kept:
                        fits[pair] = fit
                if fit:
                    begun.append(at)
                    ids.append(token)
                    state, at = token, end
                    break
            else:
                closed.add(at)
                at = begun.pop()
                ids.pop()
                state = ids[-1] if ids else -1
        return ids


class Utf8Stream:
    """Incremental UTF-8 decoding. The state is what is open: bytes still to come and the allowed next byte.

    Bytes that fit no character become U+FFFD, as in the standard's best practice.
    """

    def __init__(self) -> None:
        self.held, self.due, self.low, self.high = b"", 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            if self.due and self.low <= byte <= self.high:
                self.held += bytes((byte,))
                self.due, self.low, self.high = self.due - 1, 0x80, 0xBF
                if not self.due:
                    out.append(self.held.decode("utf-8"))
                    self.held = b""
                continue
            if self.due:
                out.append("�")
                self.__init__()
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                self.held = bytes((byte,))
                self.due = 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        open_at_end = "�" if self.due else ""
        self.__init__()
        return open_at_end


class Encoder:
    """Encoding of whole texts, with the pieces of a worker remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = MergeTransducer(ranks)
        self.pieces = regex.compile(pattern)
        #: The ids of a piece as 32-bit numbers in a row.
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encoded(text), np.int32).tolist()

    def encoded(self, text: str) -> bytes:
        pieces = self.pieces.findall(text)
        parts = list(map(self.known.get, pieces))
        if None in parts:
            parts = [part if part is not None else self.piece(piece) for part, piece in zip(parts, pieces, strict=True)]
        return b"".join(parts)

    def piece(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            found = np.array(self.transducer.encode(piece.encode("utf-8")), np.int32).tobytes()
            if len(self.known) < PIECES_KEPT and len(piece) <= 64:
                self.known[piece] = found
        return found


class Decoder:
    """Streaming decoding; tokens that are whole characters skip the state machine while nothing is open."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.texts = {rank: _text_or_none(token) for token, rank in ranks.items()}

    def decode(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        texts = list(map(self.texts.__getitem__, ids))
        return "".join(self.decode_stream(ids)) if None in texts else "".join(texts)

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes complete, token by token."""
        stream = Utf8Stream()
        for i in ids:
            whole = self.texts[i]
            yield whole if whole is not None and not stream.due else stream.feed(self.tokens[i])
        yield stream.end()


def _text_or_none(token: bytes) -> str | None:
    try:
        return token.decode("utf-8")
    except UnicodeDecodeError:
        return None


@kept_by_worker
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(path), pattern)


@kept_by_worker
def decoder(path: str) -> Decoder:
    return Decoder(read_ranks(path))


@contextmanager
def uncollected() -> Iterator[None]:
    """Without cyclic garbage collection: the many small objects kept have no cycles, and each pass would visit them all."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text, row by row.

    Null and empty texts give an empty array; null ids and repeated rows stay as
    they are; other columns are not looked at. The ranks are read on the
    executors from ``ranks_path``.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                with uncollected():
                    lists = [own.encoded(text) for text in some.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, lists)]) // 4
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(lists), np.int32)))
                yield pa.RecordBatch.from_arrays([some.column(0), ids], ["doc_id", "ids"])

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(released(encoded, encoder), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded_docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids and text of rows with ids. A null array counts as empty; an id outside the ranks is an error."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                ends = some.column(1).offsets.to_numpy()
                flat = some.column(1).flatten().to_numpy().tolist()
                texts = [own.decode(flat[a:b]) for a, b in zip((ends - ends[0])[:-1].tolist(), (ends - ends[0])[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    rows = encoded_docs.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(released(decoded, decoder), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and the text decoded from them, as ``decode`` of ``encode`` gives it, in one pass of Python.

    Two passes would need two Python workers for each task, each with tables of its own.
    """

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, back = encoder(ranks_path, pattern), decoder(ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                with uncollected():
                    lists = [there.encoded(text) for text in some.column(1).to_pylist()]
                    texts = [back.decode(np.frombuffer(ids, np.int32).tolist()) for ids in lists]
                ends = np.cumsum([0, *map(len, lists)]) // 4
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(lists), np.int32)))
                yield pa.RecordBatch.from_arrays([some.column(0), ids, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(released(both, encoder, decoder), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")
