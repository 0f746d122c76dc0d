"""Repair of the turn structure of conversations by weighted CYK interval parsing.

A repaired conversation derives from S -> epsilon | system? (user assistant)+. In
Chomsky normal form the grammar has a symbol [p q] for each pair of states of what
has been said so far (nothing, system, user, assistant), the rules [p q] -> [p r]
[r q], and a symbol for each edit of one row. A cell of the chart holds, for a span
of rows and each symbol, the cheapest (cost, audit); the audit is the edits'
initials, the least of equally cheap ones. A cell of one row is closed under
insertions before and behind it. Longer spans are combined bottom-up by length.
Every derivation of [p q] passes some state r between any two rows, so every cut of
a span gives the same cell, and one cut for each span of doubled length is enough.
Equally cheap audits of one span never begin with one another (what follows would
have to be insertions, which cost), so the least of a span comes from the least of
its halves.

Rows are range-partitioned by conversation and turn, so that a conversation of any
length lies in many segments of bounded size. A conversation inside one segment is
repaired right there. The others pass on one chart cell for each segment, which are
combined in groups of bounded size; the segments' shares of the audit are handed
back, and the repaired texts are hashed as they stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from assayer.llm.common import attached, in_small_batches, pinned

WHITE = " \t\n\v\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant; what may follow by role initial.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLE = {"u": "user", "a": "assistant"}
LEGAL = frozenset(("su", "ua", "au"))
#: What one segment holds at most, unless a single turn is longer.
SEGMENT_ROWS, SEGMENT_CHARS = 4096, 1 << 20
#: Segments of a conversation that are combined in one group on each level.
FAN_IN_BITS = 6

#: (from, to) -> cheapest (cost, audit)
Cell = dict[tuple[int, int], tuple[int, str]]


def _closure() -> Cell:
    """Insertions that lead from a state to another, the fewest; none where they are the same."""
    cells = {(p, p): (0, "") for p in range(4)}
    for _ in range(4):
        for (p, q), (cost, audit) in list(cells.items()):
            for (state, initial), after in FOLLOWS.items():
                if state == q and initial in ROLE:
                    _offer(cells, p, after, cost + INSERT, audit + "I")
    return cells


def _offer(cells: Cell, p: int, q: int, cost: int, audit: str) -> None:
    held = cells.get((p, q))
    if held is None or (cost, audit) < held:
        cells[p, q] = (cost, audit)


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans, by the rules [p q] -> [p r] [r q]."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            more = right.get((r, q))
            if more is not None:
                held = out.get((p, q))
                total = cost + more[0]
                if held is None or total < held[0] or (total == held[0] and audit + more[1] < held[1]):
                    out[p, q] = (total, audit + more[1])
    return out


INSERTED = _closure()


@lru_cache(maxsize=1024)
def row_cell(initial: str, must_go: bool, truncated: bool) -> Cell:
    """The cell of one row: delete it, keep it or give it another role, with insertions on both sides."""
    edits: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if not must_go:
        extra = TRUNCATED if truncated else 0
        for (state, said), after in FOLLOWS.items():
            if said == initial:
                _offer(edits, state, after, KEEP + extra, "K")
            if said in ROLE:
                _offer(edits, state, after, REROLE + extra, "R")
    return combined(combined(INSERTED, edits), INSERTED)


def spans(cells: list[Cell]) -> Cell:
    """The cell of neighbouring spans, bottom-up by length; what has no neighbour waits for the next length."""
    if not cells:
        return INSERTED
    while len(cells) > 1:
        pairs = [combined(a, b) for a, b in zip(cells[::2], cells[1::2], strict=False)]
        cells = pairs + cells[-1:] if len(cells) % 2 else pairs
    return cells[0]


@lru_cache(maxsize=20_000)
def short_span(kinds: tuple[tuple[str, bool, bool], ...]) -> Cell:
    """As ``spans`` of the rows' cells; the few shapes that most conversations have are remembered."""
    return spans([row_cell(*kind) for kind in kinds])


def deleted_span(n: int) -> Cell:
    """The cell of ``n`` rows that have to go: deletions before insertions."""
    return {pq: (DELETE * n + cost, "D" * n + audit) for pq, (cost, audit) in INSERTED.items()}


class Turn(NamedTuple):
    turn: int | None
    role: str
    text: str
    copies: int


class Parsed(NamedTuple):
    """What is known of a segment: counts, what its neighbours have to know of its edges, and its cell."""

    rows: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first: str | None
    last: str | None
    least: int | None
    most: int | None
    distinct: int
    cell: Cell


def digest(role: str, text: str) -> bytes:
    role_bytes = role.encode()
    return hashlib.blake2b(len(role_bytes).to_bytes(8, "big") + role_bytes + text.encode(), digest_size=16).digest()


def parsed(turns: list[Turn], seen_before: Iterable[bytes] = ()) -> Parsed:
    """Faults and chart of the turns of a segment, in order; ``seen_before``: digests of turns of earlier segments."""
    rows = blank = duplicate = truncated = illegal = distinct = 0
    first = last = least = most = None
    earlier, seen, cells, kinds = set(seen_before), set(), [], []
    for turn in turns:
        if not turn.copies:
            continue
        if turn.turn is not None:
            distinct += turn.turn != most
            least, most = (turn.turn if least is None else least), turn.turn
        initial, text = turn.role[:1], turn.text.rstrip(WHITE)
        rows += turn.copies
        is_blank = not text
        again = not is_blank and ((turn.role, turn.text) in seen or (bool(earlier) and digest(turn.role, turn.text) in earlier))
        is_cut = not is_blank and not again and text[-1] not in ".!?"
        if is_blank:
            blank += turn.copies
        else:
            seen.add((turn.role, turn.text))
            duplicate += turn.copies - (not again)
            truncated += is_cut
        illegal += (last is not None and last + initial not in LEGAL) + turn.copies - 1
        first, last = (initial if first is None else first), initial
        kinds.append((initial, is_blank or again, is_cut))
        if turn.copies > 1:
            cells += [short_span(tuple(kinds)), deleted_span(turn.copies - 1)]
            kinds = []
        elif len(kinds) == 8:
            cells.append(short_span(tuple(kinds)))
            kinds = []
    if kinds:
        cells.append(short_span(tuple(kinds)))
    return Parsed(rows, blank, duplicate, truncated, illegal, first, last, least, most, distinct, spans(cells))


def joined(a: Parsed, b: Parsed) -> Parsed:
    """Two neighbouring segments as one."""
    if not a.rows or not b.rows:
        return b if not a.rows else a
    shared = a.most is not None and a.most == b.least
    return Parsed(
        a.rows + b.rows, a.blank + b.blank, a.duplicate + b.duplicate, a.truncated + b.truncated,
        a.illegal + b.illegal + (a.last + b.first not in LEGAL), a.first, b.last, b.least if a.least is None else a.least,
        a.most if b.most is None else b.most, a.distinct + b.distinct - shared, combined(a.cell, b.cell),
    )


def all_joined(parts: list[Parsed]) -> Parsed:
    """Neighbouring segments as one, bottom-up by length."""
    while len(parts) > 1:
        pairs = [joined(a, b) for a, b in zip(parts[::2], parts[1::2], strict=False)]
        parts = pairs + parts[-1:] if len(parts) % 2 else pairs
    return parts[0]


def verdict(whole: Parsed) -> tuple[int, int, int, int, int, int, str]:
    """gaps, blank, duplicate, truncated, illegal, cost and audit of a conversation."""
    gaps = 0 if whole.least is None else whole.most - whole.least + 1 - whole.distinct
    cost, audit = min(whole.cell[end] for end in ((START, START), (START, ASSISTANT)) if end in whole.cell) if whole.rows else (0, "")
    return gaps, whole.blank, whole.duplicate, whole.truncated, whole.illegal, cost, audit


def rewritten(turns: list[Turn], audit: str, state: int = START) -> list[tuple[str, str]]:
    """(role, text) of the repaired rows; ``state`` is what came before."""
    out, rows = [], (turn for turn in turns for _ in range(turn.copies))
    for edit in audit:
        turn = None if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = FOLLOWS[state, turn.role[:1]]
            out.append((turn.role, turn.text))
        else:
            initial = "a" if state == USER else "u"
            state = FOLLOWS[state, initial]
            out.append((ROLE[initial], turn.text if turn else ""))
    return out


def as_lines(repaired: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in repaired).encode()


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "turns array<struct<turn:long,role:string,text:string,copies:long>>"
_TURNS_ARROW = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64())]))
_PARSED = (
    "rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, least long, most long, "
    "distinct long, cells array<struct<start:int,stop:int,cost:long,audit:string>>"
)
_PARSED_ARROW = pa.schema(
    [
        *((name, pa.string() if name in ("first", "last") else pa.int64()) for name in Parsed._fields[:-1]),
        ("cells", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
    ]
)
_RESULT_TYPES = [*[pa.int64()] * 6, pa.string(), pa.string()]


def _packed(parts: list[Parsed]) -> list[pa.Array]:
    cells = [[{"start": p, "stop": q, "cost": c, "audit": a} for (p, q), (c, a) in part.cell.items()] for part in parts]
    columns = [[getattr(part, name) for part in parts] for name in Parsed._fields[:-1]]
    return [pa.array(values, field.type) for values, field in zip([*columns, cells], _PARSED_ARROW, strict=True)]


def _unpacked(batch) -> list[Parsed]:
    columns = [batch.column(name).to_pylist() for name in Parsed._fields[:-1]]
    cells = [{(c["start"], c["stop"]): (c["cost"], c["audit"]) for c in row} for row in batch.column("cells").to_pylist()]
    return [Parsed(*row) for row in zip(*columns, cells, strict=True)]


def _turns(row: list[dict]) -> list[Turn]:
    return [Turn(**turn) for turn in row]


def segments(turns: DataFrame, kind: StructField) -> DataFrame:
    """conv_key, conv_id, place, whole, the turns of segments of conversations that may go on elsewhere and the result of all others.

    ``place`` is the number of the range slice and of the segment in it; segments
    of a conversation follow each other in that order.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_, done = TaskContext.get().partitionId(), 0
        key = conv = None
        own: list[Turn] = []
        chars, at_edge, split = 0, True, False
        out: list[tuple] = []
        size = 0

        def close(whole: bool) -> None:
            nonlocal done, size
            if whole:
                found = verdict(parsed(own))
                sha = hashlib.sha256(as_lines(rewritten(own, found[-1]))).hexdigest()
                out.append((key, conv, None, None, *found, sha))
            else:
                out.append((key, conv, (slice_ << 33) + done, [t._asdict() for t in own], *[None] * 8))
                size += chars
            done += 1

        def flushed() -> pa.RecordBatch:
            names = ["conv_key", "conv_id", "place", "turns", *(f.split()[0] for f in _RESULT.split(", "))]
            types = [pa.string(), conv_type, pa.int64(), _TURNS_ARROW, *_RESULT_TYPES]
            columns = list(zip(*out, strict=True)) if out else [()] * len(types)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            out.clear()
            return batch

        conv_type = None
        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            columns = [batch.column(c).to_pylist() for c in ("conv_key", "conv_id", "turn", "role", "text", "copies")]
            for row_key, row_conv, *rest in zip(*columns, strict=True):
                if row_key != key:
                    if own:
                        close(not at_edge and not split)
                        at_edge = False
                    key, conv, own, chars, split = row_key, row_conv, [], 0, False
                elif chars >= SEGMENT_CHARS or len(own) >= SEGMENT_ROWS:
                    close(False)
                    own, chars, split = [], 0, True
                own.append(Turn(*rest))
                chars += len(own[-1].text)
                if len(out) >= 500 or size >= SEGMENT_CHARS:
                    yield flushed()
                    size = 0
        if own:
            close(False)  # it may go on in the next slice
        if out:
            yield flushed()

    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_key", "turn", "role", "text"]
    placed = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    fields = StructType.fromDDL(f"conv_key string, place long, {_TURNS}, {_RESULT}").fields
    schema = StructType([fields[0], StructField("conv_id", kind.dataType), *fields[1:]])
    return in_small_batches(placed).mapInArrow(cut, schema)


def _seen_before(parts: DataFrame) -> DataFrame:
    """conv_key, place and the digests of those of its turns that an earlier segment of the conversation holds too."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, place, turns in zip(*(batch.column(c).to_pylist() for c in ("conv_key", "place", "turns")), strict=True):
                own = sorted({digest(t["role"], t["text"]) for t in turns if t["copies"] and t["text"].strip(WHITE)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(own), pa.string()), pa.array([place] * len(own), pa.int64()), pa.array(own, pa.binary())],
                    ["conv_key", "place", "digest"],
                )

    held = pinned(parts.select("conv_key", "place", "turns").mapInArrow(digests, "conv_key string, place long, digest binary"), "repair-digests")
    keys = ["conv_key", "digest"]
    firsts = held.groupBy(*keys).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = attached(held, pinned(firsts, "repair-firsts"), keys, "n").where("place > first")
    return later.groupBy("conv_key", "place").agg(F.collect_list("digest").alias("seen"))


def _charts(parts: DataFrame) -> DataFrame:
    """conv_key, place and what ``parsed`` finds in each segment."""

    def charted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("turns").to_pylist(), batch.column("seen").to_pylist(), strict=True)
            found = [parsed(_turns(turns), seen or ()) for turns, seen in rows]
            yield pa.RecordBatch.from_arrays([batch.column("conv_key"), batch.column("place"), *_packed(found)], ["conv_key", "place", *_PARSED_ARROW.names])

    known = parts.join(_seen_before(parts), ["conv_key", "place"], "left").select("conv_key", "place", "turns", "seen")
    return known.mapInArrow(charted, f"conv_key string, place long, {_PARSED}")


def _combined_level(charts: DataFrame, bits: int) -> DataFrame:
    """Neighbouring spans of a conversation whose places agree beyond ``bits`` as one; ``pieces`` are the rows of its segments."""

    def merged(table: pa.Table) -> pa.Table:
        order = sorted(range(table.num_rows), key=table.column("place").to_pylist().__getitem__)
        parts, pieces = _unpacked(table), table.column("pieces").to_pylist()
        whole = all_joined([parts[i] for i in order])
        listed = [piece for i in order for piece in pieces[i]]
        place = table.column("place")[order[0]].as_py()
        columns = [pa.array([table.column("conv_key")[0].as_py()], pa.string()), pa.array([place], pa.int64()), pa.array([listed], table.schema.field("pieces").type), *_packed([whole])]
        return pa.Table.from_arrays(columns, ["conv_key", "place", "pieces", *_PARSED_ARROW.names])

    grouped = charts.withColumn("block", F.shiftright("place", bits)).groupBy("conv_key", "block")
    return grouped.applyInArrow(merged, charts.schema)


def _shares(whole: DataFrame) -> DataFrame:
    """conv_key, place and the share of the audit of each segment; it is found by counting the rows that edits use up."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, pieces, found in zip(batch.column("conv_key").to_pylist(), batch.column("pieces").to_pylist(), _unpacked(batch), strict=True):
                audit, at = verdict(found)[-1], 0
                places, shares, starts, before = [], [], [], 0
                for number, piece in enumerate(pieces):
                    end, used = at, 0
                    while used < piece["rows"]:
                        used += audit[end] != "I"
                        end += 1
                    if number == len(pieces) - 1:
                        end = len(audit)
                    places.append(piece["place"])
                    shares.append(audit[at:end])
                    starts.append(before)
                    before += sum(edit != "D" for edit in audit[at:end])
                    at = end
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(shares, pa.string()), pa.array(starts, pa.int64())],
                    ["conv_key", "place", "share", "before"],
                )

    return whole.mapInArrow(shared, "conv_key string, place long, share string, before long")


def _first_kept(parts: DataFrame, shares: DataFrame) -> DataFrame:
    """conv_key and whether its first repaired row is a kept system row, which decides on all states that follow."""

    def looked_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = []
            for turns, share in zip(batch.column("turns").to_pylist(), batch.column("share").to_pylist(), strict=True):
                out = share.lstrip("D")
                row = [t for t in turns for _ in range(t["copies"])][len(share) - len(out)] if out[:1] == "K" else None
                flags.append(row is not None and row["role"][:1] == "s")
            yield pa.RecordBatch.from_arrays([batch.column("conv_key"), pa.array(flags, pa.bool_())], ["conv_key", "system"])

    first = shares.where("before = 0 AND length(replace(share, 'D', '')) > 0").select("conv_key", "place", "share")
    return parts.join(first, ["conv_key", "place"]).select("conv_key", "turns", "share").mapInArrow(looked_at, "conv_key string, system boolean")


def _hashes(parts: DataFrame, shares: DataFrame) -> DataFrame:
    """conv_key and the hash of the repaired lines; segments are rewritten where they are and stream through one hash in order."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("turns", "share", "before", "system")]
            texts = []
            for turns, share, before, system in zip(*columns, strict=True):
                state = START
                if before:  # after n rows: system, then user and assistant in turn
                    n = before - bool(system)
                    state = SYSTEM if not n else (USER if n % 2 else ASSISTANT)
                repaired = rewritten(_turns(turns), share, state)
                texts.append(as_lines(repaired) if repaired else None)
            yield pa.RecordBatch.from_arrays([batch.column("conv_key"), batch.column("place"), pa.array(texts, pa.binary())], ["conv_key", "place", "lines"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            keys, hashes = [], []
            for row_key, text in zip(batch.column("conv_key").to_pylist(), batch.column("lines"), strict=True):
                if row_key != key:
                    if sha is not None:
                        keys.append(key)
                        hashes.append(sha.hexdigest())
                    key, sha = row_key, hashlib.sha256(text.as_py())
                else:
                    sha.update(b"\n")
                    sha.update(text.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(hashes, pa.string())], ["conv_key", "repaired_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sha.hexdigest()])], ["conv_key", "repaired_sha256"])

    known = parts.join(shares, ["conv_key", "place"]).join(_first_kept(parts, shares), "conv_key", "left")
    written = known.select("conv_key", "place", "turns", "share", "before", "system").mapInArrow(lines, "conv_key string, place long, lines binary")
    ordered = written.where("lines IS NOT NULL").repartition("conv_key").sortWithinPartitions("conv_key", "place")
    return ordered.mapInArrow(hashed, "conv_key string, repaired_sha256 string")


def _verdicts(whole: DataFrame) -> DataFrame:
    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [verdict(found) for found in _unpacked(batch)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
            arrays = [pa.array(c, t) for c, t in zip(columns, _RESULT_TYPES[:-1], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_key"), *arrays], ["conv_key", *names])

    return whole.mapInArrow(decided, f"conv_key string, {_RESULT.rpartition(',')[0]}")


def repaired(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    copies_col: str | None = None,
) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Turns are taken by number (an integer), nulls first, and those of one number by
    role and text. A row's first fault counts: blank (no character but white space),
    duplicate (role and text seen earlier in the conversation), truncated (the last
    such character is none of ``.!?``). gaps are numbers missing between the least
    and the largest; illegal counts neighbours whose role initials are not su, ua or
    au. The cheapest edits make the roles (system? (user assistant)+)? by their
    initials: keep 0, reroll to user or assistant 2, delete 3 (the only way with blank
    and duplicate rows), insert an empty turn 2, and 1 more for a truncated row that
    stays. audit is the edits' initials (K R D I), of equally cheap ones the least;
    the hash is that of the lines ``role:text`` that result.

    Null roles and texts count as one blank, so such rows are blank. Rows without a
    conversation id are one conversation. ``copies_col`` says how often a row stands
    there; 0 or less keeps nothing of it but the conversation. A conversation without
    rows has zeros, an empty audit and the hash of the empty text. Repeated rows are
    duplicates of the first. An empty table gives no rows; other columns are not looked
    at. The hash of a conversation that is longer than a segment is computed as its
    lines stream through one task, as it has to be one hash.
    """
    gap = F.lit(" ")
    id_ = F.col(id_col)
    copies = F.greatest(F.col(copies_col), F.lit(0)) if copies_col else F.lit(1)
    there = copies > 0
    kind = conversations.select(id_.alias("conv_id")).schema["conv_id"]
    turns = (
        conversations.select(
            F.coalesce(F.concat(F.lit("="), id_.cast("string")), F.lit("")).alias("conv_key"),
            id_.alias("conv_id"),
            F.when(there, F.col(turn_col).cast("long")).alias("turn"),
            F.when(there, F.coalesce(F.col(role_col), gap)).otherwise("").alias("role"),
            F.when(there, F.coalesce(F.col(text_col), gap)).otherwise("").alias("text"),
            copies.cast("long").alias("copies"),
        )
        .groupBy("conv_key", "conv_id", "turn", "role", "text")
        .agg(F.sum("copies").alias("copies"))
    )
    cut = pinned(segments(turns, kind), "repair-segments")
    result = [f.split()[0] for f in _RESULT.split(", ")]
    done = cut.where("place IS NULL").select("conv_id", *result)
    parts = cut.where("place IS NOT NULL").select("conv_key", "conv_id", "place", "turns")

    pieces = F.array(F.struct("place", "rows")).alias("pieces")
    names = ["conv_key", "place", "pieces", *_PARSED_ARROW.names]
    level = pinned(_charts(parts).select("*", pieces).select(*names), "repair-charts")
    slices, bits = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")), 33
    level = pinned(_combined_level(level, bits), "repair-level")  # segments of a conversation in one slice
    while slices > 1:
        bits, slices = bits + FAN_IN_BITS, (slices + (1 << FAN_IN_BITS) - 1) >> FAN_IN_BITS
        level = pinned(_combined_level(level, bits), "repair-level")
    shares = pinned(_shares(level), "repair-shares")
    ids = parts.select("conv_key", "conv_id").distinct()
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    long_ones = (
        ids.join(_verdicts(level), "conv_key")
        .join(_hashes(parts, shares), "conv_key", "left")
        .withColumn("repaired_sha256", F.coalesce("repaired_sha256", empty))
    )
    return done.unionByName(long_ones.select("conv_id", *result))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text; nulls are one blank) with faults that a hash of conversation and turn decides.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops a row (``copies`` 0), 1 empties its
    text, 2 takes the marks ``.!?`` from it, 3 repeats it (``copies`` 2), 4 makes it the user's.
    """
    or_blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(or_blank("conv_id"), F.lit(":"), or_blank("turn")).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(or_blank("text"), "[.!?]", "")).otherwise(or_blank("text"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(draw == 4, "user").otherwise(or_blank("role")).alias("role"),
        text.alias("text"),
        F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).cast("long").alias("copies"),
    )
