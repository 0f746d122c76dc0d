import hashlib
import random
import zlib
from itertools import pairwise

from assayer.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, place long, seen string, copies_ int, conv_key string, `rows` int"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
FULL = {"u": "user", "a": "assistant"}


def frame(spark, rows):
    return spark.createDataFrame([(*row, 7, "x", 5, "y", 1) for row in rows], SCHEMA)


def faults(rows):
    """(row, fault) of the rows of one conversation in order."""
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(marked):
    """(cost, audit, lines): from row to row, every state with its least (cost, audit, lines); insertions one at a time."""
    def with_inserts(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                for said, name in FULL.items():
                    if (state, said) in STEP:
                        offer(best, STEP[state, said], (cost + 2, audit + "I", [*lines, (name, "")]))
        return best

    def offer(best, state, value):
        if state not in best or value < best[state]:
            best[state] = value

    best = with_inserts({"": (0, "", [])})
    for role, text, fault in marked:
        new = {}
        for state, (cost, audit, lines) in best.items():
            offer(new, state, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            if (state, role[:1]) in STEP:
                offer(new, STEP[state, role[:1]], (cost + extra, audit + "K", [*lines, (role, text)]))
            for said, name in FULL.items():
                if (state, said) in STEP:
                    offer(new, STEP[state, said], (cost + 2 + extra, audit + "R", [*lines, (name, text)]))
        best = with_inserts(new)
    return min(best[end] for end in ("", "a") if end in best)


def brute(rows):
    """One conversation: the expected result; ``rows`` are (turn, role, text) without nulls in role and text."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    marked = faults(rows)
    counts = [sum(f == kind for _, _, f in marked) for kind in ("blank", "duplicate", "truncated")]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairwise(rows))
    cost, audit, lines = cheapest(marked)
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())


def run(spark, rows, **more):
    got = repair.repaired(frame(spark, rows), **more).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def expected(rows):
    by_id = {}
    for conv, turn, role, text in rows:
        by_id.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return {conv: brute(own) for conv, own in by_id.items()}


def some_rows(seed, conversations, longest):
    draw = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"]
    texts = ["Yes.", "No!", "cut off", "", " \x0b ", None, "Why?\n", "é.", "ok. \x1f", "x" * 50 + "."]
    return [
        (conv if conv else None, draw.choice([None, *range(6)]), draw.choice(roles), draw.choice(texts) if draw.random() < 0.6 else f"{draw.random()}.")
        for conv in range(conversations)
        for _ in range(draw.randrange(1, longest))
    ]


def test_against_a_search_from_row_to_row(spark):
    rows = some_rows(1, 150, 9)
    assert run(spark, rows) == expected(rows)


def test_conversations_over_many_segments_and_slices(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT_ROWS", 3)
    draw = random.Random(5)
    rows = some_rows(2, 12, 25)
    rows += [(100, i // 2, draw.choice(["user", "assistant", "assistant"]), f"{draw.randrange(400)}." if i % 7 else "") for i in range(600)]
    assert run(spark, rows) == expected(rows)


def test_only_deletions_over_many_segments(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT_ROWS", 2)
    rows = [(1, i, "user", " ") for i in range(20)] + [(2, i, "system", "s.") for i in range(9)]
    got = run(spark, rows)
    assert got == expected(rows)
    assert got[1][6] == "D" * 20 and got[1][7] == hashlib.sha256(b"").hexdigest()


def test_repeated_rows_ties_and_dropped_rows(spark):
    rows = [(1, 0, "user", "Hello.")] * 50 + [(1, 1, "assistant", "Hi.")]
    assert run(spark, rows)[1] == brute([r[1:] for r in rows])
    assert run(spark, []) == {}
    gone = repair.repaired(frame(spark, [(3, 0, "user", "Hello."), (None, 0, "user", "x")]).selectExpr("*", "0 AS n"), copies_col="n").collect()
    assert sorted((r.conv_id or 0, r.cost, r.audit, r.gaps) for r in gone) == [(0, 0, "", 0), (3, 0, "", 0)]


def test_all_spans_and_cuts_give_the_same_cell():
    draw = random.Random(3)
    for _ in range(60):
        kinds = [(draw.choice("suat"), draw.random() < 0.3, draw.random() < 0.3) for _ in range(draw.randrange(1, 9))]
        cells = [repair.row_cell(*kind) for kind in kinds]
        chart = {(i, i + 1): cell for i, cell in enumerate(cells)}
        for length in range(2, len(cells) + 1):  # the whole chart, every cut of every span
            for i in range(len(cells) - length + 1):
                made = [repair.combined(chart[i, k], chart[k, i + length]) for k in range(i + 1, i + length)]
                assert all(cell == made[0] for cell in made)
                chart[i, i + length] = made[0]
        assert repair.spans(cells) == chart[0, len(cells)]


def test_damage_follows_the_hash(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in (0, 1, None)]
    want = {}
    for conv, turn, *_ in rows:
        draw = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        want[conv, turn] = ("user" if draw == 4 else "assistant", {1: "", 2: "One Two"}.get(draw, "One. Two!"), {0: 0, 3: 2}.get(draw, 1))
    assert len({v for v in want.values()}) == 6
    got = {(r.conv_id, r.turn): (r.role, r.text, r.copies) for r in repair.damaged(frame(spark, rows)).collect()}
    assert got == want
