import random

import pytest

from assayer.llm.chat import chat_texts

SCHEMA = "conv_id long, turn long, role string, text string, place int, h1 string, n_turns string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def plain(rows):
    found = {}
    for i, turn, role, text in set((i, t, r or "", x or "") for i, t, r, x in rows):
        found.setdefault(i, []).append((turn, role, text))
    logs = {i: tuple((r, x) for _, r, x in sorted(turns, key=lambda t: t[0])) for i, turns in found.items()}
    out = []
    for log in set(logs.values()):
        if not any(len(o) > len(log) and o[: len(log)] == log for o in logs.values()):
            same = [i for i, o in logs.items() if o == log]
            named = [i for i in same if i is not None]
            out.append((min(named) if named else None, len(log), len(same), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in log)))
    return sorted(out, key=str)


def test_cases(spark):
    rows = [
        (1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 2, "user", "more"),
        (4, 5, "user", "hi"), (4, 9, "assistant", "hello"), (4, 10, "user", "more"), (5, 0, "user", "hi"), (5, 1, "assistant", "other"), (5, 1, "assistant", "other"),
        (6, 0, None, None), (7, 0, "", ""), (7, 1, "user", "x" * 50_000), (None, 0, "user", "hi"), (None, 1, "system", "z"), (8, 0, "assistant", "hi"), (9, 0, "user", "HI"),
    ]
    assert sorted((tuple(r) for r in chat_texts(frame(spark, rows)).collect()), key=str) == plain(rows)


def test_empty_table(spark):
    assert chat_texts(frame(spark, [])).collect() == []


def test_null_turns_come_first(spark):
    (row,) = chat_texts(frame(spark, [(1, 1, "user", "b"), (1, None, "system", "a")])).collect()
    assert row.n_turns == 2 and row.rendered.index("a<") < row.rendered.index("b<")


@pytest.mark.parametrize("seed", range(3))
def test_random_snapshots(spark, seed):
    random.seed(seed)
    logs = [[(random.choice(["user", "assistant"]), random.choice("abc")) for _ in range(random.randint(1, 7))] for _ in range(25)]
    rows = []
    for i in range(120):
        log = random.choice(logs)
        rows += [(i, t, *turn) for t, turn in enumerate(log[: random.randint(1, len(log))])]
    long = [(500, t, "user", random.choice("abc")) for t in range(400)]
    rows += [*long, *[(501, *r[1:]) for r in long[:399]]]
    assert sorted((tuple(r) for r in chat_texts(frame(spark, rows).repartition(4)).collect()), key=str) == plain(rows)
