"""Live runs that arrive late, twice, in pieces and out of order."""

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators.capture import long_rows, outcome_row
from assayer.operators.score import score_pairs
from assayer.session import materialise, scratch
from assayer.streaming import live, scoring


def result(spark, pair, side, alt, rows):
    frame = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "p long, a long, b string")
    return long_rows(frame, F.lit(pair), side, F.col("p"), ["a", "b"], alt)


def failed(spark, pair, side, alt, err):
    return outcome_row(spark, pair, side, alt, None, err)


def empty(spark, pair, side, alt):
    return outcome_row(spark, pair, side, alt, spark.createDataFrame([], "a long, b string"), None)


def scores_of(df):
    return sorted(tuple(r) for r in df.select("pair_id", "exact", "correct", "exact_alt", "failed", "error").collect())


def test_scores_of_arrivals_are_those_of_the_stored_table(spark):
    some = [(i, f"x{i % 3}") for i in range(25)]
    results = [
        result(spark, 1, "gold", 0, some), result(spark, 1, "gen", None, some[::-1]),
        result(spark, 2, "gold", 0, some[1:]), result(spark, 2, "gold", 1, some), result(spark, 2, "gen", None, some),
        result(spark, 3, "gold", 0, some), failed(spark, 3, "gen", None, "no table"),
        empty(spark, 4, "gold", 0), empty(spark, 4, "gen", None),
        failed(spark, 5, "gold", 0, "boom"), result(spark, 5, "gold", 1, some), result(spark, 5, "gen", None, some),
        result(spark, 6, "gold", 0, some), result(spark, 6, "gen", None, some),
    ]
    rows = materialise(reduce(DataFrame.unionByName, results))
    asked = materialise(
        rows.select("pair_id").distinct().selectExpr("pair_id", "'c' query_category", "'q' question", "'SELECT 1' sql_gold", "'SELECT 1' sql_gen")
    )
    delivered = materialise(scoring.with_markers(rows, rows_per_part=10))
    folder, path, checkpoint = (scratch(spark, name) for name in ("delivered", "scored", "checkpoint"))

    def run():
        scoring.score_arrivals(spark, folder, asked, path, checkpoint, files_per_batch=1).awaitTermination()

    # markers first, then parts of all results here and there, then what is missing but for one part of pair 6
    missing = (F.col("pair_id") == 6) & (F.col("side") == "gold") & (F.coalesce("part", F.lit(-1)) == 1)
    scoring.deliver(delivered.filter("part IS NULL"), folder, 1)
    scoring.deliver(delivered.filter("part = 0 OR (part IS NULL AND pair_id = 2)"), folder, 1)
    run()
    early = scores_of(scoring.arrived_scores(spark, path))
    assert [r[0] for r in early] == [4]
    scoring.deliver(delivered.filter(F.col("part").isNotNull() & ~missing), folder, 2)
    run()
    want = scores_of(score_pairs(rows, asked))
    assert scores_of(scoring.arrived_scores(spark, path)) == [r for r in want if r[0] != 6]
    scoring.deliver(delivered.filter("pair_id < 4 OR pair_id = 6"), folder, 1)
    run()
    assert scores_of(scoring.arrived_scores(spark, path)) == want


class State:
    """As the stream keeps it from batch to batch."""

    def __init__(self):
        self.held, self.exists = None, False

    @property
    def get(self):
        return self.held

    def update(self, value):
        self.held, self.exists = value, True


def test_a_pair_is_held_until_its_last_part_whatever_comes_first():
    events = [(7, -1, -1, 2, 1, "f"), (7, -1, 0, -1, -1, "f"), (7, -1, 1, -1, -1, "g"), (7, 0, -1, 0, 2, "h"), (7, 1, -1, 1, 2, "i"), (7, 1, 0, -1, -1, "j")]
    columns = ["pair_id", "result", "part", "parts", "results", "file"]
    for turn in range(len(events)):
        order = events[turn:] + events[:turn]
        state, out = State(), []
        for event in [*order, *order]:  # all of them come twice
            again = (*event[:5], event[5] + "-again")
            out += [frame for e in (event, again) for frame in scoring._held((7,), iter([pd.DataFrame([e], columns=columns)]), state)]
        assert len(out) == 1
        assert sorted(out[0].itertuples(index=False, name=None)) == sorted((7, r, p, f) for _, r, p, _, _, f in events)
        assert state.held[0] and not state.held[6]


def test_late_rows_two_streams_and_a_repeated_batch(spark):
    path = scratch(spark, "report")
    schema = "ts timestamp, correct int"
    made = [(f"2024-01-0{1 + (i * 7) % 5} {i % 24:02d}:30:00", i % 3 == 0) for i in range(120)]
    for stream in ("one", "two"):
        folder, checkpoint = scratch(spark, "in"), scratch(spark, f"checkpoint-{stream}")
        for half in (0, 1):
            rows = spark.createDataFrame(made[half::2], "ts string, correct boolean").selectExpr("cast(ts AS timestamp) ts", "cast(correct AS int) correct")
            rows.repartition(2).write.mode("append").parquet(folder)
            live.publish_hourly(live.watch_results(spark, folder, schema, "parquet"), "ts", path, checkpoint).awaitTermination()
            if half:
                live.fold_hourly(spark, path)
                live.fold_hourly(spark, path)
    want = {}
    for ts, correct in made * 2:
        tried, right = want.get(ts[:13], (0, 0))
        want[ts[:13]] = (tried + 1, right + correct)
    got = live.hourly_accuracy(spark, path).select(F.date_format("hour", "yyyy-MM-dd HH").alias("h"), "tried", "mean_correct").collect()
    assert {r.h: (r.tried, round(r.mean_correct * r.tried)) for r in got} == want
