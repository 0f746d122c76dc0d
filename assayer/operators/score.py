"""Scoring many (gold, generated) result pairs in one distributed run.

Every stage shuffles on row content, on (group, order) ranges or on salted
keys, never on the pair alone, so a single huge pair does not end up in one
task. What holds for a whole result (names, kinds, sort keys) is settled once
per result and sent to its rows; later stages only read the pairs that earlier
ones left undecided.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.cells import (
    ATOL,
    NUMBER,
    RTOL,
    UNEQUAL_NULL_TAGS,
    content_sums,
    digest,
    is_close,
    is_missing,
    sort_cell,
)
from assayer.functions.ordering import stated_order, wants_order
from assayer.operators.capture import unique_names
from assayer.operators.ordered import attach, fits_broadcast, lowest_running_sum, ranked
from assayer.session import materialise

PAIR = ["pair_id", "alt"]
_SUMS = [f"{p}{s}{k}" for p in ("m", "p") for s in range(2) for k in range(3)]


def order_specs(questions: DataFrame, order_parse: str = "faithful") -> DataFrame:
    """Per pair: ordering intent and the order each statement states."""
    robust = order_parse == "robust"
    return questions.select(
        "pair_id",
        wants_order(F.col("query_category"), F.col("question")).alias("intent"),
        stated_order(F.col("sql_gold"), robust).alias("gold_order"),
        stated_order(F.col("sql_gen"), robust).alias("gen_order"),
    )


def result_heads(result_rows: DataFrame) -> DataFrame:
    """One row per result: names, tags, row count and error; reads no cells.

    Rows are counted by what they say of their result, which hashes; the largest
    array or text is only sought among the few combinations that leaves.
    """
    shapes = result_rows.groupBy("pair_id", "alt", "side", "names", "tags", "err").agg(F.count("pos").alias("rows"))
    return shapes.groupBy("pair_id", "alt", "side").agg(
        F.max("names").alias("names"), F.max("tags").alias("tags"), F.sum("rows").alias("rows"), F.max("err").alias("err")
    )


def comparison_plan(heads: DataFrame, questions: DataFrame, order_parse: str = "faithful") -> DataFrame:
    """One row per (pair, alternative) that ran: shapes, order rules, column places.

    ``*_places`` lists the columns of a side in comparison order: by name, and
    where the side sorts by stated keys, those keys last.
    """
    ran = heads.filter(F.col("err").isNull())

    def side(name: str, keep: list[str]) -> DataFrame:
        return ran.filter(F.col("side") == name).select(
            *keep,
            unique_names(F.col("names")).alias(f"{name}_names"),
            F.col("tags").alias(f"{name}_tags"),
            F.col("rows").alias(f"{name}_rows"),
        )

    plan = side("gold", PAIR).join(side("gen", ["pair_id"]), "pair_id").join(order_specs(questions, order_parse), "pair_id")
    for s in ("gold", "gen"):
        names, order = F.col(f"{s}_names"), F.col(f"{s}_order")
        keyed = F.col("intent") & order["stated"]
        by_name = F.array_sort(names)
        keys = F.array_intersect(order["keys"], names)
        arranged = F.when(keyed, F.concat(F.array_except(by_name, order["keys"]), keys)).otherwise(by_name)
        plan = plan.withColumns(
            {
                f"{s}_cols": F.size(names),
                f"{s}_keyed": keyed,
                f"{s}_keys": F.size(keys),
                f"{s}_desc": order["descending"],
                f"{s}_places": _places(names, arranged),
            }
        )
    return plan.drop("gold_order", "gen_order")


def _places(names: Column, wanted: Column) -> Column:
    """0-based places of the wanted names."""
    return F.transform(wanted, lambda n: (F.array_position(names, n) - 1).cast("int"))


def placed_rows(
    result_rows: DataFrame,
    plan: DataFrame,
    gold_places: str = "gold_places",
    gen_places: str = "gen_places",
    fits: bool | None = None,
) -> DataFrame:
    """Rows of the planned pairs with ``canon``, their cells in comparison order.

    Generated rows are repeated for every planned alternative. Where a result
    has all its columns in order already, its cells are passed through.
    """

    def routes(side: str, number: Column, places: str) -> DataFrame:
        unchanged = F.col(places) == F.transform(f"{side}_tags", lambda _, i: i)
        return plan.select(
            "pair_id", F.lit(side).alias("side"), number.alias("_alt"), "alt", F.when(~unchanged, F.col(places)).alias("_places")
        )

    both = routes("gold", F.col("alt"), gold_places).unionByName(routes("gen", F.lit(-1), gen_places))
    moved = F.transform("_places", lambda i: F.get("vals", i))
    cells = F.when(F.col("_places").isNull(), F.col("vals")).otherwise(moved)
    return attach(_body(result_rows), both, ["pair_id", "side", "_alt"], by=["pos"], fits=fits).select(
        *PAIR, "side", "pos", cells.alias("canon")
    )


def _body(result_rows: DataFrame) -> DataFrame:
    return result_rows.filter(F.col("pos").isNotNull()).select(
        "pair_id", "side", "pos", "vals", F.coalesce("alt", F.lit(-1)).alias("_alt")
    )


def planned_rows(result_rows: DataFrame, plan: DataFrame, fits: bool | None = None) -> DataFrame:
    """Rows of the planned pairs with their cells as returned."""

    def routes(side: str, number: Column) -> DataFrame:
        return plan.select("pair_id", F.lit(side).alias("side"), number.alias("_alt"), "alt")

    both = routes("gold", F.col("alt")).unionByName(routes("gen", F.lit(-1)))
    return attach(_body(result_rows), both, ["pair_id", "side", "_alt"], by=["pos"], fits=fits).drop("_alt")


def distinct_digests(rows: DataFrame) -> DataFrame:
    """One row per distinct content, known by its digest, with its first place on each side."""
    return _first_places(rows.select(*PAIR, "side", "pos", *digest(["canon"])), ["d0", "d1"])


def distinct_rows(rows: DataFrame) -> DataFrame:
    """One row per distinct content with its first place on each side."""
    return _first_places(rows, ["canon"])


def _first_places(rows: DataFrame, content: list[str]) -> DataFrame:
    gold, gen = F.col("side") == "gold", F.col("side") == "gen"
    return rows.groupBy(*PAIR, *content).agg(
        F.min(F.when(gold, F.col("pos"))).alias("gold_pos"), F.min(F.when(gen, F.col("pos"))).alias("gen_pos")
    )


def _set_verdict(content: DataFrame) -> DataFrame:
    return content.groupBy(*PAIR).agg(
        F.count("gold_pos").alias("gold_distinct"),
        F.count("gen_pos").alias("gen_distinct"),
        F.bool_and(F.col("gold_pos").isNotNull() & F.col("gen_pos").isNotNull()).alias("same_rows"),
    )


def _same_sequence(sides: DataFrame, tolerant: bool) -> DataFrame:
    """Compare two sorted sides row by row.

    ``sides`` has one row per (pair, alternative, side, cells), sorted by ``at``,
    ``skey`` and the cells; ``flip`` reads the side backwards, ``size`` is its
    row count.
    """
    placed = ranked(sides, [*PAIR, "side"], ["at", "skey", "cells"]).withColumn(
        "rank", F.when(F.col("flip"), F.col("size") + 1 - F.col("rank")).otherwise(F.col("rank"))
    )

    def side_rows(side: str) -> DataFrame:
        return placed.filter(F.col("side") == side).select(*PAIR, "rank", F.col("cells").alias(side), "floating")

    facing = side_rows("gold").join(side_rows("gen").drop("floating"), [*PAIR, "rank"])
    same = F.col("gold").eqNullSafe(F.col("gen"))
    if tolerant:
        near = F.forall(
            F.arrays_zip("gold", "gen", "floating"),
            lambda c: c["gold"].eqNullSafe(c["gen"])
            | (c["floating"] & F.coalesce(is_close(c["gold"]["num"], c["gen"]["num"]), F.lit(False))),
        )
        same = same | F.coalesce(near, F.lit(False))
    return facing.groupBy(*PAIR).agg(F.bool_and(same).alias("same_order"))


def exact_matches(result_rows: DataFrame, plan: DataFrame, fits: bool | None = None) -> DataFrame:
    """The plan with ``normal_equal``, normalised equality, pinned in the shared folder.

    Where both sides sort by the same rule, equality of the distinct rows
    decides. Otherwise the two orders are compared row by row.
    """
    same_rule = (
        F.col("gold_keyed")
        & F.col("gen_keyed")
        & (F.col("gold_keys") == F.col("gen_keys"))
        & (F.col("gold_desc") == F.col("gen_desc"))
    )
    comparable = plan.filter(F.col("gold_cols") == F.col("gen_cols"))
    content = distinct_digests(placed_rows(result_rows, comparable, fits=fits))
    verdict = materialise(
        plan.join(_set_verdict(content), PAIR, "left")
        .fillna({"gold_distinct": 0, "gen_distinct": 0, "same_rows": True})
        .withColumn("same_shape", F.col("gold_cols") == F.col("gen_cols"))
        .withColumn("by_sequence", F.col("intent") & ~same_rule & (F.col("gold_distinct") > 1))
        .withColumn("normal_equal", F.col("same_shape") & F.col("same_rows"))
    )
    pending = verdict.filter(F.col("normal_equal") & F.col("by_sequence"))
    if pending.isEmpty():
        return verdict
    specs = [f"{s}_{c}" for s in ("gold", "gen") for c in ("keyed", "keys", "desc")]
    open_content = distinct_rows(placed_rows(result_rows, pending, fits=fits))
    open_rows = attach(open_content, pending.select(*PAIR, *specs, "gold_distinct"), PAIR, by=["gold_pos"], fits=fits)
    sides = reduce(DataFrame.unionByName, [_side_keys(open_rows, side) for side in ("gold", "gen")])
    order = _same_sequence(sides, tolerant=False)
    joined = materialise(verdict.join(order, PAIR, "left"))
    return joined.withColumn(
        "normal_equal", F.col("normal_equal") & F.coalesce("same_order", F.lit(True))
    ).drop("same_order")


def _side_keys(open_rows: DataFrame, side: str) -> DataFrame:
    keyed, falls, k = F.col(f"{side}_keyed"), F.col(f"{side}_desc"), F.col(f"{side}_keys")
    width = F.size("canon")
    none = F.slice("canon", 1, 0)
    priority = F.concat(
        F.when(k > 0, F.slice("canon", width - k + 1, F.greatest(k, F.lit(1)))).otherwise(none),
        F.when(width > k, F.slice("canon", 1, F.greatest(width - k, F.lit(0)))).otherwise(none),
    )
    return open_rows.select(
        *PAIR,
        F.lit(side).alias("side"),
        F.col("canon").alias("cells"),
        F.when(keyed, F.lit(0)).otherwise(F.col(f"{side}_pos")).cast("bigint").alias("at"),
        F.when(keyed, F.transform(priority, lambda c: sort_cell(c, falls))).alias("skey"),
        (keyed & falls).alias("flip"),
        F.col("gold_distinct").alias("size"),
        F.lit(None).cast("array<boolean>").alias("floating"),
    )


def column_profiles(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """One profile per (pair, alternative, side, column), aggregated map-side.

    The ``m`` sums identify the multiset of values, the ``p`` sums the values
    with their places; together with the counts they stand for the column.
    """
    cells = rows.select(*PAIR, "side", "pos", F.posexplode("vals").alias("col", "cell")).select(
        *PAIR, "side", "pos", "col", "cell.*"
    )
    profiles = cells.groupBy(*PAIR, "side", "col").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("kind") == "~", 1)).alias("missing"),
        F.min("num").alias("lo"),
        F.max("num").alias("hi"),
        F.sum("num").alias("total"),
        F.sum(F.abs("num")).alias("mass"),
        *content_sums(["kind", "num", "txt"], "m"),
        *content_sums(["pos", "kind", "num", "txt"], "p"),
    )
    tags = F.when(F.col("side") == "gold", F.col("gold_tags")).otherwise(F.col("gen_tags"))
    return profiles.join(plan.select(*PAIR, "gold_tags", "gen_tags"), PAIR).withColumn("tag", F.get(tags, F.col("col"))).drop(
        "gold_tags", "gen_tags"
    )


def _columns_of(profiles: DataFrame, side: str, prefix: str, keep: list[str]) -> DataFrame:
    """The column profiles of one side with prefixed names; the pair and alternative keep theirs."""
    return profiles.filter(F.col("side") == side).select(*PAIR, *[F.col(c).alias(f"{prefix}_{c}") for c in ["col", "n", "missing", "tag", *keep]])


def _joined_columns(gold: DataFrame, gen: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of both sides that agree in the keys; the pair alone is never the key."""
    return gold.join(gen.withColumnsRenamed({f"n_{c}": f"g_{c}" for c in keys}), [*PAIR, *[f"g_{c}" for c in keys]])


def _all_equal(names: list[str]) -> Column:
    return F.expr(" AND ".join(f"g_{c} = n_{c}" for c in names))


def positional_matches(profiles: DataFrame) -> DataFrame:
    """(pair, alternative) whose columns agree place by place, names ignored."""
    places = [c for c in _SUMS if c.startswith("p")]
    facing = _joined_columns(_columns_of(profiles, "gold", "g", places), _columns_of(profiles, "gen", "n", places), ["col"])

    def sound(side: str) -> Column:
        # Missing values of some kinds are unequal to themselves here.
        return (F.col(f"{side}_missing") == 0) | ~F.col(f"{side}_tag").isin(*UNEQUAL_NULL_TAGS)

    same = _all_equal(["n", *places]) & sound("g") & sound("n")
    return facing.groupBy(*PAIR).agg(F.bool_and(same).alias("same_places"))


def _band(value: Column) -> Column:
    """The band of a number; numbers within tolerance lie in the same or in neighbouring bands."""
    width, bend = 4 * RTOL, ATOL / RTOL
    return F.floor(F.signum(value) * F.asinh(F.least(F.abs(value) / F.lit(bend), F.lit(1e150))) / F.lit(width))


def column_candidates(profiles: DataFrame) -> DataFrame:
    """Column pairs that match outright (``sure``) or may match within tolerance.

    Sure matches are joined by their counts and sums. In a set of equal columns
    none of which is floating, the first gold one only needs the first generated
    one, the second the second, and so on. Floating columns are joined by the bands of
    their least and largest value: sorted columns that agree place by place agree
    in those. Only what shares them is looked at more closely.
    """
    multiset = [c for c in _SUMS if c.startswith("m")]
    content, pair_of_columns = ["n", "missing", *multiset], [*PAIR, "g_col", "n_col"]
    equals = Window.partitionBy(*PAIR, *content)
    known = profiles.withColumns(
        {
            "loose": F.max(F.col("tag") == "f").over(equals),
            "place": F.row_number().over(Window.partitionBy(*PAIR, "side", *content).orderBy("col")),
        }
    )
    keep = ["lo", "hi", "total", "mass", *multiset, "loose", "place"]
    gold, gen = _columns_of(known, "gold", "g", keep), _columns_of(known, "gen", "n", keep)
    exact = [f"{{0}}_{c}" for c in ["col", *content, "place"]]
    sides = [(side.filter(f"{p}_loose"), side.filter(f"NOT {p}_loose")) for side, p in ((gold, "g"), (gen, "n"))]
    loose, rigid = (
        [side[i].select(*PAIR, *[c.format(p) for c in exact]) for side, p in zip(sides, "gn")] for i in range(2)
    )
    sure = _joined_columns(*rigid, [*content, "place"]).select(*pair_of_columns).unionByName(
        _joined_columns(*loose, content).select(*pair_of_columns)
    )

    # Necessary conditions with room for rounding; they only save work.
    reach = f"2 * {RTOL}D * greatest(abs(g_lo), abs(g_hi), abs(n_lo), abs(n_hi)) + 2 * {ATOL}D"
    total_reach = f"2 * {RTOL}D * (g_mass + n_mass) + 2 * {ATOL}D * g_n"

    def near(a: str, b: str, slack: str) -> str:
        finite = f"abs({a}) < double('inf') AND abs({b}) < double('inf')"
        return f"coalesce(NOT ({finite}) OR abs({a} - {b}) <= {slack}, true)"

    unequal = " OR ".join(f"g_{c} <> n_{c}" for c in multiset)
    maybe = F.expr(
        f"({unequal}) AND {near('g_lo', 'n_lo', reach)} AND {near('g_hi', 'n_hi', reach)} AND {near('g_total', 'n_total', total_reach)}"
    )

    def banded(side: DataFrame, prefix: str) -> DataFrame:
        # Columns without values, and with values that are not finite, have bands of their own.
        def band(c: str) -> Column:
            value = F.col(f"{prefix}_{c}")
            return F.when(value.isNull(), F.lit(-(1 << 62))).when(F.abs(value) < float("inf"), _band(value)).otherwise(F.lit(1 << 62))

        return side.filter(F.col(f"{prefix}_tag") == "f").withColumns({f"{prefix}_band_lo": band("lo"), f"{prefix}_band_hi": band("hi")})

    around = F.sequence(F.lit(-1).cast("bigint"), F.lit(1).cast("bigint"))
    spread = banded(gold, "g")
    for c in ("band_lo", "band_hi"):
        spread = spread.withColumn("_step", F.explode(around)).withColumn(f"g_{c}", F.col(f"g_{c}") + F.col("_step")).drop("_step")
    open_ = _joined_columns(spread, banded(gen, "n"), ["n", "missing", "band_lo", "band_hi"]).withColumn("n_n", F.col("g_n"))
    return sure.withColumn("sure", F.lit(True)).unionByName(open_.filter(maybe).select(*pair_of_columns, F.lit(False).alias("sure")))


def upper_limit(b: Column) -> Column:
    """The largest number close to ``b``."""
    relative = F.when(b >= 0, b / F.lit(1 - RTOL)).otherwise(b * F.lit(1 - RTOL))
    return F.greatest(relative, b + F.lit(ATOL))


def lower_limit(b: Column) -> Column:
    """The smallest number close to ``b``."""
    relative = F.when(b > 0, b * F.lit(1 - RTOL)).otherwise(b / F.lit(1 - RTOL))
    return F.least(relative, b - F.lit(ATOL))


def tolerant_matches(rows: DataFrame, open_pairs: DataFrame) -> DataFrame:
    """Which of the open floating column pairs agree within tolerance once sorted.

    Two sorted columns agree place by place exactly when, at every threshold,
    the one never counts fewer values than the limits of the other. That needs
    running sums of value counts only, so equal values travel once.
    """
    group = [*PAIR, "g_col", "n_col"]
    wanted = open_pairs.select(*PAIR, F.lit("gold").alias("side"), F.col("g_col").alias("col"), "g_col", "n_col").unionByName(
        open_pairs.select(*PAIR, F.lit("gen").alias("side"), F.col("n_col").alias("col"), "g_col", "n_col")
    )
    cells = rows.select(*PAIR, "side", F.posexplode("vals").alias("col", "cell"))
    numbers = cells.filter(F.col("cell.kind") == NUMBER).select(*PAIR, "side", "col", F.col("cell.num").alias("num"))
    counts = (
        attach(numbers, wanted, [*PAIR, "side", "col"], by=["num"])
        .groupBy(*group, "side", "num")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    num, n = F.col("num"), F.col("n")

    def event(test: str, at: Column, tie: int, delta: Column) -> Column:
        return F.struct(F.lit(test).alias("test"), at.alias("at"), F.lit(tie).alias("tie"), delta.alias("delta"))

    gold = F.array(event("above", num, 0, n), event("below", num, 1, -n))
    gen = F.array(event("above", upper_limit(num), 1, -n), event("below", lower_limit(num), 0, n))
    events = counts.select(*group, F.explode(F.when(F.col("side") == "gold", gold).otherwise(gen)).alias("e")).select(
        *group, "e.*"
    )
    merged = events.groupBy(*group, "test", "at", "tie").agg(F.sum("delta").alias("delta"))
    lowest = lowest_running_sum(merged, [*group, "test"], ["at", "tie"], "delta")
    return lowest.groupBy(*group).agg((F.min("lowest") >= 0).alias("close")).filter("close").drop("close")


def assign_columns(matches: DataFrame) -> DataFrame:
    """Gold columns in order take the first matching generated column still free.

    ``taken[i]`` is the generated column of gold column i; a gold column without
    any match ends the array early. The groups hold columns, not rows.
    """
    options = matches.groupBy(*PAIR, "g_col").agg(F.array_sort(F.collect_set("n_col")).alias("options"))
    lists = options.groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("g_col", "options"))).alias("wanted"))

    def take(taken: Column, want: Column) -> Column:
        free = F.filter(want["options"], lambda c: ~F.array_contains(taken, c))
        on_turn = want["g_col"] == F.size(taken)
        return F.when(on_turn & (F.size(free) > 0), F.concat(taken, F.slice(free, 1, 1))).otherwise(taken)

    return lists.select(*PAIR, F.aggregate("wanted", F.array().cast("array<int>"), take).alias("taken"))


def subset_matches(
    result_rows: DataFrame, rows: DataFrame, profiles: DataFrame, plan: DataFrame, fits: bool | None = None
) -> DataFrame:
    """(pair, alternative) whose gold columns are all contained in the generated result.

    Where every open column has one possible partner, the row comparison at the
    end also decides the columns, unless rows were dropped as duplicates. Only
    contested columns are tested for tolerance beforehand.
    """
    candidates = materialise(column_candidates(profiles))
    undecided = candidates.filter(~F.col("sure"))
    shape = candidates.groupBy(*PAIR).agg(
        F.expr("count(1) = count(DISTINCT g_col) AND count(1) = count(DISTINCT n_col)").alias("forced"),
        F.expr("NOT bool_and(sure)").alias("open"),
    )
    contested = undecided.join(shape.filter("open AND NOT forced").select(*PAIR), PAIR, "left_semi")
    matches = candidates.join(shape, PAIR).filter("sure OR forced").select(*PAIR, "g_col", "n_col")
    if not contested.isEmpty():
        matches = matches.unionByName(tolerant_matches(rows, contested))
    by_name = _places(F.col("gold_names"), F.array_sort("gold_names"))
    found = materialise(
        assign_columns(matches)
        .join(plan.select(*PAIR, "intent", "gold_cols", "gold_names", "gold_tags", "gen_tags", "gold_rows"), PAIR)
        .join(shape.select(*PAIR, F.expr("open AND forced").alias("deferred")), PAIR)
        .filter(F.size("taken") == F.col("gold_cols"))
        .withColumn("gold_at", by_name)
        .withColumn("gen_at", F.transform("gold_at", lambda i: F.get("taken", i)))
        .withColumn(
            "floating",
            F.zip_with(
                "gold_at", "gen_at", lambda i, j: (F.get("gold_tags", i) == "f") & (F.get("gen_tags", j) == "f")
            ),
        )
        .select(*PAIR, "intent", "gold_at", "gen_at", "gold_tags", "gen_tags", "floating", "gold_rows", "deferred")
    )
    content = distinct_digests(placed_rows(result_rows, found, "gold_at", "gen_at", fits))
    sets = materialise(
        _set_verdict(content)
        .join(found, PAIR)
        .withColumn(
            "by_sequence",
            (F.col("gold_distinct") == F.col("gen_distinct"))
            & F.when(F.col("same_rows"), F.col("intent") & (F.col("gold_distinct") > 1)).otherwise(
                F.exists("floating", lambda f: f)
            ),
        )
    )
    # Dropped duplicates hide how often a value occurs, so columns that were
    # taken on trust are tested after all.
    trusted = sets.filter("deferred AND (gold_distinct < gold_rows OR gen_distinct < gold_rows)").select(*PAIR)
    if not trusted.isEmpty():
        tested = undecided.join(trusted, PAIR, "left_semi")
        failed = tested.join(tolerant_matches(rows, tested), [*PAIR, "g_col", "n_col"], "left_anti").select(*PAIR)
        sets = materialise(sets.join(failed.distinct(), PAIR, "left_anti"))
    settled = sets.filter(F.col("same_rows") & ~F.col("by_sequence")).select(*PAIR)
    pending = sets.filter("by_sequence")
    if pending.isEmpty():
        return settled
    open_content = distinct_rows(placed_rows(result_rows, pending, "gold_at", "gen_at", fits))
    open_rows = attach(
        open_content,
        pending.select(*PAIR, "intent", "floating", "gold_distinct"),
        PAIR,
        by=["gold_pos", "gen_pos"],
        fits=fits,
    )

    def side_rows(side: str) -> Column:
        pos = F.col(f"{side}_pos")
        return F.when(
            pos.isNotNull(),
            F.struct(F.lit(side).alias("side"), F.when(F.col("intent"), pos).otherwise(F.lit(0)).cast("bigint").alias("at")),
        )

    sides = (
        open_rows.select("*", F.explode(F.array_compact(F.array(side_rows("gold"), side_rows("gen")))).alias("s"))
        .select(
            *PAIR,
            "s.side",
            "s.at",
            F.col("canon").alias("cells"),
            F.lit(None).cast("string").alias("skey"),
            F.lit(False).alias("flip"),
            F.col("gold_distinct").alias("size"),
            "floating",
        )
    )
    order = _same_sequence(sides, tolerant=True)
    return settled.unionByName(order.filter("same_order").select(*PAIR))


def score_alternatives(
    result_rows: DataFrame,
    plan: DataFrame,
    numpy_broadcast: bool = False,
    skip_exact: bool = True,
) -> DataFrame:
    """``exact`` and ``subset`` per planned (pair, gold alternative).

    The subset test of an exact alternative does not change its score and is
    only made with ``skip_exact=False``.
    """
    # What later stages send to the rows is cut from the plan and no larger.
    fits = fits_broadcast(plan)
    verdict = exact_matches(result_rows, plan, fits)
    if numpy_broadcast:
        verdict = _with_broadcast_shapes(result_rows, verdict)
    decided = F.col("normal_equal") if skip_exact else F.lit(False)
    undecided = verdict.filter(
        ~decided & (F.col("gold_rows") > 0) & (F.col("gold_rows") == F.col("gen_rows"))
    ).select(*plan.columns)
    if undecided.isEmpty():
        return verdict.select(*PAIR, F.col("normal_equal").alias("exact"), F.lit(False).alias("subset"))
    rows = planned_rows(result_rows, undecided, fits)
    profiles = materialise(column_profiles(rows, undecided))
    in_place = positional_matches(profiles)
    subset = subset_matches(result_rows, rows, profiles, undecided, fits).withColumn("subset", F.lit(True))
    scored = verdict.join(in_place, PAIR, "left").join(subset, PAIR, "left")
    placed = F.col("same_shape") & F.coalesce("same_places", F.lit(False))
    return scored.select(
        *PAIR,
        (F.col("normal_equal") | placed).alias("exact"),
        F.coalesce("subset", F.lit(False)).alias("subset"),
    )


def _with_broadcast_shapes(result_rows: DataFrame, verdict: DataFrame) -> DataFrame:
    """Opt-in quirk: a lone row equals every row it is stretched against.

    A one-row side passes when all rows of the other side equal it cell by
    cell; an empty side passes against an empty or one-row side.
    """
    fewest, most = F.least("gold_rows", "gen_rows"), F.greatest("gold_rows", "gen_rows")
    lone = verdict.filter((fewest == 1) & F.col("same_shape"))
    kinds = planned_rows(result_rows, lone).select(*PAIR, "vals").distinct().groupBy(*PAIR).agg(F.count(F.lit(1)).alias("kinds"))
    empty = (fewest == 0) & (most <= 1)
    return (
        verdict.join(kinds, PAIR, "left")
        .withColumn(
            "normal_equal",
            F.col("normal_equal") | (F.col("same_shape") & (empty | (F.coalesce("kinds", F.lit(0)) == 1))),
        )
        .drop("kinds")
    )


def fold_alternatives(scored: DataFrame, heads: DataFrame) -> DataFrame:
    """One row per pair: exact if any alternative is, correct if exact or subset.

    Alternatives are tried in order up to the first exact one, so an error in an
    earlier alternative fails the pair and one in a later alternative does not.
    ``heads`` has one row per result with its error.
    """
    failed_here = F.col("err").isNotNull()
    outcomes = heads.groupBy("pair_id").agg(
        F.min(F.when(failed_here & (F.col("side") == "gold"), F.struct("alt", "err"))).alias("gold_error"),
        F.min(F.when(failed_here & (F.col("side") == "gen"), F.col("err"))).alias("gen_error"),
    )
    folded = scored.groupBy("pair_id").agg(
        F.bool_or("exact").alias("any_exact"),
        F.bool_or(F.col("exact") | F.col("subset")).alias("any_correct"),
        F.min(F.when(F.col("exact"), F.col("alt"))).alias("exact_alt"),
    )
    joined = outcomes.join(folded, "pair_id", "left")
    gold_fails = F.col("gold_error").isNotNull() & F.coalesce(
        F.col("gold_error.alt") < F.col("exact_alt"), F.lit(True)
    )
    failed = F.col("gen_error").isNotNull() | gold_fails
    return joined.select(
        "pair_id",
        (~failed & F.coalesce("any_exact", F.lit(False))).alias("exact"),
        (~failed & F.coalesce("any_correct", F.lit(False))).alias("correct"),
        F.when(~failed, F.col("exact_alt")).alias("exact_alt"),
        failed.alias("failed"),
        F.when(failed, F.coalesce("gen_error", F.col("gold_error.err"))).alias("error"),
    )


def score_pairs(
    result_rows: DataFrame, questions: DataFrame, order_parse: str = "faithful", numpy_broadcast: bool = False
) -> DataFrame:
    """Score every pair of ``result_rows`` against its question in one run.

    ``questions`` needs ``pair_id, query_category, question, sql_gold, sql_gen``.
    ``result_rows`` is read several times and should be a stored table.
    """
    heads = materialise(result_heads(result_rows))
    plan = materialise(comparison_plan(heads, questions, order_parse))
    return fold_alternatives(score_alternatives(result_rows, plan, numpy_broadcast), heads)
