"""Comparing two large result frames with known schemas.

All work stays on native typed columns: one aggregation pass per frame and one
shuffle keyed by row content settle the common cases. Where floating columns differ
a little, columns are paired from the same profiles, both results are cut into
slices by their sorted content, and rows of equal rank are compared. Only a
question that asks for an order goes through the long form of ``score``, which
gives the same verdicts; of contested columns it sees these alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.cells import ATOL, MISSING, RTOL, UNEQUAL_NULL_TAGS, cell_parts, content_sums, digest, is_close, tag_of
from assayer.functions.ordering import stated_order, wants_order
from assayer.operators.capture import long_rows, outcome_row, unique_labels
from assayer.operators.ordered import heavy_keys, ranked
from assayer.operators.score import comparison_plan, result_heads, score_alternatives, tolerant_matches
from assayer.session import in_pool, materialise


def relabel(df: DataFrame) -> DataFrame:
    """Make repeated column names unique by their position."""
    names = unique_labels(df.columns)
    return df if names == df.columns else df.toDF(*names)


def drop_duplicates(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Distinct rows, NULL equal to NULL, each at its first place."""
    keys = [c for c in df.columns if c != pos]
    return df.groupBy(*keys).agg(F.min(pos).alias(pos))


def by_name(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Columns in code-point order of their names, the place last."""
    return df.select(*sorted(c for c in df.columns if c != pos), pos)


def canonical_order(df: DataFrame, keys: list[str], descending: bool = False, pos: str = "pos") -> DataFrame:
    """Renumber rows by (keys, other columns), one direction, NULLs last; keys move last."""
    others = [c for c in df.columns if c not in keys and c != pos]
    markers = {c: F.when(F.col(c).isNull(), -1 if descending else 1).otherwise(0) for c in keys + others}
    order = []
    marked = df.drop(pos)
    for i, c in enumerate(keys + others):
        marked = marked.withColumn(f"_null{i}", markers[c])
        order += [f"_null{i}", c]
    placed = ranked(marked, [], order, into=pos)
    if descending:
        total = marked.agg(F.count(F.lit(1)).alias("_total"))
        placed = placed.crossJoin(F.broadcast(total)).withColumn(pos, F.col("_total") + 1 - F.col(pos))
    return placed.select(*others, *keys, (F.col(pos) - 1).alias(pos))


def normalise(
    df: DataFrame, category: str, question: str, sql: str | None = None, pos: str = "pos", order_parse: str = "faithful"
) -> DataFrame:
    """The whole normal form of one result: distinct, columns and rows in order."""
    intent, stated, keys, descending = _order_of(df.sparkSession, category, question, sql, order_parse)
    body = by_name(drop_duplicates(relabel(df), pos), pos)
    if intent and not stated:
        placed = ranked(body.withColumnRenamed(pos, "_at"), [], ["_at"], into=pos)
        return placed.withColumn(pos, F.col(pos) - 1).drop("_at")
    if not intent:
        return canonical_order(body, sorted(c for c in body.columns if c != pos), pos=pos)
    return canonical_order(body, [k for k in keys if k in body.columns and k != pos], descending, pos)


def _order_of(spark, category, question, sql, order_parse="faithful"):
    """Ordering intent, and whether and how the statement sorts; one literal row."""
    text = F.lit(sql).cast("string")
    row = (
        spark.range(1)
        .select(
            wants_order(F.lit(category), F.lit(question)).alias("intent"),
            stated_order(text, order_parse == "robust").alias("o"),
        )
        .first()
    )
    return row.intent, row.o.stated, list(dict.fromkeys(row.o["keys"])), row.o.descending


def _tags(df: DataFrame) -> dict[str, str]:
    return {f.name: tag_of(f.dataType) for f in df.schema.fields}


def _with_parts(df: DataFrame, columns: list[str], keep: list[str]) -> tuple[DataFrame, list[list[str]]]:
    """The cells of the columns as native columns k, v, t, without parts a type never has."""
    picked, names = [], []
    for i, c in enumerate(columns):
        parts = zip("kvt", cell_parts(F.col(c), df.schema[c].dataType))
        present = [(f"{letter}{i}", part) for letter, part in parts if part is not None]
        picked += [part.alias(name) for name, part in present]
        names.append([name for name, _ in present])
    return df.select(*picked, *keep), names


def same_rows(gold: DataFrame, gen: DataFrame, gold_cols: list[str], gen_cols: list[str]) -> DataFrame:
    """One row: do the paired columns hold the same set of distinct rows?

    Only digests of the rows are shuffled, and those of rows that are not frequent
    before they are gathered: a task that got most rows of a frame need not hold
    them, nor one the copies of a row.
    """

    def side(df, cols, flag):
        cells, names = _with_parts(df, cols, [])
        flat = [n for part in names for n in part]
        return cells.select(*digest(flat), F.lit(flag).alias("in_gold"), F.lit(not flag).alias("in_gen"))

    both = side(gold, gold_cols, True).unionByName(side(gen, gen_cols, False))
    heavy = heavy_keys(both, ["d0", "d1"])
    marked = both.withColumn("_hash", F.xxhash64("d0", "d1")).join(F.broadcast(heavy), "_hash", "left")

    def gathered(rows: DataFrame) -> DataFrame:
        return rows.groupBy("d0", "d1").agg(F.bool_or("in_gold").alias("in_gold"), F.bool_or("in_gen").alias("in_gen"))

    frequent, rest = marked.where("_salts IS NOT NULL"), marked.where("_salts IS NULL")
    seen = gathered(frequent).unionByName(gathered(rest.drop("_hash", "_salts").repartition("d0", "d1")))
    return seen.agg(F.coalesce(F.bool_and(F.col("in_gold") & F.col("in_gen")), F.lit(True)).alias("same"))


def frame_profile(df: DataFrame, pos: str | None = None) -> DataFrame:
    """One row: the row count and, per column, sums that identify its values."""
    columns = [c for c in df.columns if c != pos]
    cells, names = _with_parts(df, columns, [pos] if pos else [])
    tags = _tags(df)
    aggregates = [F.expr("count(1) AS n")]
    for i, (c, parts) in enumerate(zip(columns, names)):
        aggregates += [F.expr(f"count(CASE WHEN k{i} = '{MISSING}' THEN 1 END) AS x{i}"), *content_sums(parts, f"m{i}_")]
        if tags[c] == "f":
            aggregates += [F.expr(f"min(v{i}) AS lo{i}"), F.expr(f"max(v{i}) AS hi{i}")]
        if pos:
            aggregates += content_sums([pos, *parts], f"p{i}_")
    return cells.agg(*aggregates)


def _sums(row, prefix: str, i: int) -> tuple:
    return tuple(row[f"{prefix}{i}_{s}{k}"] for s in range(2) for k in range(3))


def compare_frames(
    gold: DataFrame,
    gen: DataFrame,
    category: str = "",
    question: str = "",
    gold_sql: str | None = None,
    gen_sql: str | None = None,
    pos: str | None = None,
    order_parse: str = "faithful",
) -> DataFrame:
    """One row ``(exact, subset)`` for two results.

    ``pos`` names a column present in both frames that numbers their rows from
    0; it is needed when the question asks for an order, and enables the
    position by position shortcut. Only the two profile rows reach the driver.
    """
    spark = gold.sparkSession
    intent, gold_stated, gold_keys, gold_desc = _order_of(spark, category, question, gold_sql, order_parse)
    if intent and pos is None:
        raise ValueError("a question that asks for an order needs the row positions")

    gold, gen = relabel(gold), relabel(gen)
    gold_cols = [c for c in gold.columns if c != pos]
    gen_cols = [c for c in gen.columns if c != pos]
    if intent:
        long, plan = _long_form(gold, gen, category, question, gold_sql, gen_sql, pos, order_parse)
        return score_alternatives(long, plan, skip_exact=False).select("exact", "subset")
    gold_tags, gen_tags = _tags(gold), _tags(gen)
    same_width = len(gold_cols) == len(gen_cols)
    passes = [lambda: frame_profile(gold, pos), lambda: frame_profile(gen, pos)]
    if same_width:
        passes.append(lambda: same_rows(gold, gen, sorted(gold_cols), sorted(gen_cols)))
    # The passes are independent of each other, so they run side by side.
    g, n, *sets = in_pool(spark, passes, lambda made: made().first(), len(passes))

    def verdict(exact: bool, subset: bool) -> DataFrame:
        return spark.range(1).select(F.lit(exact).alias("exact"), F.lit(subset).alias("subset"))

    def nulls_differ(row, i, tag):
        return row[f"x{i}"] > 0 and tag in UNEQUAL_NULL_TAGS

    exact = same_width and sets[0].same
    if same_width and not exact and pos and g.n == n.n:
        exact = all(
            _sums(g, "p", i) == _sums(n, "p", i)
            and not nulls_differ(g, i, gold_tags[a])
            and not nulls_differ(n, i, gen_tags[b])
            for i, (a, b) in enumerate(zip(gold_cols, gen_cols))
        )
    if g.n == 0 or g.n != n.n:
        return verdict(exact, False)
    edges = [
        (i, j, _sums(g, "m", i) == _sums(n, "m", j))
        for i, a in enumerate(gold_cols)
        for j, b in enumerate(gen_cols)
        if _sums(g, "m", i) == _sums(n, "m", j) or (gold_tags[a] == gen_tags[b] == "f" and _may_be_close(g, i, n, j))
    ]
    if len({i for i, _, _ in edges}) < len(gold_cols):
        return verdict(exact, False)
    # Where every column has one possible partner, the rows decide on the columns too.
    forced = len(edges) == len({i for i, _, _ in edges}) == len({j for _, j, _ in edges})
    unsure = [(i, j) for i, j, sure in edges if not sure]
    kept = set(edges)
    if unsure and not forced:
        close = _close_columns(gold, gen, [(gold_cols[i], gen_cols[j]) for i, j in unsure])
        kept = {(i, j, sure) for i, j, sure in edges if sure or (gold_cols[i], gen_cols[j]) in close}
    taken = _assigned([sorted(j for k, j, _ in kept if k == i) for i in range(len(gold_cols))])
    if taken is None:
        return verdict(exact, False)
    matched = {a: gen_cols[j] for a, j in zip(gold_cols, taken)}
    order = sorted(gold_cols)
    aligned = same_width and dict(zip(order, sorted(gen_cols))) == matched
    if aligned and exact and sets[0].same:
        return verdict(exact, True)
    partners = [matched[a] for a in order]
    floating = [gold_tags[a] == gen_tags[b] == "f" for a, b in zip(order, partners)]
    if not any(floating):
        return verdict(exact, same_rows(gold, gen, order, partners).first().same)
    if not aligned and not unsure and same_rows(gold, gen, order, partners).first().same:
        return verdict(exact, True)
    distinct, near = close_rows(gold, gen, order, partners, floating)
    if near and unsure and forced and distinct < g.n:
        # Rows that repeat hide how often a value occurs, so columns taken on trust are tested after all.
        trusted = [(gold_cols[i], gen_cols[j]) for i, j in unsure]
        near = _close_columns(gold, gen, trusted) == set(trusted)
    return verdict(exact, near)


def _assigned(options: list[list[int]]) -> list[int] | None:
    """Gold columns in order take the first generated column still free."""
    taken: list[int] = []
    for wanted in options:
        free = [j for j in wanted if j not in taken]
        if not free:
            return None
        taken.append(free[0])
    return taken


def _close_columns(gold: DataFrame, gen: DataFrame, pairs: list[tuple[str, str]]) -> set[tuple[str, str]]:
    """Which of the pairs of floating columns agree within tolerance once sorted; other columns are not read."""
    sides = []
    for df, side, cols in ((gold, "gold", [a for a, _ in pairs]), (gen, "gen", [b for _, b in pairs])):
        alt = 0 if side == "gold" else None
        rows = long_rows(df.select(*cols), F.lit(0), side, F.monotonically_increasing_id(), cols, alt)
        sides.append(rows.select("pair_id", F.lit(0).alias("alt"), "side", "pos", "vals"))
    numbers = range(len(pairs))
    asked = gold.sparkSession.createDataFrame([(0, 0, i, i) for i in numbers], "pair_id bigint, alt int, g_col int, n_col int")
    found = tolerant_matches(sides[0].unionByName(sides[1]), asked)
    return {pairs[row.g_col] for row in found.collect()}  # columns, not rows


def close_rows(gold: DataFrame, gen: DataFrame, gold_cols: list[str], gen_cols: list[str], floating: list[bool]) -> tuple[int, bool]:
    """Number of distinct rows of ``gold`` in the paired columns, and whether both sides agree row by row once sorted.

    Floating columns may differ within tolerance. Both sides are cut into range
    slices; the rank of a row is what lies before its slice and its place in it.
    """

    def side(df: DataFrame, cols: list[str], name: str) -> DataFrame:
        cells, _ = _with_parts(df, cols, [])
        return cells.distinct().withColumn("side", F.lit(name))

    both = side(gold, gold_cols, "gold").unionByName(side(gen, gen_cols, "gen"), allowMissingColumns=True)
    parts = [[c for c in (f"{letter}{i}" for letter in "kvt") if c in both.columns] for i in range(len(gold_cols))]
    flat = [c for cell in parts for c in cell]
    placed = ranked(both, ["side"], flat)

    def rows(name: str, prefix: str) -> DataFrame:
        return placed.filter(F.col("side") == name).select("rank", F.struct(*flat).alias(prefix))

    same = F.lit(True)
    for i, cell in enumerate(parts):
        equal = F.lit(True)
        for c in cell:
            equal = equal & F.col(f"g.{c}").eqNullSafe(F.col(f"n.{c}"))
        if floating[i]:
            equal = equal | F.coalesce(is_close(F.col(f"g.v{i}"), F.col(f"n.v{i}")), F.lit(False))
        same = same & equal
    facing = rows("gold", "g").join(rows("gen", "n"), "rank", "full")
    missing = F.col("g").isNull() | F.col("n").isNull()
    found = facing.agg(F.count("g").alias("distinct"), F.coalesce(F.bool_and(~missing & same), F.lit(True)).alias("near")).first()
    return found.distinct, found.near


def _may_be_close(g, i: int, n, j: int) -> bool:
    """Could two floating columns agree within tolerance, judged by their extremes?"""

    def near(a, b) -> bool:
        return (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=2 * RTOL, abs_tol=2 * ATOL))

    return g[f"x{i}"] == n[f"x{j}"] and near(g[f"lo{i}"], n[f"lo{j}"]) and near(g[f"hi{i}"], n[f"hi{j}"])


def _long_form(gold, gen, category, question, gold_sql, gen_sql, pos, order_parse) -> tuple[DataFrame, DataFrame]:
    """The long rows of both frames and their comparison plan."""
    spark = gold.sparkSession

    def rows(df, side, alt):
        cols = [c for c in df.columns if c != pos]
        at = F.col(pos) if pos else F.monotonically_increasing_id()
        body = long_rows(df, F.lit(0), side, at, cols, alt)
        return body.unionByName(outcome_row(spark, 0, side, alt, df.select(*cols), None))

    asked = spark.createDataFrame(
        [(0, category, question, gold_sql, gen_sql)],
        "pair_id bigint, query_category string, question string, sql_gold string, sql_gen string",
    )
    long = rows(gold, "gold", 0).unionByName(rows(gen, "gen", None))
    return long, materialise(comparison_plan(result_heads(long), asked, order_parse))
