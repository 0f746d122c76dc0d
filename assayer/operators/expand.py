"""Gold text -> all acceptable statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.bind import let
from assayer.functions.textops import strip
from assayer.session import spread

# The repeat mark behind a brace group, and what the percent
# escape covers (from the first LIKE to the last quote).
GROUP_BY_SLOT = "GROUP BY {}"
GROUP_BY = "GROUP BY "
LIKE_PARTS = r"(?is)^(.*?)(LIKE.*')(.*)\z"


def statements(text: Column) -> Column:
    """Non-empty statements of a text, cut at every semicolon."""
    return F.filter(F.transform(F.split(text, ";"), strip), lambda s: s != "")


def brace_span(text: Column) -> Column:
    """0-based places of the first ``{`` and the next ``}``; -1, -1 if either is missing."""
    start = F.instr(text, F.lit("{")) - 1
    end = F.call_function("locate", F.lit("}"), text, start + 2) - 1
    found = (start >= 0) & (end >= 0)
    return F.struct(
        F.when(found, start).otherwise(-1).alias("start"), F.when(found, end).otherwise(-1).alias("end")
    )


#: A count this large or larger counts as this: nobody lists so many alternatives.
COUNTLESS = 1 << 61
#: Alternatives of a statement that one row makes at a time.
BLOCK = 1024


def binomials(n: Column) -> Column:
    """Rows 0 to ``n`` (at least 1) of Pascal's triangle."""
    zero = F.array(F.lit(0).cast("bigint"))

    def longer(rows: Column, _: Column) -> Column:
        last = F.element_at(rows, -1)
        row = F.zip_with(F.concat(zero, last), F.concat(last, zero), lambda a, b: F.least(a + b, F.lit(COUNTLESS)))
        return F.concat(rows, F.array(row))

    return F.aggregate(F.sequence(F.lit(1), n), F.array(F.array(F.lit(1).cast("bigint"))), longer)


def subset_at(rank: Column, n: Column, triangle: Column) -> Column:
    """Places of the non-empty subset of ``n`` things that comes at ``rank`` (from 0): smaller ones first, then by position."""
    of_size = F.element_at(triangle, n + 1)

    def size(s: Column, k: Column) -> Column:
        here = s["left"] < F.get(of_size, k)
        passed = F.struct((s["left"] - F.get(of_size, k)).alias("left"), s["size"].alias("size"))
        return F.when(s["size"] > 0, s).when(here, F.struct(s["left"].alias("left"), k.alias("size"))).otherwise(passed)

    def place(s: Column, i: Column) -> Column:
        # Subsets that hold place i next, and ``more - 1`` of those behind it.
        holding = F.coalesce(F.get(F.get(triangle, n - 1 - i), s["more"] - 1), F.lit(0).cast("bigint"))
        taken = F.struct(s["left"].alias("left"), (s["more"] - 1).alias("more"), F.concat(s["at"], F.array(i)).alias("at"))
        passed = F.struct((s["left"] - holding).alias("left"), s["more"].alias("more"), s["at"].alias("at"))
        return F.when(s["more"] == 0, s).when(s["left"] < holding, taken).otherwise(passed)

    def places(sized: Column) -> Column:
        none = F.array().cast("array<int>")
        start = F.struct(sized["left"].alias("left"), sized["size"].alias("more"), none.alias("at"))
        return F.aggregate(F.sequence(F.lit(0), n - 1), start, place)["at"]

    start = F.struct(rank.cast("bigint").alias("left"), F.lit(0).alias("size"))
    return let(F.aggregate(F.sequence(F.lit(1), n), start, size), places)


def parts(statement: Column) -> Column:
    """What its alternatives are made of: text in front of its first brace group, options, text behind, number of alternatives."""

    def by_span(span: Column) -> Column:
        inside = F.substring(statement, span["start"] + 2, span["end"] - span["start"] - 1)
        options = F.when(span["start"] >= 0, F.split(inside, ","))
        n = F.size(options)
        count = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(n, F.lit(61))) - F.when(n < 61, 1).otherwise(0)
        return F.struct(
            F.when(span["start"] < 0, statement).otherwise(F.substring(statement, F.lit(1), span["start"])).alias("head"),
            options.alias("options"),
            F.when(span["start"] >= 0, F.substring(statement, span["end"] + 2, F.length(statement))).alias("tail"),
            F.when(span["start"] < 0, F.lit(1).cast("bigint")).otherwise(count).alias("count"),
        )

    return let(brace_span(statement), by_span)


def alternatives(part: Column, first: Column, last: Column) -> Column:
    """The alternatives of a statement from rank ``first`` to ``last``, each made from its rank alone."""

    def made(triangle: Column) -> Column:
        def filled(rank: Column) -> Column:
            at = subset_at(rank, F.size(part["options"]), triangle)
            columns = F.array_join(F.transform(at, lambda i: F.get(part["options"], i)), ", ")
            slot = F.concat(F.lit(GROUP_BY), columns)
            return F.concat(part["head"], columns, F.replace(part["tail"], F.lit(GROUP_BY_SLOT), slot))

        return F.transform(F.sequence(first, last), filled)

    whole = F.array(part["head"])
    return F.when(part["options"].isNull(), whole).otherwise(let(binomials(F.size(part["options"])), made))


def acceptable_statements(text: Column) -> Column:
    """Every statement a gold text accepts, in order, as one array; ``expand_gold`` makes them as rows."""
    every = F.transform(F.transform(statements(text), parts), lambda p: alternatives(p, F.lit(0).cast("bigint"), p["count"] - 1))
    return F.flatten(every)


def expand_gold(df: DataFrame, col: str = "query", into: str = "sql", first: int | None = None, by: str | None = None, rows: int = 0) -> DataFrame:
    """One row per alternative, numbered from 0 in ``alt``; of each text only the ``first`` ones, if given.

    No cell holds more than BLOCK alternatives, whatever the number of options.
    A text without statements, or null, has no rows. The rows are dealt over all
    cores first, as a few short texts make many alternatives; by ``by``, if given,
    a column that names a row: a grouping by it then needs no further shuffle, and
    ``rows``, the number of rows, bounds what a task of it holds.
    """

    def placed(listed: Column) -> Column:
        # One text has few statements; their counts are in the row.
        def before(place: Column) -> Column:
            earlier = F.transform(F.slice(listed, F.lit(1), place), lambda p: p["count"])
            return F.aggregate(earlier, F.lit(0).cast("bigint"), lambda a, n: F.least(a + n, F.lit(COUNTLESS)))

        return F.transform(listed, lambda p, i: F.struct(before(i).alias("before"), p.alias("part")))

    keys = [f"`{f.name}`" for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    listed = let(F.transform(statements(F.col(col)), parts), placed)
    dealt = spread(df, *([f"`{by}`"] if by else keys), rows=rows)
    each = dealt.select("*", F.explode(listed).alias("_s")).withColumns({"_before": F.col("_s.before"), "_part": F.col("_s.part")}).drop("_s")
    left = F.col("_part.count") if first is None else F.least(F.col("_part.count"), F.lit(first) - F.col("_before"))
    each = each.withColumn("_take", left).where("_take > 0")
    blocks = each.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_take") - 1, F.lit(BLOCK).cast("bigint"))))
    texts = alternatives(F.col("_part"), F.col("_from"), F.least(F.col("_from") + BLOCK, F.col("_take")) - 1)
    out = blocks.select(*[F.col(f"`{c}`") for c in df.columns], "_before", "_from", F.posexplode(texts).alias("_at", into))
    alt = (F.col("_before") + F.col("_from") + F.col("_at")).cast("int").alias("alt")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], alt, into)


def escape_percent(text: Column) -> Column:
    """Double every percent sign between the first LIKE and the last quote."""
    hit = F.regexp_extract(text, LIKE_PARTS, 2)
    escaped = F.concat(
        F.regexp_extract(text, LIKE_PARTS, 1),
        F.replace(hit, F.lit("%"), F.lit("%%")),
        F.regexp_extract(text, LIKE_PARTS, 3),
    )
    return F.when(F.length(hit) > 0, escaped).otherwise(text)
