"""Schema metadata <-> DDL text, names, aliases and hints, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.bind import let
from assayer.functions.statement import referenced_tables
from assayer.functions.textops import before_first, strip, swap

# DDL phrases, hint headers and the words that cannot be aliases.
CREATE_TABLE = "CREATE TABLE "
CREATE_SCHEMA = "CREATE SCHEMA IF NOT EXISTS "
JOIN_HEADER = "\nHere is a list of joinable columns:\n"
PRUNED_JOIN_HEADER = "\nHere is a list of joinable columns with different names:\n"
ALIAS_HEADER = "Use the following table aliases when referencing tables in the query:\n"
RESERVED_WORDS = (
    "abs all and any avg as at asc bit by day dec do div end for go in is not or to"
).split()
OLDER_RESERVED_WORDS = "all and any as asc do end for in is not to".split()

# DDL type names and the Spark types that hold their values.
SPARK_TYPES = [
    (r"(big)?serial\b|bigint\b|int8\b", "bigint"),
    (r"(small)?int(eger)?[24]?\b", "int"),
    (r"double precision\b|float8?\b|double\b|real\b", "double"),
    (r"(numeric|decimal)\s*\(", "decimal("),
    (r"(numeric|decimal)\b(?!\s*\()", "decimal(38,9)"),
    (r"bool(ean)?\b", "boolean"),
    (r"timestamp(tz)?\b( with(out)? time zone)?|datetime\b", "timestamp_ntz"),
    (r"date\b", "date"),
]


def ddl_from_columns(columns: DataFrame, keys: list[str], seed: int | None = None) -> DataFrame:
    """One CREATE TABLE text per database from rows (table, ord, column_name, data_type, column_description).

    ``keys`` names the columns that identify a database, ``tab_ord`` orders its
    tables. A seed shuffles tables and the columns within them by a hash. The
    lists hold the columns of one table and the tables of one database.
    """
    name = F.when(F.contains("column_name", F.lit(" ")), F.concat(F.lit('"'), "column_name", F.lit('"'))).otherwise(
        F.col("column_name")
    )
    note = swap(F.coalesce("column_description", F.lit("")), "\n", " ")
    note = F.when(note != "", F.concat(F.lit(" --"), note)).otherwise("")
    place = F.col("ord").cast("bigint") if not seed else F.xxhash64(F.lit(seed), "column_name")
    tab_place = F.col("tab_ord").cast("bigint") if not seed else F.xxhash64(F.lit(seed), "table")
    line = F.struct(place.alias("at"), F.concat(F.lit("  "), name, F.lit(" "), "data_type").alias("head"), note.alias("note"))
    tables = columns.groupBy(*keys, "table", tab_place.alias("tab_place")).agg(
        F.array_sort(F.collect_list(line)).alias("lines")
    )
    body = F.transform(
        "lines",
        lambda c, i: F.concat(
            c["head"], F.when(i < F.size("lines") - 1, F.lit(",")).otherwise(""), c["note"], F.lit("\n")
        ),
    )
    text = F.concat(F.lit(CREATE_TABLE), "table", F.lit(" (\n"), F.array_join(body, ""), F.lit(");\n"))
    texts = tables.select(*keys, F.struct("tab_place", text.alias("text")).alias("t"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["text"]), "")
    return texts.groupBy(*keys).agg(whole.alias("ddl"))


def table_names(ddl: Column) -> Column:
    """Table names of a DDL text in order."""
    pieces = F.filter(F.split(ddl, r"\);"), lambda p: F.contains(p, F.lit(CREATE_TABLE)))
    return F.transform(pieces, lambda p: strip(F.regexp_extract(before_first(p, "("), r"(?s)CREATE TABLE (.*)", 1)))


def known_tables(ddl: Column) -> Column:
    """Distinct table names of a DDL text, lower-case and without schema."""
    pieces = F.filter(F.split(ddl, "CREATE TABLE"), lambda p: F.contains(p, F.lit("(")))
    names = F.transform(pieces, lambda p: F.lower(strip(before_first(p, "("))))
    return F.array_distinct(F.transform(names, lambda n: F.substring_index(n, ".", -1)))


def schema_names(ddl: Column) -> Column:
    """Distinct schema names used in CREATE TABLE headers."""
    tables = F.regexp_extract_all(ddl, F.lit(r"CREATE TABLE ([a-zA-Z_][a-zA-Z0-9_\.]*) \("), F.lit(1))
    qualified = F.filter(tables, lambda t: F.contains(t, F.lit(".")))
    return F.array_distinct(F.transform(qualified, lambda t: before_first(t, ".")))


def _fold_names(names: Column, text: Column, step) -> Column:
    return F.aggregate(names, text, step)


def with_schema_lines(ddl: Column, schemas: Column | None = None) -> Column:
    """Put one CREATE SCHEMA line per schema in front; later schemas end up first."""

    def lined(text: Column) -> Column:
        names = schema_names(text) if schemas is None else schemas
        return _fold_names(names, text, lambda t, s: F.concat(F.lit(CREATE_SCHEMA), s, F.lit(";\n"), t))

    return let(ddl, lined)


def ddl_without_schemas(ddl: Column) -> Column:
    """Drop schema prefixes of created tables and the CREATE SCHEMA phrases."""

    def drop(text: Column, s: Column) -> Column:
        bare = F.replace(text, F.concat(F.lit(CREATE_TABLE), s, F.lit(".")), F.lit(CREATE_TABLE))
        return F.replace(bare, F.concat(F.lit(CREATE_SCHEMA), s), F.lit(""))

    return let(ddl, lambda text: _fold_names(schema_names(text), text, drop))


def without_schemas(text: Column, ddl: Column) -> Column:
    """Drop every ``schema.`` of a DDL from a statement or an instruction text."""
    return _fold_names(schema_names(ddl), text, lambda t, s: F.replace(t, F.concat(s, F.lit(".")), F.lit("")))


def known_references(sql: Column, ddl: Column) -> Column:
    """Referenced tables the DDL knows, compared without case, in the case of the statement."""
    return let(known_tables(ddl), lambda known: F.filter(referenced_tables(sql), lambda t: F.array_contains(known, F.lower(t))))


def qualify_tables(sql: Column, tables: Column, prefix: Column) -> Column:
    """Put ``prefix.`` before every listed table that follows a blank and no dot follows."""

    def literal(text: Column) -> Column:
        return F.regexp_replace(text, r"([\\$])", r"\\$1")

    def put(text: Column, t: Column) -> Column:
        pattern = F.concat(F.lit(r"\b \Q"), t, F.lit(r"\E\b(?![\.])"))
        return F.regexp_replace(text, pattern, F.concat(F.lit(" "), literal(prefix), F.lit("."), literal(t)))

    return F.aggregate(tables, sql, put)


def statement_for_dataset(sql: Column, ddl: Column, prefix: Column) -> Column:
    """The statement without the schemas of the DDL, its known tables qualified by ``prefix``; null if it knows none of its tables."""
    return let(
        known_references(sql, ddl), lambda known: F.when(F.size(known) > 0, qualify_tables(without_schemas(sql, ddl), known, prefix))
    )


def clean_metadata(text: Column) -> Column:
    """DDL without line comments, trailing commas and join hints."""
    lines = F.transform(F.split(text, "\n"), lambda line: before_first(line, "--"))
    bare = F.array_join(lines, "\n")
    bare = strip(swap(swap(bare, ", \n);", "\n);"), ",\n);", "\n);"))
    return strip(before_first(bare, JOIN_HEADER.strip()))


def column_types(ddl: Column) -> Column:
    """Array of (table, fields) of a clean DDL text; ``fields`` is a Spark schema string."""
    pieces = F.filter(F.split(ddl, r"\);?\s*(?=CREATE|$)"), lambda p: F.contains(p, F.lit(CREATE_TABLE)))

    def fields(piece: Column) -> Column:
        body = F.regexp_replace(F.regexp_extract(piece, r"(?s)^[^(]*\((.*)$", 1), r"\s+", " ")
        # Commas inside brackets belong to a type.
        parts = F.transform(F.split(body, r",(?![^(]*\))"), strip)
        parts = F.filter(parts, lambda p: ~F.upper(p).rlike(r"^(PRIMARY KEY|FOREIGN KEY|UNIQUE|CONSTRAINT|CHECK)\b"))
        return F.array_join(F.transform(parts, one_field), ", ")

    def one_field(part: Column) -> Column:
        quoted = part.startswith('"')
        name = F.when(quoted, F.regexp_extract(part, r'^"([^"]*)"', 1)).otherwise(before_first(part, " "))
        kind = F.lower(strip(F.regexp_replace(part, r'^("[^"]*"|\S+)', "")))
        spark_type = F.lit("string")
        for pattern, target in reversed(SPARK_TYPES):
            exact = F.lit(target)
            if target == "decimal(":
                exact = F.concat(F.lit(target), F.regexp_extract(kind, r"\(([^)]*)\)", 1), F.lit(")"))
            spark_type = F.when(kind.rlike(f"^({pattern})"), exact).otherwise(spark_type)
        return F.concat(F.lit("`"), name, F.lit("` "), spark_type)

    return F.transform(
        pieces,
        lambda p: F.struct(
            strip(F.regexp_extract(before_first(p, "("), r"(?s)CREATE TABLE (.*)", 1)).alias("table"),
            fields(p).alias("fields"),
        ),
    )


def table_aliases(names: Column, reserved: list[str] | None = None) -> Column:
    """Aliases for an array of table names, as an array of (name, alias) in order.

    Tried in turn: the initials of the words (or the capitals and a closing
    digit), two letters, three letters, then letter and number. A reserved word
    or a taken alias is skipped.
    """
    banned = F.array(*[F.lit(w) for w in (reserved or RESERVED_WORDS)])

    def first_choice(name: Column) -> Column:
        initials = F.array_join(F.transform(F.split(name, "_"), lambda w: F.substring(w, 1, 1)), "")
        raised = F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30))
        capitals = F.regexp_replace(raised, r"\P{Lu}", "")
        digit = F.regexp_extract(name, r".*(\d+)$", 1)
        return F.lower(F.when(F.contains(name, F.lit("_")), initials).otherwise(F.concat(capitals, digit)))

    def step(chosen: Column, full: Column) -> Column:
        name = F.substring_index(full, ".", -1)
        letter = F.lower(F.substring(name, 1, 1))
        # One more number than there are taken aliases and reserved words.
        numbers = F.transform(
            F.sequence(F.lit(2), F.size(chosen) + F.size(banned) + 2), lambda n: F.concat(letter, n.cast("string"))
        )
        options = F.concat(
            F.array(first_choice(name), F.lower(F.substring(name, 1, 2)), F.lower(F.substring(name, 1, 3))), numbers
        )
        free = F.filter(
            options,
            lambda a: ~F.exists(chosen, lambda c: c["alias"] == a) & ~F.array_contains(banned, a),
        )
        return F.concat(chosen, F.array(F.struct(full.alias("name"), F.get(free, F.lit(0)).alias("alias"))))

    start = F.array().cast("array<struct<name:string,alias:string>>")
    return F.aggregate(names, start, step)


def older_table_aliases(names: Column) -> Column:
    """The earlier alias rule: first letter, two initials, two letters, three letters, letter and number."""
    banned = F.array(*[F.lit(w) for w in OLDER_RESERVED_WORDS])

    def step(chosen: Column, full: Column) -> Column:
        dot = F.instr(full, F.lit("."))
        name = F.when(dot > 0, F.substring(full, dot + F.lit(1), F.length(full))).otherwise(full)
        words = F.split(name, "_")
        initials = F.concat(F.substring(F.get(words, F.lit(0)), 1, 1), F.substring(F.get(words, F.lit(1)), 1, 1))
        letter = F.substring(name, 1, 1)
        numbers = F.transform(
            F.sequence(F.lit(2), F.size(chosen) + F.size(banned) + 2), lambda n: F.concat(letter, n.cast("string"))
        )
        lead = F.when(F.size(words) > 1, F.array(letter, initials)).otherwise(F.array(letter))
        options = F.concat(lead, F.array(F.substring(name, 1, 2), F.substring(name, 1, 3)), numbers)
        free = F.filter(
            options,
            lambda a: ~F.exists(chosen, lambda c: c["alias"] == a) & ~F.array_contains(banned, F.lower(a)),
        )
        return F.concat(chosen, F.array(F.struct(name.alias("name"), F.get(free, F.lit(0)).alias("alias"))))

    return F.aggregate(names, F.array().cast("array<struct<name:string,alias:string>>"), step)


def alias_text(aliases: Column) -> Column:
    """One ``-- table AS alias`` line per table."""
    return F.array_join(
        F.transform(aliases, lambda a: F.concat(F.lit("-- "), a["name"], F.lit(" AS "), a["alias"], F.lit("\n"))), ""
    )


def alias_hint(names: Column) -> Column:
    return F.concat(F.lit(ALIAS_HEADER), alias_text(table_aliases(names)))


def join_hints(joins: DataFrame) -> DataFrame:
    """``join_str`` and ``pruned_join_str`` per database from rows (db_name, ord, left_col, right_col).

    A pair is listed once, at its first place; the pruned text keeps only pairs
    whose column names differ. The lists hold the joinable pairs of one schema.
    """
    line = F.concat("left_col", F.lit(" can be joined with "), "right_col")
    differs = F.substring_index("left_col", ".", -1) != F.substring_index("right_col", ".", -1)
    lines = joins.groupBy("db_name", line.alias("line"), differs.alias("differs")).agg(F.min("ord").alias("at"))
    item = F.struct("at", "line")

    def text(header: str, items: Column) -> Column:
        listed = F.array_join(F.transform(F.array_sort(items), lambda i: i["line"]), "\n")
        return F.when(F.size(items) > 0, F.concat(F.lit(header), listed)).otherwise("")

    return lines.groupBy("db_name").agg(
        text(JOIN_HEADER, F.collect_list(item)).alias("join_str"),
        text(PRUNED_JOIN_HEADER, F.collect_list(F.when(F.col("differs"), item))).alias("pruned_join_str"),
    )
