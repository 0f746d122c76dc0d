"""Statements as tokens: which names in them are tables.

A statement is cut into tokens once: strings, comments, quoted names, words, numbers
and marks. One fold over them keeps a level for each open bracket, with the clause
the level is in, so that a derived table, a function's own FROM or a comma in a
select list is never mistaken for a list of tables, and a list goes on behind them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions.bind import let

#: In turn: string, quoted names of three styles, comments, word, number, any other mark.
TOKEN = (
    r"'[^']*+(?:''[^']*+)*+'"
    r'|"[^"]*+(?:""[^"]*+)*+"'
    r"|`[^`]*+`|\[[^\[\]]*+\]"
    r"|--[^\n]*+|/\*(?s:.*?)\*/"
    r"|[\p{L}_][\p{L}\p{N}_$]*+|[0-9][0-9A-Za-z_.]*+|\S"
)
_END = ";"
# Words that end a list of tables.
ENDS = (
    "WHERE GROUP HAVING ORDER LIMIT OFFSET FETCH UNION EXCEPT INTERSECT MINUS WINDOW QUALIFY SET RETURNING OPTION FOR"
).split()

# What a level is in: EXPRESSION, ARGUMENTS (a FROM in them is no clause), TABLE (a table comes next), NAMED (it has
# come, but a dot or a bracket may follow), LISTED (behind a table), CONDITION (of a join), WITH (names that are defined).
EXPRESSION, ARGUMENTS, TABLE, NAMED, LISTED, CONDITION, WITH = "e", "a", "t", "n", "l", "c", "w"
STARTS = "SELECT WITH RECURSIVE FROM JOIN APPLY STRAIGHT_JOIN INTO UPDATE ON USING LATERAL ONLY OUTER VALUES".split()
# Any other token only matters next to one of these.
SPECIAL = [*STARTS, *ENDS, "(", ")", ",", ".", _END]

_DEFINITION = "struct<name:string,depth:int,recursive:boolean,body:boolean>"
_STATE = f"struct<levels:string,name:string,defines:array<{_DEFINITION}>,scope:array<struct<name:string,depth:int>>,found:array<string>>"


def tokens(sql: Column) -> Column:
    """Array of (kind, text) without comments; kinds are string, quoted, word and mark (numbers too)."""

    def described(text: Column) -> Column:
        head = F.substring(text, 1, 1)
        quoted = head.isin('"', "`", "[") & (F.length(text) > 1)
        kind = (
            F.when((head == "'") & (F.length(text) > 1), "string")
            .when(quoted, "quoted")
            .when(head.rlike(r"[\p{L}_]"), "word")
            .otherwise("mark")
        )
        return F.struct(kind.alias("kind"), text.alias("text"))

    cut = F.regexp_extract_all(sql, F.lit(TOKEN), F.lit(0))
    spoken = F.filter(cut, lambda t: ~(t.startswith("--") | (t.startswith("/*") & (F.length(t) > 1))))
    return F.transform(spoken, described)


#: Blanks and comments between two tokens.
GAP = r"(?:\s|--[^\n]*+|/\*(?s:.*?)\*/)++"

# What a literal may stand behind without deciding how a statement is analysed.
COMPARISONS = ["=", "<", ">", "LIKE", "ILIKE", "BETWEEN", "AND", "OR"]


def shape(sql: Column) -> Column:
    """The statement with compared literals turned into typed slots, comments and line breaks into blanks.

    Statements of one shape are valid in a schema or aren't for the same reason. Only
    strings without escapes and whole numbers of up to nine digits become slots, and
    only right behind a comparison: ordinals, limits, formats, arguments, types and
    quoted names stay, and so does which marks touch each other.
    """

    def short(text: Column) -> Column:
        return F.when(text.rlike(r"\A(?:\s|--|/\*)"), " ").otherwise(text)

    def slotted(cut: Column) -> Column:
        def slot(text: Column, i: Column) -> Column:
            at = F.when(F.get(cut, i - 1) == " ", i - 2).otherwise(i - 1)
            before, further = F.upper(F.get(cut, at)), F.coalesce(F.get(cut, at - 1), F.lit(""))
            # Behind => and -> stands an argument or a field.
            compared = before.isin(COMPARISONS) & ~((before == ">") & further.isin("=", "-", ">"))
            kind = F.when(text.rlike(r"\A'[^\\]*'\z"), "':string'").when(text.rlike(r"\A[0-9]{1,9}\z"), "':number'")
            return F.when(F.coalesce(compared, F.lit(False)), F.coalesce(kind, text)).otherwise(text)

        return F.array_join(F.transform(cut, slot), "")

    return let(F.transform(F.regexp_extract_all(F.trim(sql), F.lit(f"{GAP}|{TOKEN}"), F.lit(0)), short), slotted)


def _plain(text: Column) -> Column:
    """A name without its quotes; a quoted path names its last part."""
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    return (
        F.when(text.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"')))
        .when(text.startswith("`"), F.substring_index(inner, ".", -1))
        .when(text.startswith("["), inner)
        .otherwise(text)
    )


def _state(s: Column, **new: Column) -> Column:
    return F.struct(*[new.get(field, s[field]).alias(field) for field in ("levels", "name", "defines", "scope", "found")])


def _below(levels: Column) -> Column:
    return F.substring(levels, F.lit(1), F.length(levels) - 1)


def _put(s: Column, clause: str) -> Column:
    """The levels with the last one in another clause."""
    return F.concat(_below(s["levels"]), F.lit(clause))


def _definition(name: Column, depth: Column, recursive: Column, body: Column) -> Column:
    return F.struct(name.alias("name"), depth.alias("depth"), recursive.alias("recursive"), body.alias("body"))


def _redefined(s: Column, **new: Column) -> Column:
    """The definitions with the last one changed."""
    last = F.element_at(s["defines"], -1)
    changed = _definition(*[new.get(field, last[field]) for field in ("name", "depth", "recursive", "body")])
    return F.concat(F.slice(s["defines"], 1, F.size(s["defines"]) - 1), F.array(changed))


def _settled(s: Column, word: Column) -> Column:
    """What a name turns out to be once the token behind it is known: part of a path, a function or a table."""
    known = F.exists(s["scope"], lambda d: d["name"] == F.lower(s["name"]))
    is_table = (word != "(") & (F.length(s["name"]) > 1) & ~known
    found = F.when(is_table, F.concat(s["found"], F.array(s["name"]))).otherwise(s["found"])
    return F.when(word == ".", _state(s, levels=_put(s, TABLE))).otherwise(_state(s, levels=_put(s, LISTED), found=found))


def _opened(s: Column, clause: Column, previous: Column) -> Column:
    """An opening bracket: a level of its own, in a list of tables again a list."""
    body = (clause == WITH) & previous.isin("AS", "MATERIALIZED")
    definition = F.element_at(s["defines"], -1)
    # A recursive definition may name itself; any other is known behind its body.
    own = F.array(F.struct(definition["name"].alias("name"), definition["depth"].alias("depth")))
    scope = F.when(definition["recursive"], F.concat(s["scope"], own)).otherwise(s["scope"])
    return (
        F.when(clause == TABLE, _state(s, levels=F.concat(_put(s, LISTED), F.lit(TABLE))))
        .when(body, _state(s, levels=F.concat(s["levels"], F.lit(ARGUMENTS)), defines=_redefined(s, body=F.lit(True)), scope=scope))
        .otherwise(_state(s, levels=F.concat(s["levels"], F.lit(ARGUMENTS))))
    )


def _closed(s: Column) -> Column:
    """A closing bracket: what was defined in it is forgotten, what it defines is known from here on."""
    depth = F.length(s["levels"]) - 1

    def left(inner: Column) -> Column:
        definition = F.element_at(inner["defines"], -1)
        own = F.array(F.struct(definition["name"].alias("name"), depth.alias("depth")))
        done = (F.size(inner["defines"]) > 0) & F.when(F.size(inner["defines"]) > 0, definition["body"] & (definition["depth"] == depth))
        return F.when(
            done, _state(inner, defines=_redefined(inner, body=F.lit(False)), scope=F.concat(inner["scope"], own))
        ).otherwise(inner)

    inner = _state(
        s,
        levels=_below(s["levels"]),
        defines=F.filter(s["defines"], lambda d: d["depth"] <= depth),
        scope=F.filter(s["scope"], lambda d: d["depth"] <= depth),
    )
    plain = (F.size(s["defines"]) == 0) & (F.size(s["scope"]) == 0)
    return F.when(depth < 1, s).when(plain, _state(s, levels=_below(s["levels"]))).otherwise(let(inner, left))


def _read(s: Column, clause: Column, token: Column) -> Column:
    """Any other token may change the clause of its level."""
    word, previous = token["word"], token["previous"]
    in_list = clause.isin(LISTED, CONDITION)
    is_name = token["kind"].isin("word", "quoted")
    to = lambda c: _state(s, levels=_put(s, c))
    null, false = F.lit(None).cast("string"), F.lit(False)
    begun = F.concat(s["defines"], F.array(_definition(null, F.length(s["levels"]), false, false)))
    name = _plain(token["text"])
    in_with = (
        F.when(word == "SELECT", to(EXPRESSION))
        .when(word == "RECURSIVE", _state(s, defines=_redefined(s, recursive=F.lit(True))))
        .when(previous.isin("WITH", "RECURSIVE", ",") & is_name, _state(s, defines=_redefined(s, name=F.lower(name))))
        .otherwise(s)
    )
    in_table = (
        F.when(word == "SELECT", to(EXPRESSION))
        .when(word.isin("LATERAL", "ONLY", "OUTER", "."), s)
        .when(word == "VALUES", to(EXPRESSION))
        .when(is_name, _state(s, levels=_put(s, NAMED), name=name))
        .otherwise(to(LISTED))
    )
    behind = (
        F.when(word.isin("JOIN", "APPLY", "STRAIGHT_JOIN", ","), to(TABLE))
        .when(word.isin("ON", "USING"), to(CONDITION))
        .when(word.isin("SELECT", _END, *ENDS), to(EXPRESSION))
        .otherwise(s)
    )
    begins = (
        F.when(word == "SELECT", to(EXPRESSION))
        .when(
            ((word == "FROM") & (clause == EXPRESSION) & (previous != "DISTINCT"))
            | ((word == "JOIN") & (clause == EXPRESSION))
            | ((word == "INTO") & (previous == "INSERT"))
            | ((word == "UPDATE") & previous.isin("", _END)),
            to(TABLE),
        )
        .otherwise(s)
    )
    with_ = (word == "WITH") & previous.isin("", "(", _END)
    return (
        F.when(with_, _state(s, levels=_put(s, WITH), defines=begun))
        .when(clause == WITH, in_with)
        .when(clause == TABLE, in_table)
        .when(in_list, behind)
        .otherwise(begins)
    )


def _step(state: Column, token: Column) -> Column:
    word, previous = token["word"], token["previous"]

    def act(s: Column) -> Column:
        return let(
            F.substring(s["levels"], -1, 1),
            lambda clause: F.when(word == "(", _opened(s, clause, previous)).when(word == ")", _closed(s)).otherwise(_read(s, clause, token)),
        )

    named = F.substring(state["levels"], -1, 1) == NAMED
    return let(F.when(named, _settled(state, word)).otherwise(state), act)


def referenced_tables(sql: Column) -> Column:
    """Distinct names of tables of a statement in order, schema and quotes removed, longer than one letter.

    Found are names in the lists of FROM and JOIN, in derived tables and conditions
    too, and behind INSERT INTO and UPDATE. The FROM of a function's arguments and of
    IS DISTINCT FROM, table functions, strings and comments name no table, and neither
    does a name where WITH defines it: behind its definition (or inside, if recursive)
    up to the end of the bracket. A null statement has a null list.
    """
    end = F.array(F.struct(F.lit("mark").alias("kind"), F.lit(_END).alias("text")))

    def fold(listed: Column) -> Column:
        words = F.transform(
            listed, lambda t: F.when(t["kind"] == "word", F.upper(t["text"])).when(t["kind"] == "mark", t["text"]).otherwise("x")
        )
        return let(words, lambda w: aggregated(listed, w))

    def aggregated(listed: Column, words: Column) -> Column:
        described = F.transform(
            listed,
            lambda t, i: F.struct(
                t["kind"].alias("kind"), t["text"].alias("text"), F.get(words, i).alias("word"), F.coalesce(F.get(words, i - 1), F.lit("")).alias("previous")
            ),
        )
        special = F.transform(words, lambda w: w.isin(*SPECIAL))
        near = let(
            special,
            lambda marks: F.filter(
                described,
                lambda t, i: F.get(marks, i) | F.coalesce(F.get(marks, i - 1), F.lit(True)) | F.coalesce(F.get(marks, i - 2), F.lit(True)),
            ),
        )
        return F.aggregate(near, start, _step)["found"]

    start = F.struct(
        F.lit(EXPRESSION).alias("levels"), F.lit(None).alias("name"), F.array().alias("defines"), F.array().alias("scope"), F.array().alias("found")
    ).cast(_STATE)
    return F.array_distinct(let(F.concat(tokens(sql), end), fold))
