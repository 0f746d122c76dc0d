"""Tables of statements against statements that are grown by rule, so that their tables are known."""

import random

from pyspark.sql import functions as F

from assayer.functions.statement import referenced_tables, tokens


def found(spark, statements):
    rows = spark.createDataFrame(list(enumerate(statements)), "i int, sql string")
    got = rows.select("i", referenced_tables(F.col("sql")).alias("t")).orderBy("i").collect()
    return [r.t for r in got]


class Grower:
    """Grows statements; ``tables`` collects what they reference, in the order of the text."""

    def __init__(self, seed):
        self.draw, self.n = random.Random(seed), 0

    def noise(self):
        return self.draw.choice(["a", "x.y", "'it''s FROM s1'", "count(*)", "extract(year from d1)", "substring(a from 2)", "/* FROM c1, c2 */ 1", "(a + b, 2)", '"FROM"'])

    def condition(self, depth):
        plain = ["a = b", "x IS NOT DISTINCT FROM y1", "k IN (1, 2)", "-- FROM c3\n 1 = 1"]
        if depth and self.draw.random() < 0.3:
            return [f"e IN ({self.select(depth - 1)})"]
        return [self.draw.choice(plain)]

    def name(self):
        self.n += 1
        return f"tab{self.n}"

    def item(self, depth):
        kind = self.draw.random()
        if depth and kind < 0.25:
            return f"({self.select(depth - 1)}) d"
        if kind < 0.35:
            return "generate_series(1, 3) g"
        name = self.name()
        if self.known and kind > 0.9:
            return self.draw.choice(sorted(self.known))
        self.tables.append(name)
        return self.draw.choice([name, f"shop.{name} s", f'"{name}" AS q', f"db.shop.`{name}`", f"{name.upper().lower()} t1"])

    def select(self, depth):
        before = set(self.known)
        head = ""
        if depth and self.draw.random() < 0.3:
            new = f"cte{self.draw.randrange(100)}"
            body = self.select(depth - 1)
            head = f"WITH {new} AS ({body}) "
            self.known.add(new)
        text = head + "SELECT " + ", ".join(self.noise() for _ in range(self.draw.randrange(1, 4))) + " FROM " + self.item(depth)
        for _ in range(self.draw.randrange(3)):
            how = self.draw.choice([",", "JOIN", "left outer join", "CROSS JOIN"])
            text += f"{how} {self.item(depth)}" if how == "," else f" {how} {self.item(depth)}"
            if "JOIN" in how.upper() and "CROSS" not in how:
                text += " ON " + "".join(self.condition(depth))
        if self.draw.random() < 0.5:
            text += " WHERE " + "".join(self.condition(depth)) + " GROUP BY a, b ORDER BY 1, c"
        self.known = before
        return text

    def statement(self):
        self.tables, self.known = [], set()
        return self.select(3), list(self.tables)


def test_grown_statements(spark):
    grower = Grower(11)
    grown = [grower.statement() for _ in range(300)]
    assert sum(len(t) for _, t in grown) > 600
    for (sql, want), got in zip(grown, found(spark, [sql for sql, _ in grown]), strict=True):
        assert got == want, sql


def test_odd_statements(spark):
    cases = {
        None: None, "": [], "FROM": [], "SELECT": [], "SELECT 1 FROM (((": [], ")) SELECT 1 FROM ok1)": ["ok1"], "SELECT 'open FROM t1": ["t1"],
        "SELECT 1 FROM tt JOIN tt ON true": ["tt"], "SELECT 1 FROM t": [], "SELECT 1 FROM Éa, éA": ["Éa", "éA"],
        "SELECT '" + "x''" * 20000 + "' FROM big1": ["big1"], "SELECT " + "(" * 300 + "1" + ")" * 300 + " FROM deep1": ["deep1"],
    }
    assert found(spark, list(cases)) == list(cases.values())


def test_tokens(spark):
    sql = "SELECT 'a''b',\"c\"\"d\" --x\n FROM/*y*/`e`.[f g] WHERE 1.5e3<>h_1"
    row = spark.createDataFrame([(sql,)], "q string").select(tokens(F.col("q")).alias("t")).first()
    assert [(t.kind[0], t.text) for t in row.t] == [
        ("w", "SELECT"), ("s", "'a''b'"), ("m", ","), ("q", '"c""d"'), ("w", "FROM"), ("q", "`e`"), ("m", "."), ("q", "[f g]"),
        ("w", "WHERE"), ("m", "1.5e3"), ("m", "<"), ("m", ">"), ("w", "h_1"),
    ]
