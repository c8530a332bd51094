import datetime as dt
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from talkscale.operators import spells
from talkscale.operators.components import components
from talkscale.sources.sqlite import SQLiteSource, read_sqlite


def smallest(edges):
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    return {x: find(x) for x in top}


@pytest.mark.parametrize("kind", ["chain", "shuffled chain", "star", "random", "odd"])
def test_components(spark, kind):
    rnd = random.Random(1)
    n = 10_000 if "chain" in kind else 2000
    if kind == "chain":
        edges = [(i, i + 1) for i in range(n)]
    elif kind == "shuffled chain":
        names = rnd.sample(range(10 * n), n)
        edges = list(zip(names, names[1:], strict=False))
    elif kind == "star":
        edges = [(n, i) for i in range(n)]
    elif kind == "random":
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(n // 2)]
    else:
        edges = [(1, 1), (None, 2), (3, 4), (4, 3), (3, 4)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = smallest([(a, b) for a, b in edges if a is not None and a != b])
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_components_of_text_and_nothing(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "a string, b string")
    assert {r.node: r.root for r in components(df).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert components(df.limit(0)).collect() == []


D = dt.date


def test_spells(spark):
    rows = [
        ("p", 1, "2020-01-01", "2020-03-31"), ("p", 1, "2020-04-01", "2020-05-01"), ("p", 1, "2020-02-01", "2020-02-02"),  # touch and inside
        ("p", 1, "2020-05-03", None), ("p", 2, "2020-01-01", "2021-01-01"), ("q", 1, None, "2019-01-01"), ("q", 1, "2021-01-01", "2020-01-01"), ("p", 1, "2020-01-01", "2020-03-31"),
    ]
    df = spark.createDataFrame(rows, "person string, kind int, start string, end string")
    got = sorted((r.person, r.kind, r.date_from, r.date_to) for r in spells.spells(df, ["person"], "start", "end", ["kind"]).collect())
    assert got == [("p", 1, D(2020, 1, 1), D(2020, 5, 1)), ("p", 1, D(2020, 5, 3), D(2099, 12, 31)), ("p", 2, D(2020, 1, 1), D(2021, 1, 1)), ("q", 1, D(1900, 1, 1), D(2019, 1, 1))]


def test_spells_of_events_and_held_on(spark):
    rows = [("f", D(2020, 1, 1), "coalition"), ("f", D(2020, 6, 1), "coalition"), ("f", D(2021, 1, 1), "opposition"), ("f", D(2022, 1, 1), None), ("g", D(2020, 1, 1), None), ("g", D(2020, 1, 5), "opposition"), ("g", D(2020, 1, 5), "coalition")]
    table = spells.spells_of_events(spark.createDataFrame(rows, "faction string, date date, status string"), ["faction"], "date", "status")
    assert sorted(map(tuple, table.collect())) == [("f", "coalition", D(2020, 1, 1), D(2020, 12, 31)), ("f", "opposition", D(2021, 1, 1), D(2021, 12, 31)), ("g", "opposition", D(2020, 1, 5), D(2099, 12, 31))]
    asked = [("f", D(2019, 1, 1)), ("f", D(2020, 12, 31)), ("f", D(2021, 1, 1)), ("f", D(2021, 1, 1)), (None, D(2021, 1, 1)), ("f", None)]
    got = spells.held_on(spark.createDataFrame(asked, "faction string, day date"), table, ["faction"], "day", "status", F.lit("none")).collect()
    assert sorted((str(r.faction), str(r.day), r.status) for r in got) == sorted([("f", "2019-01-01", "none"), ("f", "2020-12-31", "coalition"), ("f", "2021-01-01", "opposition"), ("f", "2021-01-01", "opposition"), ("None", "2021-01-01", "none"), ("f", "None", "none")])


def test_versioned(spark):
    names = spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string")
    changes = spark.createDataFrame([(1, "2024-03-13", "a2"), (1, "2025-01-01", "a3"), (3, "2024-01-01", "c")], "k int, since string, name string")
    asked = [(1, D(2024, 3, 12)), (1, D(2024, 3, 13)), (1, D(2026, 1, 1)), (2, D(2026, 1, 1)), (3, D(2023, 1, 1)), (3, D(2024, 1, 1)), (9, D(2024, 1, 1)), (None, D(2024, 1, 1))]
    got = spells.versioned(spark.createDataFrame(asked, "k int, day date"), "k", "day", names, changes)
    assert {(r.k, r.day): r.name for r in got.collect()} == dict(zip(asked, ["a", "a2", "a3", "b", None, "c", None, None], strict=True))


def test_people(spark):
    persons = spark.createDataFrame([("1", " Ada ", "Day", None, None), ("2", "Bo", None, "Bo B.", True), ("3", "Cy", "C", "", False)], "person_id string, first string, last string, full_name string, is_member boolean")
    positions = spark.createDataFrame([("1", 10, None, 24, "2020-01-01", None), ("1", 5, 7, 24, "2020-01-01", None), ("1", 5, 7, 25, "2021-01-01", "2021-05-01"), ("3", 20, None, 25, "2021-01-01", "2021-02-01")], "person_id string, kind int, faction_id int, term int, start string, end string")
    named, offices, members = spells.people(persons, positions, [10], [20], 5, 25)
    assert sorted(map(tuple, named.collect())) == [("1", "Ada Day", True), ("2", "Bo B.", True), ("3", "Cy C", False)]
    assert sorted(r.person_id for r in offices.collect()) == ["1", "3"]
    assert [tuple(r) for r in members.collect()] == [("1", 7, D(2021, 1, 1), D(2021, 5, 1))]


@pytest.fixture(scope="module")
def answers(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "answers.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE answers (unit_id TEXT, "a ""b" INTEGER, score REAL, raw BLOB)')
        rows = [(f"u{i}" if i % 11 else None, i % 7 if i % 13 else "odd", i / 3 if i % 5 else None, bytes([i % 256]) if i % 3 else "text") for i in range(2500)]
        db.executemany("INSERT INTO answers VALUES (?, ?, ?, ?)", rows)
        db.execute("DELETE FROM answers WHERE rowid BETWEEN 700 AND 1500")
        db.execute("CREATE TABLE empty (x TEXT)")
        db.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, v INT) WITHOUT ROWID")
        db.execute("INSERT INTO keyed VALUES ('a', 1), ('b', 2)")
        db.execute("CREATE VIEW seen AS SELECT k FROM keyed")
    return path


def test_sqlite(spark, answers):
    load = lambda t: read_sqlite(spark, answers, t, rows=100)
    df = load("answers")
    assert df.dtypes == [("unit_id", "string"), ('a "b', "bigint"), ("score", "double"), ("raw", "binary")] and df.rdd.getNumPartitions() == 8
    with sqlite3.connect(answers) as db:
        want = db.execute("SELECT * FROM answers").fetchall()
    fixed = lambda r: (r[0], None if isinstance(r[1], str) else r[1], r[2], r[3].encode() if isinstance(r[3], str) else r[3])
    want = [fixed(r) for r in want]
    plain = lambda rows: sorted(((r[0], r[1], r[2], None if r[3] is None else bytes(r[3])) for r in rows), key=repr)
    assert plain(df.collect()) == plain(want)
    assert load("empty").count() == 0 and load("keyed").count() == 2 and load("seen").count() == 2
    with pytest.raises(Exception, match="no table"):
        load("nothing")
    a = F.col('`a "b`')
    number = lambda r: r[1] is not None
    tests = [
        (F.col("unit_id") == "u42", lambda r: r[0] == "u42"), ((a > 3) & (F.col("score") <= 100.5), lambda r: number(r) and r[1] > 3 and r[2] is not None and r[2] <= 100.5), (a.isNull(), lambda r: not number(r)), (a.isin(1, 2), lambda r: r[1] in (1, 2)),
        (F.col("unit_id").startswith("u1") & a.isNotNull(), lambda r: (r[0] or "").startswith("u1") and number(r)), (F.col("unit_id") > "u5", lambda r: r[0] is not None and r[0] > "u5"), (~(a == 2), lambda r: number(r) and r[1] != 2),
    ]
    for test, holds in tests:
        assert plain(load("answers").where(test).collect()) == plain(r for r in want if holds(r)), test


def test_sqlite_reads_only_what_is_asked(answers):
    """A pushed filter is part of what SQLite is asked."""
    from pyspark.sql.datasource import EqualTo, GreaterThan
    from talkscale.sources.sqlite import SQLiteReader

    source = SQLiteSource({"path": answers, "table": "answers"})
    reader = SQLiteReader(source.schema(), {"path": answers, "table": "answers", "partitions": "3"})
    left = list(reader.pushFilters([GreaterThan(('a "b',), 3), EqualTo(("unit_id",), "u4")]))
    assert left == [EqualTo(("unit_id",), "u4")]
    parts = reader.partitions()
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(parts) == 3 and [(r["unit_id"], r['a "b']) for r in rows] == [("u4", 4)]
