"""The filter audit against applying every order to every document."""

import random
from itertools import permutations

import duckdb
import pytest

from courtline.llm.filter_audit import OP11_SQL, audit, mask_counts, order_at, removal_intervals
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"


def words(text):
    for c in SPACES[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def fails(rows, i):
    doc, text = rows[i][0], rows[i][1] or ""
    w = words(text)
    return {
        "A": len(w) < 50,
        "B": 100 * len(set(w)) < 65 * len(w),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": doc is not None and any(o is not None and o < doc and (t or "") == text for o, t, _ in rows),
    }


def brute(rows, labels):
    mark = lambda doc, at: int(doc is not None and any(row[0] == doc and row[at] == 1 for row in labels))
    failing = [fails(rows, i) for i in range(len(rows))]
    out, orders = [], ["".join(p) for p in permutations("ABCDE")]
    for part in {s or "" for _, _, s in rows}:
        mine = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        removed, steps = {}, []
        for order in orders:
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [i for i in left if failing[i][f]]
                left = [i for i in left if not failing[i][f]]
                removed[f] = removed.get(f, 0) + len(gone)
                steps.append((part, order, step, len(left), len(gone), sum(failing[i][f] for i in mine) - len(gone), sum(failing[i][f] and sum(failing[i].values()) == 1 for i in mine), sum(mark(rows[i][0], 1) for i in gone), sum(mark(rows[i][0], 2) for i in gone), f))
        out += [(*s[:-1], removed[s[-1]]) for s in steps]
    return sorted(out)


def corpus():
    rng = random.Random(2)
    pool = [" ".join(rng.choice(["wort", "Éa", "mot\x0b", "x", "Big", "y#", "z z", *map(str, range(90))]) for _ in range(rng.choice([3, 60, 80]))) for _ in range(25)] + [None, "", " \t\n", "A", "é" * 19 + "A", "é" * 18 + "A"]
    rows = [(d if rng.random() > 0.1 else None, rng.choice(pool), rng.choice(["s", "s", "s", None, "", "t"])) for d in range(150)]
    rows += [rows[3], rows[4], (rows[5][0], "another text", "t")]  # repeated rows, one doc_id with two texts
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in range(0, 150, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, 1, 0, "m") for r in rows], "doc_id long, text string, source string, quality int, mask int, part string").repartition(3)
    return rows, labels, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_audit_applies_every_order(tables):
    rows, labels, docs, marks = tables
    out = audit(mask_counts(docs, marks), "ABCDE").collect()
    assert sorted(map(tuple, out)) == brute(rows, labels)


def test_sql_gives_the_same(tables):
    rows, labels, docs, marks = tables
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", marks.toPandas())
    names = "part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley"
    con.execute(f"CREATE TABLE out AS {OP11_SQL.replace('coalesce(text', 'coalesce(CAST(text AS VARCHAR)')}")
    assert sorted(con.sql(f"SELECT {names} FROM out").fetchall()) == brute(rows, labels)


def test_empty_tables(tables):
    _, _, docs, marks = tables
    assert audit(mask_counts(docs.where("false"), marks), "ABCDE").count() == 0
    without = audit(mask_counts(docs, marks.where("false")), "ABCDE")
    assert without.count() and without.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_own_checks_and_numbers_of_filters(spark, tables):
    _, _, docs, marks = tables
    out = audit(mask_counts(docs, marks, {"L": F.length("text") > 30}), "LE")
    assert out.select("filter_order").distinct().count() == 2 and out.groupBy("part", "filter_order").count().where("count <> 2").isEmpty()
    with pytest.raises(ValueError, match="filters"):
        removal_intervals(8)


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_intervals_are_the_first_failing_steps(k):
    orders = [order_at(r, k) for r in range(len(list(permutations(range(k)))))]
    assert orders == [list(p) for p in permutations(range(k))]
    found = {(m, r): s for m, s, low, high in removal_intervals(k) for r in range(low, high)}
    for mask in range(1, 1 << k):
        for r, order in enumerate(orders):
            assert found[mask, r] == next(s for s, f in enumerate(order, 1) if mask >> f & 1)
