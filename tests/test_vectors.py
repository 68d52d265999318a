"""Text vectors against NumPy, rating sweeps against separate runs, PageRank against plain iteration."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtline.operators import ratings as R
from courtline.operators import text_vectors as V


def plain_tfidf(texts, size):
    rows = []
    for t in texts:
        words = re.findall(r"\w{2,}", (t or "").lower())
        rows.append(Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))
    total = Counter()
    for r in rows:
        total.update(r)
    terms = sorted(sorted(total, key=lambda t: (-total[t], t))[:size])
    df = [sum(t in r for r in rows) for t in terms]
    x = np.array([[r[t] * (math.log((1 + len(rows)) / (1 + n)) + 1) for t, n in zip(terms, df)] for r in rows])
    return terms, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def corpus():
    rng = random.Random(1)
    pool = ["Spiel", "spiel", "défense", "BALL", "x", "rebound2", "wurf", "zone", "guard", "team", "ünder"]
    return [" ".join(rng.choice(pool) for _ in range(rng.randint(3, 40))) for _ in range(60)] + [None, "", "x y z", "wholly unknown words here", "ball " * 5000]


@pytest.mark.parametrize("size, dim", [(30, 6), (500, 12)])
def test_text_vectors_are_a_truncated_svd(spark, size, dim):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, term double").repartition(5)
    terms, x = plain_tfidf(texts, size)
    counts = V.term_counts(docs, "doc_id", "text")
    vocabulary = V.vocabulary(counts, len(texts), size)
    assert [r.term for r in vocabulary.orderBy("tid").collect()] == terms
    v, s = V.truncated_svd(V.tfidf(counts, vocabulary, "doc_id"), len(terms), dim, rounds=12)
    assert np.allclose(v.T @ v, np.eye(dim), atol=1e-9)
    want = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(s, want[:dim], rtol=1e-3)
    left = np.linalg.norm(x - x @ v @ v.T)
    assert left <= np.sqrt((want[dim:] ** 2).sum()) * 1.0001 and np.all(v[np.abs(v).argmax(axis=0), range(dim)] > 0)
    out = {r.doc_id: r.vector for r in V.text_vectors(docs, dim=dim, terms=size, rounds=12).collect()}
    got = np.array([out[i] for i in range(len(texts))])
    assert np.allclose(got @ got.T, x @ v @ v.T @ x.T, atol=1e-9) and not got[60:63].any()


def test_small_tables_of_texts(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert V.text_vectors(frame([])).count() == 0
    assert [r.vector for r in V.text_vectors(frame([(1, None), (None, "")]), dim=3).collect()] == [[0.0] * 3] * 2
    (one,) = V.text_vectors(frame([(1, "some words"), (1, "some more")]), dim=4).collect()
    assert one.vector == [0.0] * 4  # one document spans nothing beyond itself
    out = {r.doc_id: np.array(r.vector) for r in V.text_vectors(frame([(1, "alpha beta"), (2, "alpha beta"), (None, "gamma delta")]), dim=4).collect()}
    assert np.allclose(out[1], out[2]) and np.linalg.norm(out[1]) == pytest.approx(1) and abs(out[1] @ out[None]) < 1e-9 and not out[1][2:].any()


def games(seed=3, teams=6, seasons=(2000, 2001), n=40):
    rng = random.Random(seed)
    rows = []
    for s in seasons:
        for i in range(n):
            w, lo = rng.sample(range(teams), 2)
            rows.append((s * 1000 + i, "MW"[i % 2], s, i % 30, w * 2 + i % 2, lo * 2 + i % 2, 70 + rng.randrange(20), 60))
    return rows


GAMES = "GameID long, League string, Season int, DayNum int, WTeamID long, LTeamID long, WScore int, LScore int"


def plain_elo(rows, k, carry, days):
    elo, out = {}, {}
    for season in sorted({r[2] for r in rows}):
        elo = {t: 1500 + carry * (e - 1500) for t, e in elo.items()}
        mine = [r for r in rows if r[2] == season]
        for p in sorted({r[3] // days for r in mine}):
            change = Counter()
            for _, _, _, _, w, lo, ws, ls in (r for r in mine if r[3] // days == p):
                gap = elo.get(w, 1500) - elo.get(lo, 1500)
                gain = k * math.log(abs(ws - ls) + 1) * 2.2 / (abs(gap) * 0.001 + 2.2) * (1 - 1 / (1 + 10 ** (-gap / 400)))
                change[w] += gain
                change[lo] -= gain
            for t, d in change.items():
                elo[t] = elo.get(t, 1500) + d
        out |= {(season, t): elo[t] for r in mine for t in r[4:6]}
    return out


def test_sweep_equals_separate_runs(spark):
    rows = games()
    df = spark.createDataFrame(rows, GAMES)
    sets = [(f"s{i}", k, 1500.0, c) for i, (k, c) in enumerate([(10.0, 0.5), (20.0, 0.75), (36.0, 0.9)])]
    swept = {(r.Set, r.Season, r.TeamID): r.Elo for r in R.elo_sweep(df, spark.createDataFrame(sets, R.SETS), days=7).collect()}
    for name, k, _, c in sets:
        assert {(s, t): e for (n, s, t), e in swept.items() if n == name} == pytest.approx(plain_elo(rows, k, c, 7))
    alone = {(r.Season, r.TeamID): r.Elo for r in R.elo_by_period(df, 7, 20.0, 1500.0, 0.75).collect()}
    assert alone == pytest.approx({(s, t): e for (n, s, t), e in swept.items() if n == "s1"})
    results = [(lg, s, min(w, lo), max(w, lo), int(w < lo)) for _, lg, s, _, w, lo, _, _ in rows]
    scores = {(r.Set, r.League): (r.Brier, r.Best) for r in R.elo_param_sweep(df, spark.createDataFrame(results, "League string, Season int, T1 long, T2 long, Label int"), spark.createDataFrame(sets, R.SETS)).collect()}
    for league in "MW":
        brier = {}
        for name, *_ in sets:
            per = {}
            for lg, s, a, b, y in results:
                if lg == league:
                    per.setdefault(s, []).append((1 / (1 + 10 ** (-(swept[name, s, a] - swept[name, s, b]) / 400)) - y) ** 2)
            brier[name] = np.mean([np.mean(v) for v in per.values()])
        assert {n: scores[n, league][0] for n in brier} == pytest.approx(brier)
        assert [n for n in brier if scores[n, league][1]] == [min(brier, key=brier.get)]
    assert R.elo_by_period(df.where("false")).count() == 0


def test_pagerank_runs_to_its_tolerance(spark):
    rows = games(seasons=(2000,)) + [(1, "M", 2001, 1, 1, 2, 80, 60), (2, "M", 2001, 2, 3, 2, 80, 79)]
    out = {(r.Season, r.TeamID): r.PageRank for r in R.pagerank_strength(spark.createDataFrame(rows, GAMES)).collect()}
    for season in (2000, 2001):
        mine = [r for r in rows if r[2] == season]
        teams = sorted({t for r in mine for t in r[4:6]})
        w = np.zeros((len(teams), len(teams)))
        for r in mine:
            w[teams.index(r[5]), teams.index(r[4])] += 1 + min(max(r[6] - r[7], 0), 30) / 20
        p = np.full(len(teams), 1 / len(teams))
        sink = w.sum(axis=1) == 0
        share = np.where(sink[:, None], 0, w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300))
        for _ in range(80):
            p = (0.15 + 0.85 * p[sink].sum()) / len(teams) + 0.85 * p @ share
        assert {t: out[season, t] for t in teams} == pytest.approx(dict(zip(teams, p)), abs=1e-10)
        assert sum(out[season, t] for t in teams) == pytest.approx(1)
    assert R.pagerank_strength(spark.createDataFrame(rows, GAMES), iterations=1).count() == len(out)


def test_vectors_are_pooled_whole(spark):
    from courtline.operators.features import recent_vectors
    from courtline.operators.matchup import text_matchup_features

    rng = np.random.default_rng(2)
    rows = [(2000, t, i, [float(x) for x in rng.normal(size=9)]) for i, t in enumerate([1] * 7 + [2] * 2 + [3])] + [(2000, 2, 99, None), (2000, 4, 5, [1.0, 2.0]), (2000, 4, 6, [1.0, 2.0, 4.0])]
    pooled = recent_vectors(spark.createDataFrame(rows, "Season int, TeamID long, vec_id long, vector array<double>"))
    out = {r.TeamID: r for r in pooled.collect()}
    mine = np.array([r[3] for r in rows[:7]])
    assert (out[1].DocCount, out[1].WindowDocCount, out[2].DocCount) == (7, 5, 2)
    assert out[1].Mean3 == pytest.approx(mine[-3:].mean(axis=0)) and out[1].Mean5 == pytest.approx(mine[-5:].mean(axis=0))
    assert out[1].Weighted5 == pytest.approx(np.average(mine[-5:], axis=0, weights=np.linspace(1, 2, 5)))
    assert out[4].Mean3 == pytest.approx([1, 2, 2]) and out[3].Weighted5 == pytest.approx(rows[9][3])
    pairs = spark.createDataFrame([(1, 2000, 1, 2), (2, 2000, 3, 8)], "GameID int, Season int, T1 long, T2 long")
    both, names = text_matchup_features(pairs, pooled, ["Mean3"])
    found = {r.GameID: r for r in both.collect()}
    assert found[2].D_Mean3 == pytest.approx(out[3].Mean3) and found[2].Mean_Mean3 == pytest.approx(np.array(out[3].Mean3) / 2) and found[2].DocCountMin == 0
    assert found[1].AbsD_Mean3 == pytest.approx(np.abs(np.array(out[1].Mean3) - out[2].Mean3)) and found[1].D_DocCount == 5 and set(names) <= set(both.columns)
    assert both.where(F.col("T1") == 1).count() == 1


def test_field_profiles_count_no_pairs(spark):
    from courtline.operators import matchup as U

    rng = random.Random(4)
    field = [(s, t) for s, n in ((2001, 30), (2002, 2), (2003, 1), (2004, 9)) for t in range(n)] + [(2001, None), (None, 3), (2001, 5)]
    feats = [(s, t, rng.choice([None, rng.gauss(500, 2)]), float(rng.randint(0, 3)) if s != 2004 else None) for s in (2001, 2002, 2003, 2004) for t in range(30) if t != 7]
    f, x = spark.createDataFrame(field, "Season int, TeamID long"), spark.createDataFrame(feats, "Season int, TeamID long, a double, b double")
    pairs = U.R.join_pairs(f)
    plain = U.matchup_diffs(U.R.join_twice_prefixed(pairs, x), ["a", "b"]).groupBy("Season").agg(*(g(f"D_{c}").alias(f"{g.__name__}_{c}") for c in "ab" for g in (F.avg, F.stddev_samp)))
    want = {(r.Season, c): (r[f"avg_{c}"], None if r[f"stddev_samp_{c}"] is None else max(r[f"stddev_samp_{c}"], 0.1)) for r in plain.collect() for c in "ab"}
    got = {(r.Season, r.Feature): (r.FieldMean, r.FieldStd) for r in U.field_profile(f, x).collect()}
    assert got.keys() == want.keys() and all(g == pytest.approx(want[k]) for k, g in got.items())
    key = lambda r: (r.Season, r.Feature)
    own, old = ({key(r): (r.Mean, r.Scale) for r in q.collect()} for q in (U.field_kernel_profile(f, x), U.kernel_profile(pairs, x)))
    assert own.keys() == old.keys() and all(v == pytest.approx(old[k]) for k, v in own.items())


def test_field_profile_of_many_teams(spark):
    """200,000 teams make 20 billion pairs; ids as values have mean differences of a third of their number."""
    from courtline.operators import matchup as U

    n = 200_000
    field = spark.range(n).select(F.lit(2000).alias("Season"), F.col("id").alias("TeamID"))
    row = U.field_profile(field, field.withColumn("x", F.col("TeamID").cast("double"))).collect()[0]
    assert row.FieldMean == pytest.approx(-(n + 1) / 3) and row.FieldStd == pytest.approx((n * n / 18) ** 0.5, rel=1e-4)
    assert U.field_kernel_profile(field, field.withColumn("x", F.col("TeamID").cast("double"))).collect()[0].Mean == pytest.approx((n + 1) / 3)


def test_known_terms_equal_full_counts(spark):
    texts = corpus()
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "team zone"), (None, "Ball ball"), (None, "guard")]  # rows of one key, or of none, are one document
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    full = V.term_counts(docs, "doc_id", "text")
    want = V.vocabulary(full, len(texts) + 1, 30)
    terms, counts, n = V.known_terms(docs, "doc_id", "text", 30)
    assert n == len(texts) + 1 and counts.columns == ["doc_id", "tid", "tf"]
    assert sorted(map(tuple, terms.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    lists = lambda c: sorted(map(str, V.tfidf(c, want, "doc_id").collect()))
    assert lists(counts) == lists(full)
    none, no_counts, m = V.known_terms(docs.where("false"), "doc_id", "text", 30)
    assert (none.count(), no_counts.count(), m) == (0, 0, 0)
