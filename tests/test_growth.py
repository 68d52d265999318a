"""Steps whose cost must not grow faster than the tables: what is read, shuffled and made once."""

from __future__ import annotations

import pytest

from courtline.operators import models as M
from courtline.operators import ratings as R
from courtline.plans import q_models
from courtline.sources import files as IO

SF = "/root/testdata/sf0.001"


def planned(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def counted(df):
    """The same rows, and an accumulator of how many were made."""
    made = df.sparkSession.sparkContext.accumulator(0)

    def pass_on(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return df.mapInArrow(pass_on, df.schema), made


def test_external_files_are_read_once(spark, tmp_path):
    columns = {"Season": ("int", "first", ("Season",)), "p": ("double", "number", ("Prob", "MarketProb"))}
    for name, rows in {"MOdds_a": [(1, "0.1"), (1, "0.2"), (2, "x")], "MLines_b": [(1, "0.3"), (3, "0.4"), (None, "0.5")]}.items():
        spark.createDataFrame(rows, "Season int, Prob string").coalesce(1).write.csv(f"{tmp_path}/{name}.csv", header=True)
    out = IO.scan_external_sources(spark, str(tmp_path), "M", ("odds", "lines"), columns, ["Season"])
    assert planned(out).count("FileScan csv") == 2
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, 0.3, "MLines_b.csv", 0), (3, 0.4, "MLines_b.csv", 0), (2, None, "MOdds_a.csv", 1)], key=repr)


@pytest.mark.parametrize("run", [R.bracket_reach, R.bracket_resolve])
def test_bracket_makes_its_field_once(spark, run):
    slots = spark.createDataFrame([("R1W1", "W01", "W04"), ("R1W2", "W02", "W03"), ("R2W1", "R1W1", "R1W2")], "Slot string, StrongSeed string, WeakSeed string")
    seeds, seeds_made = counted(spark.createDataFrame([(1, f"W0{i}", i) for i in range(1, 5)], "g int, Seed string, TeamID long"))
    win, win_made = counted(spark.createDataFrame([(1, a, b, 0.5 + (b - a) / 10) for a in range(1, 5) for b in range(1, 5) if a != b], "g int, TeamID long, OppID long, p double"))
    assert run(slots, seeds, win, ["g"], 2).where("Round = 2").count() > 0
    assert (seeds_made.value, win_made.value) == (4, 12)


def test_full_fit_makes_its_rows_once(spark):
    train, made = counted(spark.createDataFrame([(i, i % 2, float(i % 7)) for i in range(40)], "GameID long, Label int, x double"))
    new = spark.createDataFrame([(100, 1.0)], "GameID long, x double")
    assert M.full_fit_and_score(train, new, ["x"], M.linear).count() == 1
    assert made.value == 40


def test_calibration_fits_only_the_model_it_reads(spark, monkeypatch):
    def unwanted(features, weight=None):
        raise AssertionError("a model that nothing reads was fitted")

    monkeypatch.setattr(q_models, "MODELS", q_models.MODELS | {"gbt": unwanted, "margin": unwanted})
    assert "Calibrated" in q_models.calibrate_isotonic(spark, SF).columns


def test_edges_keep_their_places(spark, monkeypatch):
    plans, cut = [], R.checkpoint

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(R, "checkpoint", noted)
    games = spark.createDataFrame([(2000, i % 5, (i + 1 + i % 3) % 5, 70.0, 60.0) for i in range(30)], "Season int, WTeamID long, LTeamID long, WScore double, LScore double")
    assert R.pagerank_strength(games, iterations=1).count() == 5
    step = plans[2].split("InMemoryRelation")[0]  # after the edges and the first ranks; what is kept was dealt before
    left = step[step.index("ShuffledHashJoin") :].splitlines()[1:4]
    assert "Window" not in step and any("InMemoryTableScan" in at for at in left) and not any("Exchange" in at for at in left), step


def test_sweep_steps_read_their_period_and_broadcast_nothing(spark, monkeypatch):
    plans, write = [], R.written

    def noted(df, *by):
        run = df._jdf.queryExecution()
        plans.append((planned(df), int(str(run.optimizedPlan().stats().sizeInBytes()))))
        return write(df, *by)

    monkeypatch.setattr(R, "written", noted)
    rows = [(s * 1000 + i, "M", s, i % 12, i % 5, (i + 1 + i % 3) % 5, 70 + i % 7, 60) for s in (2000, 2001) for i in range(24)]
    games = spark.createDataFrame(rows, "GameID long, League string, Season int, DayNum int, WTeamID long, LTeamID long, WScore int, LScore int")
    assert R.elo_sweep(games, spark.createDataFrame([("a", 20.0, 1500.0, 0.75), ("b", 36.0, 1400.0, 0.5)], R.SETS), days=4).count() == 20
    steps = plans[3:]  # after the games, the teams of each season and the first ratings
    assert len(steps) == 6
    for plan, size in steps:
        assert plan.count("ShuffledHashJoin") == 2 and "Broadcast" not in plan and "PartitionFilters: [isnotnull(Season" in plan, plan
        assert size < 1 << 64  # not multiplied from step to step


def test_scored_joins_lines_of_its_pairs_alone(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from courtline.plans import inputs

    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (plans.append(planned(self._df)), write(self, *a, **k))[1])
    plain = inputs.view(spark, SF, "scored")
    with inputs.shared_views():
        out = inputs.view(spark, SF, "scored")
    assert sum("LeftSemi" in p for p in plans) == 1
    assert out.where("MarketProb is not null").count() > 0 and out.exceptAll(plain).count() == plain.exceptAll(out).count() == 0


def test_lookback_deals_no_period_to_one_task(spark):
    from courtline.operators import relational as RK

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = RK.lookback_days(spark.range(100).selectExpr("id % 2 AS Season", "id AS DayNum"), 10)
        assert "SortMergeJoin" not in planned(out) and out.count() == 12
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_text_is_parsed_as_time(spark):
    from courtline.operators import compose as C

    at = "2001-02-03 04:05:06.123456"
    rows = spark.createDataFrame([(2001, 2, 1, 40.0, at), (2001, 2, 1, 30.0, at)], "Season int, T1 long, T2 long, YesCents double, SnapshotTime string")
    read = lambda df: [(r.T1, r.T2, round(r.MarketProb, 6), str(r.SnapshotTime)) for r in C.prediction_market_convert(df, "YesCents").collect()]
    typed = rows.withColumn("SnapshotTime", rows.SnapshotTime.cast("timestamp"))
    assert read(rows) == read(typed) == [(1, 2, 0.7, at)]
    assert "gettimestamp" not in planned(C.prediction_market_convert(typed, "YesCents")).lower()


def test_json_documents_keep_odd_texts(spark, tmp_path):
    import duckdb

    from courtline import catalog

    odd = [(None, "no id", " a "), (1, "", "w"), (2, "   ", "w"), (3, "\u00a0x\u3000", "w"), (4, None, "w"), (5, "t", ""), (6, "t", None), (-3, "\n x \t\r\n", "n"), (8, " a\u0000b\u0085\ufeff", "n"), (10, "\\u0041 \"{}\" \x1f", "n"), (None, None, None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, source string")
    long = spark.range(1).selectExpr("11L AS doc_id", "repeat('abcdefghi ', 2100000) AS text", "'w' AS source")  # more than the parser takes by itself
    docs.unionByName(long).write.parquet(f"{tmp_path}/documents.parquet")
    out = catalog.queries()["scan_jsonl_documents"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()["scan_jsonl_documents"]).fetchall()
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, want))


def test_bracket_scores_every_world_with_its_play_in(spark):
    """Against all outcomes of four games: a play-in, two first games and a final."""
    from itertools import product
    from math import exp, log

    slots = spark.createDataFrame([("W04", "W04a", "W04b"), ("R1W1", "W01", "W04"), ("R1W2", "W02", "W03"), ("R2W1", "R1W1", "R1W2")], "Slot string, StrongSeed string, WeakSeed string")
    seeds = {"W01": 1, "W02": 2, "W03": 3, "W04a": 4, "W04b": 5}
    score = lambda a, b: 1 / (1 + exp((a - b) * 0.4))
    pairs = [("M", a, b, score(a, b)) for a in range(1, 6) for b in range(1, 6) if a != b]
    field = spark.createDataFrame([("M", s, t) for s, t in seeds.items()], "League string, Seed string, TeamID long")
    out = R.bracket_expected_brier(slots, field, spark.createDataFrame(pairs, "League string, TeamID long, OppID long, p double"), {"plain": 1.0, "close": 1.75}, ["League"], 2)
    got = {(r.Scenario, r.Temperature, r.League, r.Round): (r.Games, r.ExpectedBrier, r.FavoriteRate) for r in out.collect()}
    for name, t in (("plain", 1.0), ("close", 1.75)):
        sums = {r: [0.0, 0.0, 0.0] for r in (0, 1, 2)}
        for wins in product((True, False), repeat=4):
            chance, games, at = 1.0, [], dict(seeds)
            for (slot, a, b, r), first in zip((("W04", "W04a", "W04b", 0), ("R1W1", "W01", "W04", 1), ("R1W2", "W02", "W03", 1), ("R2W1", "R1W1", "R1W2", 2)), wins, strict=True):
                s = score(at[a], at[b])
                q = 1 / (1 + exp(-log(s / (1 - s)) / t))
                chance *= q if first else 1 - q
                games.append((r, (s - first) ** 2, first == (s >= 0.5)))
                at[slot] = at[a] if first else at[b]
            for r, brier, favourite in games:
                sums[r] = [x + chance * y for x, y in zip(sums[r], (1, brier, favourite), strict=True)]
        sums[None] = [sum(v[i] for v in sums.values()) for i in range(3)]
        for r, (n, b, f) in sums.items():
            assert got[name, t, "M", r] == pytest.approx((n, b / n, f / n))
        assert got[name, t, None, None] == pytest.approx(got[name, t, "M", None])
    assert len(got) == 2 * 5


def test_ranks_keep_their_places(spark, monkeypatch):
    plans, cut = [], R.checkpoint

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(R, "checkpoint", noted)
    monkeypatch.setattr(R, "EDGES", 10)
    games = spark.createDataFrame([(2000, i % 5, (i + 1 + i % 3) % 5, 70.0, 60.0) for i in range(30)], "Season int, WTeamID long, LTeamID long, WScore double, LScore double")
    before = [spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")]
    assert R.pagerank_strength(games, iterations=2).count() == 5
    assert before == [spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")]
    for step in plans[2:]:
        dealt = [at for at in step.split("InMemoryRelation")[0].splitlines() + step.split("Scan ExistingRDD")[-1].splitlines() if "Exchange hashpartitioning" in at and "TeamID" in at]
        assert not dealt and "hashpartitioning(Season" in step, step


def test_pairs_deal_a_row_a_bounded_number_of_times(spark, monkeypatch):
    from courtline.operators import relational as RK

    placed, cut = [], RK.checkpoint
    monkeypatch.setattr(RK, "checkpoint", lambda df: placed.append(cut(df)) or placed[-1])
    monkeypatch.setattr(RK, "BLOCKS", 4)
    rows = spark.range(100).selectExpr("2001 AS Season", "id * 3 AS TeamID").unionByName(spark.range(5).selectExpr("2002 AS Season", "id AS TeamID"))
    known = spark.createDataFrame([(2001, 0, 297, 1.0), (2002, 0, 4, 2.0)], "Season int, T1 long, T2 long, v double")
    pairs = RK.pair_rows(rows, known=known, block=2).collect()
    assert len({(r.Season, r.T1, r.T2) for r in pairs}) == len(pairs) == 100 * 99 // 2 + 10 and all(r.T1 < r.T2 for r in pairs)
    assert sorted((r.Season, r.T1, r.T2, r._known.v) for r in pairs if r._known) == [(2001, 0, 297, 1.0), (2002, 0, 4, 2.0)]
    assert [(r.Season, r.n) for r in placed[0].groupBy("Season").agg({"_last": "max"}).withColumnRenamed("max(_last)", "n").orderBy("Season").collect()] == [(2001, 3), (2002, 2)]


def test_scored_table_check_makes_its_pairs_once_a_pass(spark, monkeypatch):
    from courtline import catalog
    from courtline.operators import release as L

    passes, cut = [], L.checkpoint
    monkeypatch.setattr(L, "checkpoint", lambda df: passes.append(planned(df)) or cut(df))
    passes.append(planned(catalog.queries()["scored_table_check"](spark, SF)))
    assert [p.count("Generate explode(_right") for p in passes] == [1, 1]
