"""Hand-made cases of nulls, ties, swaps and sequences."""

import math
import random

import pytest
from pyspark.sql import functions as F

from courtline.functions import expressions as X
from courtline.functions import filters as P
from courtline.operators import evaluate as E
from courtline.operators import features as FE
from courtline.operators import market as M
from courtline.operators import ratings as R
from courtline.operators import relational as K
from courtline.operators import rules as U
from courtline.plans.inputs import view

SF = "/root/testdata/sf0.001"


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} double" for k in values))
    return df.select(expr.alias("x")).first().x


def test_odds(spark):
    assert one(spark, X.american_to_prob("o"), o=-150.0) == pytest.approx(0.6)
    assert one(spark, X.american_to_prob("o"), o=130.0) == pytest.approx(100 / 230)
    assert one(spark, X.american_to_prob("o"), o=None) is None
    assert one(spark, X.decimal_to_prob("o"), o=0.0) is None
    assert one(spark, X.prob_to_american("p"), p=0.6) == -150
    assert one(spark, X.bias_corrected_prob("a", "b"), a=1.5, b=None) is None
    p = one(spark, X.bias_corrected_prob("a", "b"), a=1.5, b=2.6)
    q = one(spark, X.bias_corrected_prob("a", "b"), a=2.6, b=1.5)
    assert p + q == pytest.approx(1)
    assert one(spark, X.bias_corrected_prob("a", "b"), a=3.0, b=3.0) == pytest.approx(0.5)  # the book is below 1


def test_text_numbers(spark):
    df = spark.createDataFrame([("abc",), ("nan",), ("1.5",), (None,)], "t string")
    assert [r.x for r in df.select(X.number("t").alias("x")).collect()] == [None, None, 1.5, None]


def test_names(spark):
    df = spark.createDataFrame([("Miami (12)",), ("A&M",), ("Ole Miss",), (None,)], "n string")
    assert [r.x for r in df.select(X.normalize_name("n").alias("x")).collect()] == ["miami fl", "a and m", "mississippi", None]
    names = spark.createDataFrame([("duke blue devils",), ("unknown",)], "n string")
    aliases = spark.createDataFrame([("duke", 1), ("duke blue", 2)], "alias string, id int")
    assert [(r.n, r.id) for r in K.join_longest_prefix(names, "n", aliases, "alias").collect()] == [("duke blue devils", 2)]


def test_rank_ties(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 3.0), (1, 4.0), (1, None)], "g int, v double")
    got = sorted(r.x for r in df.select(K.rank_pct_average("v", "g").alias("x")).collect() if r.x is not None)
    assert got == [0.375, 0.375, 0.75, 1.0]


def test_zscore_of_one_row_is_null(spark):
    df = spark.createDataFrame([(1, 5.0)], "Season int, v double")
    assert df.select(K.zscore("v").alias("z")).first().z is None


def test_canonical_pairs_are_stable_and_mirrored(spark):
    df = spark.createDataFrame([(2000, 7, 3, 0.8, -4.0), (2000, 3, 7, 0.2, 4.0)], "Season int, T1 int, T2 int, p double, s double")
    once = M.canonicalize_pairs(df, complement=("p",), negate=("s",))
    rows = [tuple(r) for r in once.collect()]
    assert [tuple(r) for r in M.canonicalize_pairs(once, complement=("p",), negate=("s",)).collect()] == rows
    assert rows[0][3] == pytest.approx(0.2) and rows[0][4] == 4.0 and rows[0][:3] == rows[1][:3]


def test_last_non_null_prefers_untimed_rows(spark):
    df = spark.createDataFrame([(2000, 1, 2, 0.3, None, "a", 1.0), (2000, 1, 2, 0.4, "2020-01-01", "a", 1.0), (2000, 1, 2, None, "2021-01-01", "b", 1.0)], "Season int, T1 int, T2 int, MarketProb double, t string, Source string, BookCount double")
    df = df.withColumns({"SnapshotTime": F.to_timestamp("t"), "LastSpread": F.lit(None).cast("double")})
    row = M.market_consensus(df).first()
    assert row.MarketProb == 0.3 and row.MarketRowCount == 3 and row.MarketSourceCount == 2 and row.LastSpread is None


def test_streaks_break_on_gaps(spark):
    df = spark.createDataFrame([(1, 2000, "x"), (1, 2001, "x"), (1, 2003, "x"), (1, 2004, "y")], "TeamID int, Season int, CoachName string")
    got = {r.Season: (r.Streak, r.Changed) for r in K.streaks(df, "TeamID", "Season", "CoachName").collect()}
    assert got == {2000: (1, 0), 2001: (2, 0), 2003: (1, 0), 2004: (1, 1)}


def test_leak_guard_is_inclusive(spark):
    rows = spark.createDataFrame([(2000, 1, "2000-03-01 00:00:00"), (2000, 1, "2000-03-01 00:00:01"), (2001, 1, "2000-03-01 00:00:00")], "Season int, Verified int, t string").withColumn("t", F.to_timestamp("t"))
    cut = spark.createDataFrame([(2000, "2000-03-01 00:00:00")], "Season int, c string").withColumn("c", F.to_timestamp("c"))
    assert P.verified_snapshots(rows, cut, "Verified", "t", "c").count() == 1


def test_rules_keep_nulls_out(spark):
    df = spark.createDataFrame([(0.6, 1, 16, 0.99), (0.6, 16, 1, None), (0.6, None, 1, 0.2)], "p double, T1_SeedNum int, T2_SeedNum int, MarketProb double")
    got = [r.x for r in df.select(U.seed_floor(F.col("p"), 2, 15, 0.95).alias("x")).collect()]
    assert got == pytest.approx([0.95, 0.05, 0.6])
    pushed = [one(spark, U.extreme_push(F.col("p"), 0.5), p=v) for v in (0.9, 0.1, 0.5)]
    assert pushed[0] + pushed[1] == pytest.approx(1) and pushed[0] > 0.9 and pushed[2] == 0.5


def test_calibration_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0.0, 0), (0.1, 1), (1.0, 1)], "p double, Label int")
    got = {r.Bin: r.Count for r in E.calibration_bins(df, ["p"]).collect()}
    assert got == {0: 2, 9: 1} | {k: 0 for k in range(1, 9)}


def plain_elo(games, k=20.0, carry=0.75):
    rating, season, final = {}, None, {}
    for g in games:
        if g.Season != season:
            rating = {t: 1500 + carry * (r - 1500) for t, r in rating.items()}
            season = g.Season
        w, lo = rating.setdefault(g.WTeamID, 1500.0), rating.setdefault(g.LTeamID, 1500.0)
        gain = k * math.log(g.WScore - g.LScore + 1) * 2.2 / (abs(w - lo) * 0.001 + 2.2) * (1 - 1 / (1 + 10 ** ((lo - w) / 400)))
        rating[g.WTeamID], rating[g.LTeamID] = w + gain, lo - gain
        final |= {(season, t): rating[t] for t in (g.WTeamID, g.LTeamID)}
    return final


def test_elo_equals_a_plain_loop(spark):
    games = view(spark, SF, "regular")
    got = {(r.League, r.Season, r.TeamID): r.Elo for r in R.elo_ratings(games).collect()}
    for league in ("M", "W"):
        rows = games.where(F.col("League") == league).orderBy("Season", "DayNum", "GameID").collect()
        for (season, team), value in plain_elo(rows).items():
            assert got[league, season, team] == pytest.approx(value)


def test_reach_probabilities_add_up(spark):
    from courtline.plans.q_ratings import bracket_field

    reach, _ = bracket_field(spark, SF)
    sums = reach.groupBy("League", "Season", "Slot").agg(F.sum("q").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in sums)


def test_priors_ignore_their_own_season(spark):
    tourney, seeds = view(spark, SF, "tourney"), view(spark, SF, "seeds")
    flipped = tourney.withColumns({"WTeamID": F.when(F.col("Season") == 1998, F.col("LTeamID")).otherwise(F.col("WTeamID")), "LTeamID": F.when(F.col("Season") == 1998, F.col("WTeamID")).otherwise(F.col("LTeamID"))})
    at = lambda t: sorted(tuple(r) for r in FE.seed_priors(t, seeds).where("Season <= 1998").collect())
    assert at(tourney) == at(flipped)


@pytest.mark.parametrize("name", ["market_consensus", "season_efficiency", "rank_consensus"])
def test_partitioning_does_not_matter(spark, name):
    from courtline import catalog

    query = catalog.queries()[name]
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(str, query(spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]


def test_out_of_sample_scores_ignore_later_seasons(spark):
    from courtline.operators import models as ML

    rows = [(i, 2000 + i % 4, i % 2, float((i % 2) * 2 - 1) * (i % 7), float(i % 7) * (i % 2 * 2 - 1) + i % 3) for i in range(160)]
    frame = spark.createDataFrame(rows, "GameID long, Season int, Label int, MarginLabel double, D_x double")
    changed = frame.withColumn("Label", F.when(F.col("Season") == 2003, 1 - F.col("Label")).otherwise(F.col("Label")))
    score = lambda df: sorted((r.GameID, round(r.Prob_lr, 9)) for r in ML.season_forward_oof(df, ["D_x"], {"lr": ML.linear}, 2).collect())
    first = score(frame)
    assert first == score(changed) and len(first) == 80  # 2002 and 2003 only; a season's own labels don't count


def test_fuzzy_names(spark):
    from courtline.operators import resolve as N

    lookup = spark.createDataFrame([("north carolina", 1), ("south carolina", 2), ("duke", 3)], "alias string, id long")
    names = spark.createDataFrame([("north carolinna",), ("duke",), ("duke blue devils",), ("gonzaga",), (None,)], "n string")
    got = {r.n: (r.id, r.status) for r in N.resolution_audit(names, "n", lookup).collect()}
    assert got == {"north carolinna": (1, "fuzzy"), "duke": (3, "exact"), "duke blue devils": (3, "prefix"), "gonzaga": (None, "unmatched")}
    common = {r.n: r.id for r in N.resolve_fuzzy(names, "n", lookup, 60.0, common=1).collect()}  # "carolina" is too common alone
    assert common["duke"] == 3 and common["gonzaga"] is None


def test_fuzzy_names_meet_on_frequent_tokens(spark):
    from courtline.operators import resolve as N

    lookup = spark.createDataFrame([("texas tech", 1), ("texas state", 2), ("north state", 3), ("north dakota", 4)], "alias string, id long")
    names = spark.createDataFrame([("texas",), ("north statee",), ("utah",)], "n string")
    few, many = ({r.n: (r.id, r.alias, r.score) for r in N.resolve_fuzzy(names, "n", lookup, common=c).collect()} for c in (1, 1000))
    assert few == many and few["texas"][:2] == (2, "texas state") and few["north statee"][0] == 3 and few["utah"] == (None, None, None)


def test_missing_csv_is_an_empty_table(spark):
    from courtline.sources import files

    assert files.scan_csv(spark, "/tmp/no/such/file.csv", "a int, b string").count() == 0


def _forward_rows(spark):
    rows = [(i, 2000 + i % 4, i % 2, 0.3 + 0.4 * (i % 2), 0.5 + 0.01 * (i % 9), float(i % 7) * (i % 2 * 2 - 1) + i % 3, None if i % 11 == 0 else 0.5) for i in range(240)]
    frame = spark.createDataFrame(rows, "GameID long, Season int, Label int, good double, dull double, D_x double, MarketProb double")
    return frame, frame.withColumn("Label", F.when(F.col("Season") == 2003, 1 - F.col("Label")).otherwise(F.col("Label")))


@pytest.mark.parametrize("name", ["strategy", "residual", "gated"])
def test_choices_and_specialists_ignore_the_scored_season(spark, name):
    from courtline.operators import fusion as FU

    run, column = {
        "strategy": (lambda df: FU.strategy_oof(df, ["good", "dull"]), "FinalProb"),
        "residual": (lambda df: FU.market_residual_model(df, ["D_x"], since=2000, coverage=0.5), "Prob_residual"),
        "gated": (lambda df: FU.gated_expert_blend(df, "dull", ["D_x"], F.col("D_x") > -4, least_rows=20), "Prob_gated"),
    }[name]
    frame, changed = _forward_rows(spark)
    score = lambda df: sorted((r.GameID, r[column] is not None and round(r[column], 9)) for r in run(df).collect())
    first = score(frame)
    assert first == score(changed) and len(first) == 180  # all but the first season


def test_strategy_prefers_the_better_column(spark):
    from courtline.operators import fusion as FU

    frame, _ = _forward_rows(spark)
    assert {r.Strategy for r in FU.strategy_oof(frame, ["good", "dull"]).select("Strategy").distinct().collect()} == {"good"}
    row = FU.strict_holdout(frame, ["good", "dull"], 1).first()
    assert row.Strategy == "good" and row.OptimismGap == pytest.approx(row.HoldoutBrier - row.TuneBrier)


def test_bracket_resolve_lets_single_sides_through(spark):
    slots = spark.createDataFrame([("R1W1", "W01", "W04"), ("R1W2", "W02", "W03"), ("R2W1", "R1W1", "R1W2")], "Slot string, StrongSeed string, WeakSeed string")
    seeds = spark.createDataFrame([(1, "W01", 11), (1, "W02", 12), (1, "W03", 13)], "g int, Seed string, TeamID long")
    win = spark.createDataFrame([(1, 12, 13, 0.4), (1, 11, 13, 0.5)], "g int, TeamID long, OppID long, p double")
    got = {r.Slot: (r.Seed, r.TeamID, r.Round) for r in R.bracket_resolve(slots, seeds, win, ["g"], 2).collect()}
    assert got == {"R1W1": ("W01", 11, 1), "R1W2": ("W03", 13, 1), "R2W1": ("W01", 11, 2)}  # no fourth seed; half a chance is the stronger side's


def test_market_residual_without_active_seasons(spark):
    from courtline.operators import fusion as FU

    out = FU.market_residual_model(_forward_rows(spark)[0], ["D_x"])
    assert out.count() == 0 and "Prob_residual" in out.columns


def test_pairs_are_dealt_by_blocks_and_not_shuffled(spark):
    rng = random.Random(11)
    rows = [(s, t, rng.choice([None, t * 0.5])) for s, n in ((2001, 23), (2002, 1), (2003, 8), (2004, 9)) for t in rng.sample(range(-50, 50), n)]
    known = [(s, a, b, a * 1000.0 + b) for s, a, _ in rows for q, b, _ in rows if s == q and a < b and rng.random() < 0.2] + [(1999, 1, 2, 0.0), (2001, 777, 778, 0.0)]
    df = spark.createDataFrame([*rows, (2001, None, 1.0), (None, 4, 1.0)], "Season int, TeamID long, x double")
    at = {(s, a, b): v for s, a, b, v in known}
    want = sorted((s, a, b, str(x), str(y), str(at.get((s, a, b)))) for s, a, x in rows for q, b, y in rows if s == q and a < b)
    out = K.pair_rows(df, known=spark.createDataFrame(known, "Season int, T1 long, T2 long, v double"), block=8)
    assert sorted((r.Season, r.T1, r.T2, str(r.T1_x), str(r.T2_x), str(r._known and r._known.v)) for r in out.collect()) == want
    plain = K.join_pairs(df.unionByName(df)).where("Season > 0")
    assert sorted(map(tuple, plain.collect())) == [w[:3] for w in want]
    big = K.pair_rows(spark.range(20_000).select(F.lit(2001).alias("Season"), F.col("id").alias("TeamID"))).withColumn("ID", F.col("T1") * 100_000 + F.col("T2"))
    tasks = big.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum(F.col("T2") - F.col("T1")).alias("d")).collect()
    n = 20_000
    assert sum(t.n for t in tasks) == n * (n - 1) // 2 and sum(t.d for t in tasks) == (n**3 - n) // 6  # each pair once
    assert len(tasks) > 8 and max(t.n for t in tasks) < n * n / 8  # no task has a whole season


def test_scored_table_is_checked_without_shuffling_ids(spark):
    import statistics

    from courtline.operators import release as L

    rng = random.Random(5)
    teams = [(s, t) for s in (1995, 2095) for t in rng.sample(range(100), 40)]  # ids a century apart meet
    dealt = K.pair_rows(spark.createDataFrame(teams, "Season int, TeamID long").withColumn("_y", F.col("Season") % 100), "_y", block=7, dealt=True).where("T1_Season = T2_Season")
    at, key = ["_y", "_i", "_j"], ["Season", "T1", "T2"]
    score = F.when(F.col("T1") % 9 != 0, (F.col("T1") * 7 + F.col("T2")) % 50 / 40.0)
    rows = dealt.select(*at, F.col("T1_Season").alias("Season"), "T1", "T2", score.alias("Pred"))
    own = rows.unionByName(rows.where("T2 % 13 = 0").withColumn("Season", F.col("Season") - 100)).unionByName(rows.where("T1 % 11 = 0"))
    due = rows.unionByName(rows.where("T1 % 7 = 0").withColumn("Season", F.col("Season") + 100))
    pairs = [(s, a, b) for s, a in teams for q, b in teams if s == q and a < b]
    value = lambda a, b: None if a % 9 == 0 else (a * 7 + b) % 50 / 40.0
    mine = [((s, a, b), value(a, b)) for s, a, b in pairs] + [((s - 100, a, b), value(a, b)) for s, a, b in pairs if b % 13 == 0] + [((s, a, b), value(a, b)) for s, a, b in pairs if a % 11 == 0]
    want = set(pairs) | {(s + 100, a, b) for s, a, b in pairs if a % 7 == 0}
    times = {}
    for i, _ in mine:
        times[i] = times.get(i, 0) + 1
    known = [v for _, v in mine if v is not None]
    checked = L.check_scored(own, due, key, within=at)
    got = checked.first()
    assert (got.n_rows, got.n_ids, got.n_repeated_ids) == (len(mine), len(times), sum(n > 1 for n in times.values()))
    assert (got.n_missing, got.n_extra) == (len(want - set(times)), len(set(times) - want))
    assert (got.n_null, got.n_out_of_range, got.n_near_0, got.n_half) == (len(mine) - len(known), sum(v > 1 for v in known), sum(v <= 0.001 for v in known), sum(v == 0.5 for v in known))
    assert got.n_values == len(set(known)) and abs(got.mean - statistics.fmean(known)) < 1e-12 and abs(got.sd - statistics.stdev(known)) < 1e-12
    cut = statistics.quantiles(known, n=20, method="inclusive")
    assert all(abs(a - b) < 1e-12 for a, b in zip((got.q05, got.q50, got.q95), (cut[0], cut[9], cut[18])))
    assert got == L.check_scored(own.drop(*at), due.drop(*at), key).first()
    none = L.check_scored(own.where("false"), due.where("false"), key).first()
    assert (none.n_rows, none.n_ids, none.n_missing, none.mean, none.sd, none.q50) == (0, 0, 0, None, None, None)
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(Season" not in plan  # no id is shuffled


def test_a_query_makes_its_contests_once(spark, tmp_path):
    from courtline.plans import inputs
    from courtline import catalog

    for name in ("orders", "supplier"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    odd = lines.where("l_orderkey % 5 = 0").withColumn("l_linenumber", (F.col("l_linenumber") * 2).cast("int"))  # gaps
    odd = odd.unionByName(lines.where("l_orderkey % 7 = 0").withColumn("l_orderkey", F.lit(None).cast("long")))
    odd = odd.unionByName(lines.where("l_orderkey % 11 = 0").withColumn("l_linenumber", F.lit(None).cast("int")))
    odd = odd.unionByName(lines.where("l_orderkey % 5 > 0")).unionByName(lines.where("l_orderkey % 13 = 0"))  # repeated lines
    odd.write.parquet(f"{tmp_path}/lineitem.parquet")
    plain = {name: sorted(map(str, view(spark, str(tmp_path), name).collect())) for name in ("contest", "seeds", "scored")}
    assert len(plain["contest"]) > 500
    with inputs.shared_views():
        first = view(spark, str(tmp_path), "contest")
        assert view(spark, str(tmp_path), "contest") is first
        assert all(sorted(map(str, view(spark, str(tmp_path), name).collect())) == rows for name, rows in plain.items())
        assert all("lineitem" not in view(spark, str(tmp_path), n)._jdf.queryExecution().optimizedPlan().toString() for n in ("seeds", "glog"))
        assert first.schema == view(spark, str(tmp_path), "contest").schema and [t for t in first.dtypes] == view(spark, SF, "contest").dtypes
    assert inputs._tables.get() is None  # the next query sees what the tables hold then
    before = catalog.queries()["input_completeness"](spark, str(tmp_path)).collect()
    odd.where("l_orderkey % 2 = 0").write.mode("overwrite").parquet(f"{tmp_path}/lineitem2.parquet")
    spark.read.parquet(f"{tmp_path}/lineitem2.parquet").write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    after = catalog.queries()["input_completeness"](spark, str(tmp_path)).collect()
    assert sum(r.n for r in after) < sum(r.n for r in before)


def test_bias_correction_of_a_table_computes_each_step_once(spark):
    odds = [(a, b) for a in (None, 0.0, 1.0, 1.01, 1.5, 2.6, 3.0, 50.0) for b in (None, -1.0, 1.0, 1.3, 2.6, 40.0)]
    df = spark.createDataFrame(odds, "a double, b double")
    both = X.with_bias_corrected_prob(df.withColumn("whole", X.bias_corrected_prob("a", "b")), "a", "b", "p")
    assert both.columns == ["a", "b", "whole", "p"]
    assert all(r.whole == r.p for r in both.collect())
    plan = X.with_bias_corrected_prob(df, "a", "b").select(X.temperature_soften("p", 1.75).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT") == 2  # one for each side, however often later steps mention them
