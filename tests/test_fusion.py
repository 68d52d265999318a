"""Fusion, learned losses, routes, anchors, overrides: against plain versions, and no season sees its own labels."""

import itertools
import json
import math
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtline.operators import anchors as A
from courtline.operators import matchup as MU
from courtline.operators import metafusion as U
from courtline.operators import models as M
from courtline.operators import overrides as O
from courtline.operators import rules as P
from courtline.sources import files as IO

ROUTES = ["Prob_stats", "Prob_market_public", "Prob_legacy_anchor"]
SCHEMA = "GameID long, League string, Season int, T1 long, T2 long, Label int, MarketProb double, AbsSeedDiff int, D_HostLikely int, IsRound1Or2 int, Prob_stats double, Prob_market_public double, Prob_legacy_anchor double"


def scored(seed=1, n=240):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        p = rng.random()
        gap = lambda q: None if rng.random() < 0.2 else min(0.99, max(0.01, q))  # noqa: B023, E731
        market = gap(p + rng.gauss(0, 0.1))
        rows.append((i, "MW"[i % 2], 2000 + i * 6 // n, i, i + 1, int(rng.random() < p), market, rng.randrange(12), rng.randrange(2), rng.randrange(2), gap(p + rng.gauss(0, 0.2)), market, gap(p)))
    return rows


def flipped(rows, season):
    return [(*r[:5], 1 - r[5], *r[6:]) if r[2] == season else r for r in rows]


def by_game(df, *columns):
    return {r.GameID: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("which", ["losses", "all"])
def test_a_seasons_labels_move_neither_its_scores_nor_its_choices(spark, which):
    rows, context = scored(n=120), ["MarketProb", "AbsSeedDiff"]
    mined = P.candidate_rules({"MarketProb": (0.8, 0.9)})
    gates = {"M": U.Gates(recent_linear=2004), "W": U.Gates(recent_selector=2005)}

    def run(data):
        df = spark.createDataFrame(data, SCHEMA)
        if which == "losses":
            return by_game(U.loss_selector_oof(df, ROUTES, context, least_seasons=5), "Season", "SelectorProb")
        return by_game(U.fusion_oof(df, ROUTES, gates, mined, context, "Prob_legacy_anchor", least_seasons=5), "Season", "BestName", "RuleCount", "SelectorProb", "LinearMetaProb", "BoostedMetaProb", "FinalProb", "DecidedBy")

    plain, last = run(rows), run(flipped(rows, 2005))
    assert {v[0] for v in plain.values()} == {2005} and len(plain) == sum(r[2] == 2005 for r in rows)
    assert plain == last  # the season's own labels move nothing at all
    assert which == "all" or plain != run(flipped(rows, 2001))  # earlier ones do
    assert all(0 < v[-1 if which == "losses" else -2] < 1 for v in plain.values())


def test_filled_routes_and_choices(spark):
    rows = scored(n=60)
    df = spark.createDataFrame(rows, SCHEMA)
    frame, names = U.simple_frame(U.fill_routes(df, ROUTES), ROUTES)
    got = {r.GameID: r for r in frame.collect()}
    score = {}
    for r in rows:
        known = [p for p in r[10:13] if p is not None]
        mean = sum(known) / len(known) if known else 0.5
        filled = [mean if p is None else p for p in r[10:13]]
        out = got[r[0]]
        assert [out[c] for c in ROUTES] == pytest.approx(filled) and [out[f"{c}_avail"] for c in ROUTES] == [int(p is not None) for p in r[10:13]]
        assert out.Prob_market_stats_blend == pytest.approx(0.6 * filled[1] + 0.4 * filled[0]) and out[U.MEAN] == pytest.approx(sum(filled) / 3)
        for c in names:
            score.setdefault((r[1], r[2], c), []).append((min(max(out[c], 1e-6), 1 - 1e-6) - r[5]) ** 2)
    choices = {(r.League, r.Season): r for r in U.prior_choices(frame, names, "Prob_legacy_anchor").collect()}
    for league, season in itertools.product("MW", range(2000, 2006)):
        means = [(round(np.mean(sum((v for (lg, s, k), v in score.items() if lg == league and s < season and k == c), [])), 9), i) for i, c in enumerate(names) if season > 2000]
        assert ((league, season) in choices) == bool(means)
        if means:
            r = choices[league, season]
            assert r.BestName == names[min(means)[1]] and r.BestScore == pytest.approx(min(means)[0]) and r.AnchorScore == pytest.approx(means[2][0])


def test_decision_steps(spark):
    df = spark.createDataFrame([(1, 0.9), (2, 0.4), (3, None), (4, 0.2)], "id int, x double")
    x = F.col("x")
    steps = [
        U.Step("a", (U.Branch(x > 0.8, {"x": 0.5, "current": 0.5}, settles=True), U.Branch(x > 0.3, {"current": 1.0}, low=0.6))),
        U.Step("b", (U.Branch(F.lit(True), {"current": 1.0}, high=0.45),), unsettled=True),
        U.Step("c", (U.Branch(x < 0.3, {"x": 2.0}),)),
    ]
    out = {r.id: (round(r.FinalProb, 6), r.DecidedBy) for r in U.decide(df, F.lit(0.5), steps).collect()}
    assert out == {1: (0.7, "a"), 2: (0.45, "b"), 3: (0.45, "b"), 4: (0.4, "c")}


def test_routes_switch_on_by_coverage_and_rows(spark):
    rows = [(i, 2000 + i // 40, i // 4 % 2, (i * 7 % 40) / 40, (0.5 if i % 4 == 0 else None) if i < 120 else 0.4) for i in range(200)]
    df = spark.createDataFrame(rows, "GameID long, Season int, Label int, x double, MarketProb double")
    priced = F.col("MarketProb").isNotNull()
    route = lambda name, coverage, least: M.Route(name, M.linear, ("x",), priced, coverage, least)
    out = M.season_routes_oof(df, [M.Route("all", M.linear, ("x",)), route("low", 0.25, 20), route("wide", 0.3, 20), route("few", 0.0, 31)], min_prior=2).collect()
    assert len(out) == 120 and all(r.Prob_all is not None for r in out)
    market = {r[0]: r[4] for r in rows}
    for r in out:
        eligible = market[r.GameID] is not None
        on = {"low": True, "wide": r.Season >= 2003, "few": r.Season >= 2004}  # 10 eligible rows a season until 2002, then all
        for name, active in on.items():
            assert (r[f"Prob_{name}"] is not None) == (eligible and active), (r, name)
    assert M.season_routes_oof(df.where("false"), [route("low", 0, 1)]).count() == 0


def test_anchor_replays_a_logged_run(spark):
    rows = spark.createDataFrame([(*r, (r[0] % 9) + 1, (r[0] * 5 % 16) + 1, -float(r[0] % 12)) for r in scored(n=90)], SCHEMA + ", T1_SeedNum int, T2_SeedNum int, LastSpread double")
    steps = [("AdaptiveMarketBlend", {"base": 0.3, "close_at": 2, "close": 0.5, "wide_at": 8, "wide": 0.1}), ("SpreadExtremes", {"threshold": 9.0, "floor": 0.9})]
    raw = X_mean = P.X.shrink_half(P.X.clip_prob(F.coalesce("Prob_stats", P.X.row_mean("Prob_market_public", "Prob_legacy_anchor"), F.lit(0.5))), 0.06)  # noqa: F841
    made = rows.where("League = 'M'").withColumn("p", raw).withColumn("p", P.market_blend(F.col("p"), P.adaptive_weight(0.3, 2, 0.5, 8, 0.1))).withColumn("p", P.spread_floor(F.col("p"), 9.0, 0.9))
    logged = {r.GameID: r.p for r in made.collect()}
    config = {f"Has{n}": "True" for n, _ in steps} | {f"{n}Config": json.dumps(c) for n, c in steps}
    log = [("M", "old", 1, 0.1, "Prob_legacy_anchor", "none", 0.0, *["no", "{}"] * 2), ("M", "new", 2, 0.2, "Prob_stats", "none", 0.06, *itertools.chain(*((config[f"Has{n}"], config[f"{n}Config"]) for n, _ in steps))), ("M", "failed", 3, None, "Prob_stats", "none", 0.5, "True", "{", "1", "[]")]
    names = "League string, RunID string, TimestampUTC long, BestCVBrier double, SelectedRawColumn string, CalibrationMethod string, Shrinkage double, " + ", ".join(f"Has{n} string, {n}Config string" for n, _ in steps)
    runs = spark.createDataFrame(log, names)
    (run,) = A.latest_runs(runs)
    assert (run.run_id, run.raw, run.shrinkage, run.steps) == ("new", "Prob_stats", 0.06, tuple(steps))
    root = tempfile.mkdtemp()
    for _ in range(2):
        out = by_game(A.anchor_merge(rows.select("GameID", "League"), rows, runs, ROUTES, root), "League", "AnchorProb")
        assert len(out) == 90 and all((v[1] is None) == (v[0] == "W") for v in out.values())
        assert {g: v[1] for g, v in out.items() if v[0] == "M"} == pytest.approx(logged)
    stored = spark.read.parquet(root)
    assert stored.count() == len(logged)  # the second time it was read, not made
    broken = A.latest_runs(runs.where("RunID = 'failed'").withColumn("BestCVBrier", F.lit(0.3)))
    assert broken[0].steps == ()


def guard(current, target, market, spread, model):
    safe = lambda p: min(max(p, 1e-6), 1 - 1e-6)
    c = safe(current)
    bounded = safe(c + min(max(0.35 * (safe(target) - c), -0.12), 0.12))
    clear = any(p is not None and (p >= 0.8 or p <= 0.2) for p in (market, model)) or (spread is not None and abs(spread) >= 6)
    if not clear and c > 0.5 > bounded:
        return 0.500001
    return 0.499999 if not clear and c < 0.5 < bounded else bounded


def test_guard_rails(spark):
    rng = random.Random(4)
    some = lambda f: None if rng.random() < 0.3 else f()
    rows = [(i, rng.choice([0.0, 1.0, 0.5, 0.48, 0.52, rng.random()]), rng.random(), some(rng.random), some(lambda: rng.uniform(-9, 9)), some(rng.random)) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, c double, t double, m double, s double, d double")
    out = {r.i: r.x for r in df.select("i", O.guarded(*(F.col(k) for k in "ctmsd")).alias("x")).collect()}
    assert out == pytest.approx({r[0]: guard(*r[1:]) for r in rows})


def test_first_failing_reason(spark):
    base = dict(GameID=0, League="M", Season=2000, T1=1, T2=2, Round=1, Team1SeedNum=1, Team2SeedNum=16, BothInField=True, InjuryRisk=False, IsPlayIn=False, IsRound1=True, IsRound2=False, Team1_SeverityScore=0, Team1_OutCount=0, Team1_GTDCount=0, Team2_SeverityScore=0, Team2_OutCount=0, Team2_GTDCount=0, Pred=0.6, Baseline=0.8, MarketProb=0.85, Spread=-7.0, ModelProb=0.8, SourceCount=2, BookCountMax=3, BookCountTotal=None, RowCount=1)
    cases = [
        ({}, "AutoApply"), ({"Round": 3}, "OutOfScope"), ({"Round": None, "MarketProb": None}, "OutOfScope"), ({"BothInField": False}, "OutOfScope"), ({"Round": 2}, "AutoApply"), ({"Round": 2, "Team1SeedNum": 5, "Team2SeedNum": 6}, "OutOfScope"), ({"Round": 2, "Team1SeedNum": 5, "Team2SeedNum": 6, "InjuryRisk": True}, "AutoApply"),
        ({"MarketProb": None}, "NoMarket"), ({"SourceCount": 1}, "LowMarketConsensus"), ({"BookCountMax": 2}, "LowMarketConsensus"), ({"BookCountMax": 2, "BookCountTotal": 4}, "AutoApply"), ({"Spread": 7.0}, "MarketSpreadConflict"), ({"Spread": None}, "MarketSpreadConflict"), ({"Pred": 0.82}, "GapTooSmall"),
        ({"ModelProb": 0.3}, "ModelConflict"), ({"ModelProb": None}, "AutoApply"), ({"Team1_SeverityScore": 4, "Team1_OutCount": 1}, "FavoriteInjuryVeto"), ({"Team1_SeverityScore": 4, "Team1_OutCount": 1, "Pred": 0.95}, "AutoApply"), ({"Team2_SeverityScore": 9, "Team2_OutCount": 3}, "AutoApply"),
    ]
    rows = [base | change | {"GameID": i} for i, (change, _) in enumerate(cases)]
    kinds = ", ".join(f"{k} {'string' if k == 'League' else 'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'int'}" for k, v in base.items())
    out = O.override_candidates(spark.createDataFrame([tuple(r.values()) for r in rows], kinds))
    got = {r.GameID: r for r in out.collect()}
    assert [got[i].AutoDecision for i in range(len(cases))] == [want for _, want in cases]
    assert got[0].AutoNewPred == pytest.approx(0.6 + 0.35 * (0.7 * 0.85 + 0.3 * 0.8 - 0.6)) and got[0].AutoApply and got[0].ManualReason == "BaselineAndModelAgainstCurrent"
    assert got[7].AutoNewPred == 0.6 and not got[7].AutoApply and not got[16].ManualEligible and got[16].AutoNewPred > 0.6
    short = O.manual_shortlist(out, "GameID", most=2).orderBy("Rank").collect()
    assert [r.Rank for r in short] == [1, 2] and {r.Round for r in short} == {1}


def test_kernel_weights(spark):
    rng = random.Random(8)
    names, teams = ["a", "b"], list(range(12))
    feats = [(s, t, rng.gauss(0, 3), None if t == 11 else rng.gauss(1, 0.01)) for s in (2000, 2001, 2002) for t in teams]
    pairs = [(s, i, j) for s in (2001, 2002) for i, j in itertools.combinations(teams, 2)]
    rows = [(k, 2000 + k % 3, rng.gauss(0, 3), rng.choice([None, rng.gauss(0, 1)])) for k in range(90)]
    profile = MU.kernel_profile(spark.createDataFrame(pairs, "Season int, T1 long, T2 long"), spark.createDataFrame(feats, "Season int, TeamID long, a double, b double"))
    out = {(r.id, r.TargetSeason): r.Weight for r in MU.field_kernel_weights(spark.createDataFrame(rows, "id int, Season int, D_a double, D_b double"), profile, names, 0.7, least_rows=20, least_features=1).collect()}
    want, at = {}, {(s, t): v for s, t, *v in feats}
    for target in (2001, 2002):
        early = [r for r in rows if r[1] < target]
        total = {}
        for c in range(2):
            gaps = [abs(at[s, i][c] - at[s, j][c]) for s, i, j in pairs if s == target and at[s, i][c] is not None and at[s, j][c] is not None]
            if sum(r[2 + c] is not None for r in early) < 20:
                continue
            mean, scale = np.mean(gaps), max(np.std(gaps, ddof=1), abs(np.mean(gaps)) * 0.1, 0.15)
            for r in early:
                total.setdefault(r[0], []).append(0 if r[2 + c] is None else min(max((abs(r[2 + c]) - mean) / scale, -6), 6) ** 2)
        w = {k: 1 + 0.7 * math.exp(-0.5 * np.mean(v)) for k, v in total.items()}
        want |= {(k, target): v / np.mean(list(w.values())) for k, v in w.items()}
    assert out == pytest.approx(want)


def test_external_sources(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)

    put("MHistoricalTournamentOdds.csv", "Season,T1,Prob,Extra\n2001,1,0.5,x\n2001,1,0.7,x\n,3,0.9,x\n2001,2,n/a,\n")
    put("MHistoricalOdds_2001.csv", "Season,T1,Prob\n2001,9,0.9\n")
    put("mLines.csv", "Year,T1,MarketProb,Prob\n2001,1,0.1,0.2\n2001,4,,0.4\n2001,x,0.3,0.3\n")
    put("M_odds_example.csv", "Season,T1,Prob\n2001,8,0.8\n")
    put("WHistoricalTournamentOdds.csv", "Season,T1,Prob\n2001,7,0.8\n")
    put("MRatings.csv", "Season,T1,Prob\n2001,6,0.8\n")
    columns = {"Season": ("int", "first", ("Season", "Year")), "T1": ("bigint", "first", ("T1",)), "Prob": ("double", "number", ("MarketProb", "Prob")), "Note": ("string", "first", ("Note",))}
    scan = lambda prefix, **k: sorted(map(tuple, IO.scan_external_sources(spark, str(tmp_path), prefix, ("odds", "lines"), columns, ["Season", "T1"], **k).collect()), key=repr)
    first = "MHistoricalTournamentOdds.csv"
    assert scan("M", canonical=first, replaced="historicalodds_") == sorted([(2001, 1, 0.5, None, first, 0), (2001, 1, 0.7, None, first, 0), (2001, 2, None, None, first, 0), (2001, 4, 0.4, None, "mLines.csv", 1)], key=repr)
    assert {r[1] for r in scan("M")} == {1, 2, 4, 9}
    assert scan("X") == [] and {r[1] for r in scan("w")} == {7}
