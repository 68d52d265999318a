"""Queries of team context and override candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import live as L
from ..operators import overrides as O
from ..operators import ratings as RT
from . import q_live
from .inputs import table, view, with_views
from .q_features import rounded
from .q_ratings import DESC
from .registry import query

BY = ["League", "Season"]

INJURED = "inj AS (SELECT CAST(1995 + event_id % 7 AS INT) AS Season, user_id % 20 AS TeamID, CAST(sum(CASE WHEN value < 50 THEN 1 WHEN value < 120 THEN 2 ELSE 3 END) AS BIGINT) AS SeverityScore, count(*) FILTER (WHERE value >= 50) AS OutCount, count(*) FILTER (WHERE value < 50) AS GTDCount FROM events WHERE event_type = 'error' GROUP BY 1, 2)"
FOUND = f"""{DESC}, rm AS (SELECT least(SeedA, SeedB) AS SeedA, greatest(SeedA, SeedB) AS SeedB, min(Round) AS Round FROM meet GROUP BY 1, 2),
rounds AS (SELECT a.Season, least(a.TeamID, b.TeamID) AS T1, greatest(a.TeamID, b.TeamID) AS T2, min(Round) AS Round FROM rm JOIN seeds a ON a.Seed = SeedA JOIN seeds b ON b.Seed = SeedB AND b.League = a.League AND b.Season = a.Season GROUP BY 1, 2, 3),
{INJURED},
ctx AS (SELECT l.GameID, l.Season, l.T1, l.T2, CASE WHEN l.T1 % 2 = 0 AND l.T2 % 2 = 0 THEN 'M' WHEN l.T1 % 2 = 1 AND l.T2 % 2 = 1 THEN 'W' ELSE '?' END AS League, x.s_name AS Team1Name, y.s_name AS Team2Name FROM live l JOIN supplier x ON x.s_suppkey = l.T1 JOIN supplier y ON y.s_suppkey = l.T2),
cs AS (SELECT ctx.*, a.Seed AS Team1Seed, b.Seed AS Team2Seed, CAST(substr(a.Seed, 2) AS INT) AS Team1SeedNum, CAST(substr(b.Seed, 2) AS INT) AS Team2SeedNum, a.Seed IS NOT NULL AND b.Seed IS NOT NULL AS BothInField, i.SeverityScore AS sa, i.OutCount AS oa, i.GTDCount AS ga, j.SeverityScore AS sb, j.OutCount AS ob, j.GTDCount AS gb,
  ctx.League = 'M' AND (coalesce(i.SeverityScore > 0, false) OR coalesce(j.SeverityScore > 0, false)) AS InjuryRisk, Round
  FROM ctx LEFT JOIN seeds a ON a.League = ctx.League AND a.Season = ctx.Season AND a.TeamID = T1 LEFT JOIN seeds b ON b.League = ctx.League AND b.Season = ctx.Season AND b.TeamID = T2
  LEFT JOIN inj i ON i.Season = ctx.Season AND i.TeamID = T1 LEFT JOIN inj j ON j.Season = ctx.Season AND j.TeamID = T2 LEFT JOIN rounds r ON r.Season = ctx.Season AND r.T1 = ctx.T1 AND r.T2 = ctx.T2)"""


def context(spark, sf_dir):
    """Scored pairs with their context; a pair's row keeps its game's number."""
    pairs = view(spark, sf_dir, "live").select("GameID", *O.PAIR)
    teams = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "M").otherwise("W").alias("League"), F.col("s_suppkey").alias("TeamID"), F.col("s_name").alias("TeamName"))
    seeds = view(spark, sf_dir, "seeds")
    value = F.col("value")
    events = table(spark, sf_dir, "events").where("event_type = 'error'").select((F.col("event_id") % 7 + 1995).cast("int").alias("Season"), (F.col("user_id") % 20).alias("TeamID"), "value")
    watch = events.groupBy("Season", "TeamID").agg(F.sum(F.when(value < 50, 1).when(value < 120, 2).otherwise(3)).alias("SeverityScore"), F.count(F.when(value >= 50, 1)).alias("OutCount"), F.count(F.when(value < 50, 1)).alias("GTDCount"))
    rounds = RT.bracket_round_map(view(spark, sf_dir, "slots"), seeds, BY).groupBy(*O.PAIR).agg(F.min("Round").alias("Round"))
    return O.team_context(pairs, teams, seeds, watch, rounds)


@query("team_context", with_views("live seeds slots", FOUND + " SELECT GameID, League, Team1Name, Team2Name, Team1Seed, Team2Seed, Team1SeedNum, Team2SeedNum, BothInField, InjuryRisk, Round, coalesce(Round = 1, false) AS IsRound1, coalesce(Round = 2, false) AS IsRound2 FROM cs", recursive=True))
def team_context(spark, sf_dir):
    return context(spark, sf_dir).select("GameID", "League", "Team1Name", "Team2Name", "Team1Seed", "Team2Seed", "Team1SeedNum", "Team2SeedNum", "BothInField", "InjuryRisk", "Round", "IsRound1", "IsRound2")


def _decision_sql() -> str:
    safe = lambda x: f"greatest(0.000001, least(0.999999, {x}))"
    return FOUND + f""", v AS (SELECT cs.*, RawProb AS Pred, CASE WHEN l.GameID % 2 = 0 THEN least(0.95, RawProb + 0.1) ELSE greatest(0.05, RawProb - 0.1) END AS Baseline, MarketProb AS mp, LastSpread AS sp, CASE WHEN l.GameID % 3 <> 0 THEN ModelMatchupProb END AS dp, l.GameID % 5 AS SourceCount, l.GameID % 7 AS BookCountMax, CASE WHEN l.GameID % 4 > 0 THEN l.GameID % 11 END AS bt, l.GameID % 2 AS rc FROM cs JOIN live l ON l.GameID = cs.GameID),
f AS (SELECT *, BothInField AND (coalesce(Round IN (0, 1), false) OR (coalesce(Round = 2, false) AND (coalesce(least(Team1SeedNum, Team2SeedNum) <= 4, false) OR InjuryRisk))) AS RealGameScope,
  SourceCount >= 2 AND greatest(BookCountMax, coalesce(bt, 0), rc) >= 3 AS cons, coalesce(mp <> 0.5 AND sp <> 0 AND (mp > 0.5) = (sp < 0), false) AS agree, coalesce(dp <> 0.5 AND mp <> 0.5 AND (dp > 0.5) = (mp > 0.5), false) AS al,
  CASE WHEN mp > 0.5 THEN 'T1' WHEN mp < 0.5 THEN 'T2' WHEN sp < 0 THEN 'T1' WHEN sp > 0 THEN 'T2' ELSE 'Unknown' END AS FavoriteSide, abs(Pred - mp) AS Gap, coalesce(abs(Baseline - mp) + 0.03 < abs(Pred - mp), false) AS bc FROM v),
t AS (SELECT *, CASE WHEN al THEN 0.7 * mp + 0.3 * dp ELSE mp END AS TargetProb, League = 'M' AND ((FavoriteSide = 'T1' AND coalesce(sa, 0) >= 4 AND (coalesce(oa, 0) >= 1 OR coalesce(ga, 0) >= 2)) OR (FavoriteSide = 'T2' AND coalesce(sb, 0) >= 4 AND (coalesce(ob, 0) >= 1 OR coalesce(gb, 0) >= 2))) AS hurt FROM f),
m AS (SELECT *, {safe('Pred')} AS c, {safe(f"{safe('Pred')} + greatest(-0.12, least(0.12, 0.35 * ({safe('TargetProb')} - {safe('Pred')})))")} AS b, coalesce(mp >= 0.8 OR mp <= 0.2, false) OR coalesce(abs(sp) >= 6, false) OR coalesce(dp >= 0.8 OR dp <= 0.2, false) AS clear FROM t),
n AS (SELECT *, CASE WHEN NOT clear AND c > 0.5 AND b < 0.5 THEN 0.500001 WHEN NOT clear AND c < 0.5 AND b > 0.5 THEN 0.499999 ELSE b END AS moved,
  CASE WHEN NOT RealGameScope THEN 'OutOfScope' WHEN mp IS NULL THEN 'NoMarket' WHEN NOT cons THEN 'LowMarketConsensus' WHEN NOT agree THEN 'MarketSpreadConflict' WHEN Gap IS NULL OR Gap < 0.07 THEN 'GapTooSmall' WHEN dp IS NOT NULL AND NOT al THEN 'ModelConflict' ELSE '' END AS failed FROM m),
dec AS (SELECT *, CASE WHEN failed <> '' THEN failed WHEN hurt AND ((FavoriteSide = 'T1' AND moved > Pred) OR (FavoriteSide = 'T2' AND moved < Pred)) THEN 'FavoriteInjuryVeto' ELSE 'AutoApply' END AS AutoDecision, CASE WHEN failed = '' THEN moved ELSE Pred END AS AutoNewPred, RealGameScope AND mp IS NOT NULL AND agree AND coalesce(Gap >= 0.08, false) AND (bc OR al) AND NOT hurt AS ManualEligible FROM n)"""


SQL = _decision_sql()
WHY = "CASE WHEN bc AND al THEN 'BaselineAndModelAgainstCurrent' WHEN bc THEN 'BaselineCloserToMarket' ELSE 'ModelAlignedAgainstCurrent' END"


def candidates(spark, sf_dir):
    game = F.col("GameID")
    base = F.when(game % 2 == 0, F.least(F.lit(0.95), F.col("RawProb") + 0.1)).otherwise(F.greatest(F.lit(0.05), F.col("RawProb") - 0.1))
    prices = view(spark, sf_dir, "live").select("GameID", F.col("RawProb").alias("Pred"), base.alias("Baseline"), "MarketProb", F.col("LastSpread").alias("Spread"), F.when(game % 3 != 0, F.col("ModelMatchupProb")).alias("ModelProb"), (game % 5).alias("SourceCount"), (game % 7).alias("BookCountMax"), F.when(game % 4 > 0, game % 11).alias("BookCountTotal"), (game % 2).alias("RowCount"))
    return O.override_candidates(context(spark, sf_dir).join(prices, "GameID"))


@query("override_candidates", with_views("live seeds slots", SQL + " SELECT GameID, RealGameScope, FavoriteSide, round(Gap, 6) AS Gap, round(TargetProb, 6) AS TargetProb, AutoDecision, round(AutoNewPred, 6) AS AutoNewPred, AutoDecision = 'AutoApply' AND abs(AutoNewPred - Pred) > 1e-12 AS AutoApply, ManualEligible FROM dec", recursive=True))
def override_candidates(spark, sf_dir):
    return rounded(candidates(spark, sf_dir).select("GameID", "RealGameScope", "FavoriteSide", "Gap", "TargetProb", "AutoDecision", "AutoNewPred", "AutoApply", "ManualEligible"))


@query("override_shortlist", with_views("live seeds slots", SQL + f", r AS (SELECT *, row_number() OVER (PARTITION BY League, Season ORDER BY coalesce(Round, 9), Gap DESC NULLS LAST, SourceCount DESC, BookCountMax DESC, GameID) AS k FROM dec WHERE ManualEligible) SELECT League, Season, CAST(k AS INT) AS Rank, GameID, {WHY} AS ManualReason FROM r WHERE k <= 10", recursive=True))
def override_shortlist(spark, sf_dir):
    return O.manual_shortlist(candidates(spark, sf_dir), "GameID", BY).select(*BY, "Rank", "GameID", "ManualReason")


@query("override_summary", with_views("live seeds slots", SQL + ", a AS (SELECT *, AutoDecision = 'AutoApply' AND abs(AutoNewPred - Pred) > 1e-12 AS go FROM dec) SELECT League, Season, count(*) AS Rows, count(*) FILTER (WHERE RealGameScope) AS InScope, count(*) FILTER (WHERE go) AS Applied, count(*) FILTER (WHERE go AND Round = 0) AS AppliedPlayIn, count(*) FILTER (WHERE go AND Round = 1) AS AppliedRound1, count(*) FILTER (WHERE go AND Round = 2) AS AppliedRound2, count(*) FILTER (WHERE go AND al) AS AppliedModel, count(*) FILTER (WHERE ManualEligible) AS ManualEligible FROM a GROUP BY 1, 2", recursive=True))
def override_summary(spark, sf_dir):
    return O.override_summary(candidates(spark, sf_dir), BY)


CHECK = SQL + """, e AS (SELECT dec.*, coalesce(dec.League = 'W' AND coalesce(Round IN (1, 2), false) AND l.D_HostLikely = 1, false) AS host, abs(Pred - Baseline) AS diff, CASE WHEN mp IS NULL THEN 'NoMarket' WHEN abs(Pred - mp) + 0.03 < abs(Baseline - mp) THEN 'Current' WHEN abs(Baseline - mp) + 0.03 < abs(Pred - mp) THEN 'Baseline' ELSE 'Tie' END AS closer, greatest(BookCountMax, coalesce(bt, 0), rc) AS books FROM dec JOIN live l ON l.GameID = dec.GameID),
chk AS (SELECT *, BothInField OR host OR InjuryRisk AS ok, CASE WHEN NOT (BothInField OR host OR InjuryRisk) THEN 'Skip' WHEN BothInField AND closer = 'Baseline' AND diff >= 0.08 AND SourceCount >= 2 AND books >= 2 THEN 'Critical' WHEN (BothInField AND diff >= 0.05 AND SourceCount >= 1) OR (InjuryRisk AND diff >= 0.05) OR (host AND diff >= 0.03 AND SourceCount >= 1) THEN 'High' WHEN diff >= 0.03 THEN 'Medium' ELSE 'Low' END AS Priority FROM e)"""


def checklist(spark, sf_dir):
    host = view(spark, sf_dir, "live").select("GameID", F.col("D_HostLikely").alias("_h"))
    rows = candidates(spark, sf_dir).join(host, "GameID")
    return O.review_checklist(rows.withColumn("EarlyHost", (F.col("League") == "W") & (F.col("IsRound1") | F.col("IsRound2")) & (F.col("_h") == 1)))


@query("review_checklist", with_views("live seeds slots", CHECK + " SELECT GameID, round(diff, 6) AS AbsPredDiff, closer AS CloserToMarket, ok AS ReviewEligible, concat_ws('|', CASE WHEN BothInField THEN 'BothInField' END, CASE WHEN host THEN 'EarlyHost' END, CASE WHEN InjuryRisk THEN 'InjuryRisk' END) AS ReviewReason, CASE closer WHEN 'Baseline' THEN 'CheckBaseline' WHEN 'Current' THEN 'KeepCurrent' ELSE 'NeedContext' END AS RecommendedAction, Priority FROM chk", recursive=True))
def review_checklist(spark, sf_dir):
    return rounded(checklist(spark, sf_dir).select("GameID", "AbsPredDiff", "CloserToMarket", "ReviewEligible", "ReviewReason", "RecommendedAction", "Priority"))


@query("recommend_candidate", with_views("live seeds slots", CHECK + f""", rt AS (SELECT GameID, {q_live.ACTIVE} AND ({q_live.CONFIRMED}) AND RawProb + 0.015 < {q_live.TARGET} AS hit FROM live),
cnt AS (SELECT chk.Season, count(*) FILTER (WHERE AutoDecision = 'AutoApply' AND abs(AutoNewPred - Pred) > 1e-12) AS Applied, count(*) FILTER (WHERE AutoDecision = 'AutoApply' AND abs(AutoNewPred - Pred) > 1e-12 AND Round IN (0, 1, 2)) AS InRounds, count(*) FILTER (WHERE AutoDecision = 'AutoApply' AND abs(AutoNewPred - Pred) > 1e-12 AND al) AS ModelSupported, count(*) FILTER (WHERE League = 'W' AND coalesce(hit, false)) AS RuntimeActive, count(*) FILTER (WHERE ok AND closer = 'Baseline' AND SourceCount >= 2 AND books >= 3 AND Priority IN ('Critical', 'High')) AS Opposed FROM chk JOIN rt ON rt.GameID = chk.GameID GROUP BY 1)
SELECT Season, Applied, RuntimeActive, Opposed, round(CASE WHEN Applied > 0 THEN ModelSupported / CAST(Applied AS DOUBLE) ELSE 0.0 END, 6) AS ModelShare, CASE WHEN Applied BETWEEN 3 AND 12 AND InRounds = Applied AND ModelSupported >= 0.5 * Applied THEN 'overrides' WHEN RuntimeActive > 0 THEN 'runtime' WHEN Opposed >= 3 THEN 'baseline' ELSE 'current' END AS Recommended FROM cnt""", recursive=True))
def recommend_candidate(spark, sf_dir):
    active = L.live_rules_confirm(q_live.live(spark, sf_dir), "RawProb", ["Prob_route", "Prob_absent"]).select("GameID", F.col("RuleGroup").isNotNull().alias("_r"))
    rows = checklist(spark, sf_dir).join(active, "GameID")
    n = lambda cond: F.count(F.when(cond, 1))
    a = F.col("AutoApply")
    opposed = F.col("ReviewEligible") & (F.col("CloserToMarket") == "Baseline") & (F.col("SourceCount") >= 2) & (F.col("EffectiveBookCount") >= 3) & F.col("Priority").isin("Critical", "High")
    counts = rows.groupBy("Season").agg(n(a).alias("Applied"), n(a).alias("Changed"), n(a & (F.col("IsPlayIn") | F.col("IsRound1") | F.col("IsRound2"))).alias("InRounds"), n(a & F.col("ModelAligned")).alias("ModelSupported"), n((F.col("League") == "W") & F.col("_r")).alias("RuntimeActive"), n(opposed).alias("Opposed"))
    return rounded(O.recommend(counts).select("Season", "Applied", "RuntimeActive", "Opposed", "ModelShare", "Recommended"))
