"""Queries of the strength features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from .inputs import table, view, with_views
from .registry import query, r6

KEY = ["Season", "TeamID"]


def rounded(df, *keep):
    """All doubles but those to keep, rounded."""
    return df.select(*(r6(c).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


def log_of(spark, sf_dir):
    return X.compact_game_log(view(spark, sf_dir, "regular"))


@query("compact_game_log", with_views("glog", "SELECT * FROM glog"))
def compact_game_log(spark, sf_dir):
    return log_of(spark, sf_dir)


EFF = """, det AS (SELECT *, 100 * Pts / Poss AS OffRtg, 100 * OppPts / OppPoss AS DefRtg, FGM / greatest(FGA, 1) AS FGPct, FGM3 / greatest(FGA3, 1) AS FG3Pct, FTM / greatest(FTA, 1) AS FTPct, Pts - OppPts AS Margin,
(FGM + 0.5 * FGM3) / greatest(FGA, 1) AS eFG, "TO" / Poss AS TOVPct, FTA / greatest(FGA, 1) AS FTR, Oreb / greatest(Oreb + OppDR, 1) AS ORBPct, (OppFGM + 0.5 * OppFGM3) / greatest(OppFGA, 1) AS OppEFG, OppTO / OppPoss AS OppTOVPct, OppFTA / greatest(OppFGA, 1) AS OppFTR, OppOR / greatest(OppOR + DR, 1) AS OppORBPct FROM boxlog),
tm AS (SELECT Season, TeamID, avg(OffRtg) AS o, avg(DefRtg) AS d FROM det GROUP BY 1, 2), lg AS (SELECT *, avg(o) OVER (PARTITION BY Season) AS lo, avg(d) OVER (PARTITION BY Season) AS ld FROM tm),
adj AS (SELECT det.*, OffRtg + ld - d AS AdjOffRtg, DefRtg + lo - o AS AdjDefRtg FROM det LEFT JOIN lg ON lg.Season = det.Season AND lg.TeamID = det.OppID)"""


def detailed(spark, sf_dir):
    return X.detailed_game_log(view(spark, sf_dir, "boxscore"))


@query("detailed_game_log", with_views("boxlog", EFF + " SELECT GameID, TeamID, round(Poss, 6) AS Poss, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("OffRtg", "DefRtg", "FGPct", "FG3Pct", "FTPct", "eFG", "TOVPct", "FTR", "ORBPct", "OppEFG", "OppTOVPct", "OppFTR", "OppORBPct")) + " FROM det"))
def detailed_game_log(spark, sf_dir):
    return rounded(detailed(spark, sf_dir).select("GameID", "TeamID", "Poss", "OffRtg", "DefRtg", "FGPct", "FG3Pct", "FTPct", "eFG", "TOVPct", "FTR", "ORBPct", "OppEFG", "OppTOVPct", "OppFTR", "OppORBPct"))


@query("adjusted_efficiency", with_views("boxlog", EFF + " SELECT GameID, TeamID, round(AdjOffRtg, 6) AS AdjOffRtg, round(AdjDefRtg, 6) AS AdjDefRtg, round(AdjOffRtg - AdjDefRtg, 6) + 0 AS AdjNetRtg FROM adj"))
def adjusted_efficiency(spark, sf_dir):
    return rounded(X.adjusted_efficiency(detailed(spark, sf_dir)).select("GameID", "TeamID", "AdjOffRtg", "AdjDefRtg", "AdjNetRtg"))


def eff_sql(rows: str, prefix: str = "", neutral: bool = False) -> str:
    raw = {"OR": "Oreb", "TO": '"TO"', "Poss": "Poss"}
    means = ", ".join(f'avg({raw.get(c, c)}) AS "{X.RENAMED.get(c, c)}"' for c in X.RATES)
    extra = ", avg(CASE WHEN IsHome = 0 THEN OffRtg END) - avg(CASE WHEN IsHome = 0 THEN DefRtg END) AS nn, avg(CASE WHEN IsHome = 0 THEN AdjOffRtg END) - avg(CASE WHEN IsHome = 0 THEN AdjDefRtg END) AS na" if neutral else ""
    z = lambda c, n: f"round(({c} - avg({c}) OVER w) / CASE WHEN stddev_samp({c}) OVER w IS NOT NULL THEN greatest(stddev_samp({c}) OVER w, 0.1) END, 6) + 0 AS \"{prefix}{n}_z\""
    cols = [f'round("{c}", 6) + 0 AS "{prefix}{c}"' for c in ["WinRate", *(X.RENAMED.get(c, c) for c in X.RATES), "NetRtg", "AdjNetRtg"]]
    zs = [z(c, c) for c in ("OffRtg", "DefRtg", "NetRtg", "AdjOffRtg", "AdjDefRtg", "AdjNetRtg")] + ([z("nn", "NeutralNetRtg"), z("na", "NeutralAdjNetRtg")] if neutral else [])
    return f"{EFF}, rows_ AS ({rows}), m AS (SELECT Season, TeamID, count(*) AS Games, avg(Win) AS WinRate, {means}{extra} FROM rows_ GROUP BY 1, 2), n AS (SELECT *, OffRtg - DefRtg AS NetRtg, AdjOffRtg - AdjDefRtg AS AdjNetRtg FROM m) SELECT Season, TeamID, Games AS \"{prefix}Games\", {', '.join(cols + zs)} FROM n WINDOW w AS (PARTITION BY Season)"


def adjusted(spark, sf_dir):
    return X.adjusted_efficiency(detailed(spark, sf_dir))


@query("season_efficiency", with_views("boxlog", eff_sql("SELECT * FROM adj", neutral=True)))
def season_efficiency(spark, sf_dir):
    return rounded(X.season_efficiency(adjusted(spark, sf_dir), neutral=True))


@query("recent_efficiency_n", with_views("boxlog", eff_sql("SELECT * FROM adj QUALIFY row_number() OVER (PARTITION BY Season, TeamID ORDER BY DayNum DESC, GameID DESC) <= 10", "RecentEff")))
def recent_efficiency_n(spark, sf_dir):
    return rounded(X.season_efficiency(X.R.last_n(adjusted(spark, sf_dir), 10, KEY), "RecentEff"))


@query("recent_efficiency_days", with_views("boxlog", eff_sql("SELECT * FROM (SELECT *, max(DayNum) OVER (PARTITION BY Season) AS lastday FROM adj) t WHERE DayNum >= lastday - 30", "Recent30Eff")))
def recent_efficiency_days(spark, sf_dir):
    return rounded(X.season_efficiency(X.R.lookback_days(adjusted(spark, sf_dir), 30), "Recent30Eff"))


@query("win_rate", with_views("glog", "SELECT Season, TeamID, round(avg(Win), 6) AS WinRate, round(avg(Margin), 6) + 0 AS AvgMargin, count(*) AS Games FROM glog GROUP BY 1, 2"))
def win_rate(spark, sf_dir):
    return rounded(X.win_rate(log_of(spark, sf_dir)))


@query("recent_form", with_views("glog", "SELECT Season, TeamID, round(sum(Win * exp(-0.14 * (rn - 1))) / sum(exp(-0.14 * (rn - 1))), 6) AS RecentWinRate, round(sum(Margin * exp(-0.14 * (rn - 1))) / sum(exp(-0.14 * (rn - 1))), 6) + 0 AS RecentMargin FROM (SELECT *, row_number() OVER (PARTITION BY Season, TeamID ORDER BY DayNum DESC, GameID DESC) AS rn FROM glog) t WHERE rn <= 15 GROUP BY 1, 2"))
def recent_form(spark, sf_dir):
    return rounded(X.recent_form(log_of(spark, sf_dir)))


OPP = ", opp AS (SELECT Season, TeamID AS OppID, Rating AS OppRating, row_number() OVER (PARTITION BY Season ORDER BY Rating DESC, TeamID) AS OppRank FROM rating), games AS (SELECT g.*, OppRating, OppRank, row_number() OVER (PARTITION BY g.Season, TeamID ORDER BY DayNum DESC, GameID DESC) AS rn, max(DayNum) OVER (PARTITION BY g.Season) AS lastday FROM glog g LEFT JOIN opp ON opp.Season = g.Season AND opp.OppID = g.OppID)"


def top(t: int, p: str = "") -> str:
    return f"count(*) FILTER (WHERE OppRank <= {t}) AS {p}Top{t}Games, count(*) FILTER (WHERE OppRank <= {t} AND Win = 1) AS {p}Top{t}Wins, round(avg(Win) FILTER (WHERE OppRank <= {t}), 6) AS {p}Top{t}WinRate"


@query("recent_quality", with_views("glog rating", OPP + f" SELECT Season, TeamID, round(avg(Win) FILTER (WHERE rn <= 10), 6) AS Last10WinRate, round(avg(Margin) FILTER (WHERE rn <= 10), 6) + 0 AS Last10Margin, round(avg(OppRating) FILTER (WHERE rn <= 10), 6) AS Last10SOS, round(avg(Win) FILTER (WHERE abs(Margin) <= 5), 6) AS CloseGameWinRate, nullif(count(*) FILTER (WHERE abs(Margin) <= 5), 0) AS CloseGameCount, round(avg(Margin) FILTER (WHERE abs(Margin) <= 5), 6) + 0 AS CloseGameMargin, {top(5)}, {top(50)} FROM games GROUP BY 1, 2"))
def recent_quality(spark, sf_dir):
    return rounded(X.recent_quality(log_of(spark, sf_dir), view(spark, sf_dir, "rating"), tops=(5, 50)))


@query("recent_quality_days", with_views("glog rating", OPP + f" SELECT Season, TeamID, round(avg(Win), 6) AS Last30WinRate, round(avg(Margin), 6) + 0 AS Last30Margin, round(avg(OppRating), 6) AS Last30SOS, round(avg(Win) FILTER (WHERE abs(Margin) <= 5), 6) AS Last30CloseWinRate, nullif(count(*) FILTER (WHERE abs(Margin) <= 5), 0) AS Last30CloseCount, {top(50, 'Last30')} FROM games WHERE DayNum >= lastday - 30 GROUP BY 1, 2"))
def recent_quality_days(spark, sf_dir):
    return rounded(X.recent_quality_days(log_of(spark, sf_dir), view(spark, sf_dir, "rating")))


@query("strength_of_schedule", with_views("glog rating", "SELECT g.Season, g.TeamID, round(avg(r.Rating), 6) AS SOS FROM glog g LEFT JOIN rating r ON r.Season = g.Season AND r.TeamID = g.OppID GROUP BY 1, 2"))
def strength_of_schedule(spark, sf_dir):
    return rounded(X.strength_of_schedule(log_of(spark, sf_dir), view(spark, sf_dir, "rating")))


@query("rpi_metrics", with_views("glog", """, team AS (SELECT Season, TeamID, sum(Win) AS tw, count(*) AS tn FROM glog GROUP BY 1, 2), vs AS (SELECT Season, TeamID, OppID, sum(Win) AS vw, count(*) AS vn FROM glog GROUP BY 1, 2, 3),
owp AS (SELECT g.Season, g.TeamID, avg((o.tw - v.vw) / nullif(o.tn - v.vn, 0)) AS OWP FROM glog g JOIN team o ON o.Season = g.Season AND o.TeamID = g.OppID JOIN vs v ON v.Season = g.Season AND v.TeamID = g.OppID AND v.OppID = g.TeamID GROUP BY 1, 2),
oowp AS (SELECT g.Season, g.TeamID, avg(o.OWP) AS OOWP FROM glog g LEFT JOIN owp o ON o.Season = g.Season AND o.TeamID = g.OppID GROUP BY 1, 2),
f AS (SELECT t.Season, t.TeamID, tw / tn AS r, coalesce(OWP, tw / tn) AS OWP, coalesce(OOWP, OWP, tw / tn) AS OOWP FROM team t LEFT JOIN owp p ON p.Season = t.Season AND p.TeamID = t.TeamID LEFT JOIN oowp q ON q.Season = t.Season AND q.TeamID = t.TeamID)
SELECT Season, TeamID, round(OWP, 6) AS OWP, round(OOWP, 6) AS OOWP, round(0.25 * r + 0.5 * OWP + 0.25 * OOWP, 6) AS RPIStyle, round(0.5 * OWP + 0.5 * OOWP, 6) AS RPIStyleSOS FROM f"""))
def rpi_metrics(spark, sf_dir):
    return rounded(X.rpi_metrics(log_of(spark, sf_dir)))


@query("conf_tourney_wins", with_views("tourney", "SELECT Season, WTeamID AS TeamID, count(*) AS ConfTourneyWins FROM tourney GROUP BY 1, 2"))
def conf_tourney_wins(spark, sf_dir):
    return X.conf_tourney_wins(view(spark, sf_dir, "tourney"))


@query("conference_strength", with_views("glog conferences rating", """, perf AS (SELECT g.Season, a.ConfAbbrev, avg(Win) AS w, avg(Margin) AS m, count(*) AS n FROM glog g JOIN conferences a ON a.Season = g.Season AND a.TeamID = g.TeamID JOIN conferences b ON b.Season = g.Season AND b.TeamID = g.OppID WHERE a.ConfAbbrev <> b.ConfAbbrev GROUP BY 1, 2),
el AS (SELECT c.Season, c.ConfAbbrev, avg(Rating) AS r, count(DISTINCT c.TeamID) AS k FROM conferences c LEFT JOIN rating e ON e.Season = c.Season AND e.TeamID = c.TeamID GROUP BY 1, 2)
SELECT c.Season, c.TeamID, c.ConfAbbrev, round(w, 6) AS ConfNonConfWinRate, round(m, 6) + 0 AS ConfNonConfAvgMargin, n AS ConfNonConfGames, round(r, 6) AS ConfMeanRating, k AS ConfTeamCount FROM conferences c LEFT JOIN perf p ON p.Season = c.Season AND p.ConfAbbrev = c.ConfAbbrev LEFT JOIN el e ON e.Season = c.Season AND e.ConfAbbrev = c.ConfAbbrev"""))
def conference_strength(spark, sf_dir):
    return rounded(X.conference_strength(log_of(spark, sf_dir), view(spark, sf_dir, "conferences"), view(spark, sf_dir, "rating")))


@query("tenure_features", with_views("coaches", """, spans AS (SELECT Season, TeamID, CoachName, sum(greatest(LastDayNum - FirstDayNum + 1, 1)) AS d FROM coaches GROUP BY 1, 2, 3), cnt AS (SELECT Season, TeamID, count(*) AS CoachCount FROM spans GROUP BY 1, 2),
chosen AS (SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY Season, TeamID ORDER BY d DESC, CoachName) = 1),
marked AS (SELECT *, CASE WHEN lag(CoachName) OVER w = CoachName AND lag(Season) OVER w = Season - 1 THEN 0 ELSE 1 END AS brk, CASE WHEN lag(CoachName) OVER w <> CoachName THEN 1 ELSE 0 END AS CoachChange FROM chosen WINDOW w AS (PARTITION BY TeamID ORDER BY Season)),
isl AS (SELECT *, sum(brk) OVER (PARTITION BY TeamID ORDER BY Season) AS i FROM marked)
SELECT s.Season, s.TeamID, CAST(row_number() OVER (PARTITION BY s.TeamID, i ORDER BY s.Season) AS INT) AS CoachTenure, CoachChange, CoachCount, CASE WHEN CoachCount > 1 THEN 1 ELSE 0 END AS CoachMidseasonChange FROM isl s JOIN cnt c ON c.Season = s.Season AND c.TeamID = s.TeamID"""))
def tenure_features(spark, sf_dir):
    return X.tenure_features(view(spark, sf_dir, "coaches"))


def asof(day: int) -> str:
    return f"(SELECT *, (rank() OVER (PARTITION BY Season, SystemName ORDER BY OrdinalRank) + (count(*) OVER (PARTITION BY Season, SystemName, OrdinalRank) - 1) / 2.0) / count(*) OVER (PARTITION BY Season, SystemName) AS Pct FROM (SELECT * FROM ordinals WHERE RankingDayNum <= {day} AND SystemName <> '4-NOT SPECIFIED' QUALIFY row_number() OVER (PARTITION BY Season, TeamID, SystemName ORDER BY RankingDayNum DESC, OrdinalRank) = 1) t)"


POLLS = ("4-NOT SPECIFIED",)


@query("rank_consensus", with_views("ordinals", f"SELECT Season, TeamID, round(avg(Pct), 6) AS RankMean, round(coalesce(stddev_samp(Pct), 0), 6) AS RankStd, round(min(Pct), 6) AS RankMin, round(avg(OrdinalRank) FILTER (WHERE SystemName = '2-HIGH'), 6) AS \"Rank_2-HIGH\", round(avg(OrdinalRank) FILTER (WHERE SystemName = '5-LOW'), 6) AS \"Rank_5-LOW\" FROM {asof(133)} p GROUP BY 1, 2"))
def rank_consensus(spark, sf_dir):
    return rounded(X.rank_consensus(view(spark, sf_dir, "ordinals"), ("2-HIGH", "5-LOW"), skip=POLLS))


@query("rank_momentum", with_views("ordinals", f"SELECT a.Season, a.TeamID, round(avg(b.Pct - a.Pct), 6) + 0 AS RankMomentum FROM {asof(133)} a JOIN {asof(119)} b ON a.Season = b.Season AND a.TeamID = b.TeamID AND a.SystemName = b.SystemName GROUP BY 1, 2"))
def rank_momentum(spark, sf_dir):
    return rounded(X.rank_momentum(view(spark, sf_dir, "ordinals"), skip=POLLS))


@query("seed_priors", with_views("tourney seeds", """, sn AS (SELECT *, CAST(substr(Seed, 2) AS INT) AS SeedBucket FROM seeds), grid AS (SELECT League, Season, CAST(range AS INT) AS SeedBucket FROM (SELECT DISTINCT League, Season FROM seeds) s CROSS JOIN range(1, 17)),
n AS (SELECT League, Season, SeedBucket, count(*) AS n FROM sn GROUP BY 1, 2, 3), sides AS (SELECT League, Season, WTeamID AS TeamID, 1 AS win FROM tourney UNION ALL SELECT League, Season, LTeamID, 0 FROM tourney),
p AS (SELECT s.League, s.Season, SeedBucket, count(*) AS g, sum(win) AS w FROM sides s JOIN sn ON sn.League = s.League AND sn.Season = s.Season AND sn.TeamID = s.TeamID GROUP BY 1, 2, 3),
r AS (SELECT grid.*, coalesce(n, 0) AS n, coalesce(g, 0) AS g, coalesce(w, 0) AS w FROM grid LEFT JOIN n ON n.League = grid.League AND n.Season = grid.Season AND n.SeedBucket = grid.SeedBucket LEFT JOIN p ON p.League = grid.League AND p.Season = grid.Season AND p.SeedBucket = grid.SeedBucket)
SELECT League, Season, SeedBucket, coalesce(CAST(sum(w) OVER k AS DOUBLE) / nullif(CAST(sum(n) OVER k AS DOUBLE), 0), 0) AS SeedPriorExpectedWins, coalesce(CAST(sum(w) OVER k AS DOUBLE) / nullif(CAST(sum(g) OVER k AS DOUBLE), 0), 0) AS SeedPriorWinPct FROM r WINDOW k AS (PARTITION BY League, SeedBucket ORDER BY Season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def seed_priors(spark, sf_dir):
    return X.seed_priors(view(spark, sf_dir, "tourney"), view(spark, sf_dir, "seeds"))


def some_seeds(spark, sf_dir):
    """Seeds that a third of the teams don't have."""
    seeds = X.seed_number(view(spark, sf_dir, "seeds"))
    return seeds.select(*KEY, F.when(F.col("TeamID") % 3 != 0, F.col("SeedNum")).alias("SeedNum"))


@query("impute_seeds", with_views("rating seeds", ", sn AS (SELECT Season, TeamID, CASE WHEN TeamID % 3 <> 0 THEN CAST(substr(Seed, 2) AS INT) END AS SeedNum FROM seeds), rk AS (SELECT *, row_number() OVER (PARTITION BY Season ORDER BY Rating DESC, TeamID) AS k FROM rating) SELECT rk.Season, rk.TeamID, coalesce(SeedNum, CASE WHEN k <= 64 THEN CAST(least(ceil(k / 4.0), 16) AS INT) ELSE 17 END) AS SeedNum FROM rk LEFT JOIN sn ON sn.Season = rk.Season AND sn.TeamID = rk.TeamID"))
def impute_seeds(spark, sf_dir):
    return X.impute_seeds(view(spark, sf_dir, "rating").join(some_seeds(spark, sf_dir), KEY, "left"), "Rating").select(*KEY, "SeedNum")


@query("external_composite", with_views("glog rating", """, a AS (SELECT Season, TeamID, avg(Margin) AS Ext_Power FROM glog WHERE IsHome = 1 GROUP BY 1, 2), b AS (SELECT Season, TeamID, avg(OppPts) AS Ext_Defense FROM glog WHERE IsHome = 0 GROUP BY 1, 2),
j AS (SELECT coalesce(a.Season, b.Season) AS Season, coalesce(a.TeamID, b.TeamID) AS TeamID, Ext_Power, Ext_Defense FROM a FULL JOIN b ON a.Season = b.Season AND a.TeamID = b.TeamID),
z AS (SELECT *, (Ext_Power - avg(Ext_Power) OVER w) / CASE WHEN stddev_samp(Ext_Power) OVER w IS NOT NULL THEN greatest(stddev_samp(Ext_Power) OVER w, 0.1) END AS zp, (Ext_Defense - avg(Ext_Defense) OVER w) / CASE WHEN stddev_samp(Ext_Defense) OVER w IS NOT NULL THEN greatest(stddev_samp(Ext_Defense) OVER w, 0.1) END AS zd FROM j WINDOW w AS (PARTITION BY Season))
SELECT Season, TeamID, round(Ext_Power, 6) + 0 AS Ext_Power, round(Ext_Defense, 6) AS Ext_Defense, round(zp, 6) + 0 AS Ext_Power_z, round(zd, 6) + 0 AS Ext_Defense_z, round((coalesce(zp, 0) - coalesce(zd, 0)) / nullif((zp IS NOT NULL)::INT + (zd IS NOT NULL)::INT, 0), 6) + 0 AS ExtCompositeStrength FROM z"""))
def external_composite(spark, sf_dir):
    log = log_of(spark, sf_dir)
    power = log.where("IsHome = 1").groupBy(*KEY).agg(F.avg("Margin").alias("Power"))
    defense = log.where("IsHome = 0").groupBy(*KEY).agg(F.avg("OppPts").alias("Defense"))
    return rounded(X.external_composite([power, defense]))


#: Vectors of documents by team, whole; the SQL takes their length from the data too.
POOL = """d AS (SELECT vec_id % 10 AS TeamID, CAST(1995 + label % 7 AS INT) AS Season, vec_id, embedding FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY Season, TeamID ORDER BY vec_id DESC) AS rn, count(*) OVER (PARTITION BY Season, TeamID) AS n FROM d),
w AS (SELECT *, CASE WHEN least(n, 5) > 1 THEN 2.0 - (rn - 1) / (least(n, 5) - 1) ELSE 1.0 END AS w FROM r WHERE rn <= 5), e AS (SELECT Season, TeamID, n, rn, CAST(w AS DOUBLE) AS w, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM w),
g AS (SELECT Season, TeamID, i, max(n) AS n, count(*) AS k, avg(x) FILTER (WHERE rn <= 3) AS m3, avg(x) AS m5, sum(x * w) / sum(w) AS w5 FROM e GROUP BY 1, 2, 3),
pool AS (SELECT Season, TeamID, max(n) AS DocCount, max(k) AS WindowDocCount, list(m3 ORDER BY i) AS Mean3, list(m5 ORDER BY i) AS Mean5, list(w5 ORDER BY i) AS Weighted5 FROM g GROUP BY 1, 2)"""
VECTORS = ("Mean3", "Mean5", "Weighted5")


def pooled(spark, sf_dir):
    docs = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 10).alias("TeamID"), (F.col("label") % 7 + 1995).cast("int").alias("Season"), "vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return X.recent_vectors(docs)


@query("recent_vector_pool", f"WITH {POOL} SELECT Season, TeamID, DocCount, WindowDocCount, {', '.join(f'list_transform({v}, lambda x: round(x, 6)) AS {v}' for v in VECTORS)} FROM pool")
def recent_vector_pool(spark, sf_dir):
    return pooled(spark, sf_dir).select(*KEY, "DocCount", "WindowDocCount", *(F.transform(c, lambda x: r6(x)).alias(c) for c in VECTORS))
