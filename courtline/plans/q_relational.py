"""Queries of the relational kit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as R
from .inputs import table, view, with_views
from .registry import query, r6

KEY = ["Season", "TeamID"]


@query("join_left_equi", with_views("glog", """SELECT g.Season, g.TeamID, g.Games, w.HomeGames, c.CloseGames FROM (SELECT Season, TeamID, count(*) AS Games FROM glog GROUP BY 1, 2) g
LEFT JOIN (SELECT Season, TeamID, count(*) AS HomeGames FROM glog WHERE IsHome = 1 GROUP BY 1, 2) w ON g.Season = w.Season AND g.TeamID = w.TeamID
LEFT JOIN (SELECT Season, TeamID, count(*) AS CloseGames FROM glog WHERE abs(Margin) <= 5 GROUP BY 1, 2) c ON g.Season = c.Season AND g.TeamID = c.TeamID"""))
def join_left_equi(spark, sf_dir):
    log = view(spark, sf_dir, "glog")
    count = lambda df, name: df.groupBy(*KEY).agg(F.count("*").alias(name))
    return R.join_left_chain(count(log, "Games"), [count(log.where("IsHome = 1"), "HomeGames"), count(log.where("abs(Margin) <= 5"), "CloseGames")], KEY)


@query("join_full_outer", with_views("regular", """SELECT coalesce(a.Season, b.Season) AS Season, coalesce(a.TeamID, b.TeamID) AS TeamID, a.BigWins, b.BigLosses
FROM (SELECT Season, WTeamID AS TeamID, count(*) AS BigWins FROM regular WHERE WScore - LScore > 40 GROUP BY 1, 2) a
FULL JOIN (SELECT Season, LTeamID AS TeamID, count(*) AS BigLosses FROM regular WHERE WScore - LScore > 40 GROUP BY 1, 2) b ON a.Season = b.Season AND a.TeamID = b.TeamID"""))
def join_full_outer(spark, sf_dir):
    big = view(spark, sf_dir, "regular").where("WScore - LScore > 40")
    wins = big.groupBy("Season", F.col("WTeamID").alias("TeamID")).agg(F.count("*").alias("BigWins"))
    losses = big.groupBy("Season", F.col("LTeamID").alias("TeamID")).agg(F.count("*").alias("BigLosses"))
    return wins.join(losses, KEY, "full_outer")


@query("join_inner", with_views("tourney regular", "SELECT t.GameID, t.Season, t.WTeamID, t.LTeamID, r.Met FROM tourney t JOIN (SELECT Season, WTeamID, LTeamID, count(*) AS Met FROM regular GROUP BY 1, 2, 3) r ON t.Season = r.Season AND t.WTeamID = r.WTeamID AND t.LTeamID = r.LTeamID"))
def join_inner(spark, sf_dir):
    met = view(spark, sf_dir, "regular").groupBy("Season", "WTeamID", "LTeamID").agg(F.count("*").alias("Met"))
    return view(spark, sf_dir, "tourney").select("GameID", "Season", "WTeamID", "LTeamID").join(met, ["Season", "WTeamID", "LTeamID"])


@query("join_twice_prefixed", with_views("tourney rating", "SELECT t.GameID, t.Season, t.WTeamID AS T1, t.LTeamID AS T2, round(a.Rating, 6) AS T1_Rating, round(b.Rating, 6) AS T2_Rating FROM tourney t LEFT JOIN rating a ON a.Season = t.Season AND a.TeamID = t.WTeamID LEFT JOIN rating b ON b.Season = t.Season AND b.TeamID = t.LTeamID"))
def join_twice_prefixed(spark, sf_dir):
    pairs = view(spark, sf_dir, "tourney").select("GameID", "Season", F.col("WTeamID").alias("T1"), F.col("LTeamID").alias("T2"))
    return R.join_twice_prefixed(pairs, view(spark, sf_dir, "rating").withColumn("Rating", r6("Rating")))


COMMON = with_views("glog", """, met AS (SELECT Season, TeamID, OppID, avg(Margin) AS m, avg(Win) AS w FROM glog GROUP BY 1, 2, 3)
SELECT a.Season, a.TeamID AS T1, b.TeamID AS T2, count(*) AS CommonOppCount, round(avg(a.m - b.m), 6) + 0 AS CommonOppMarginDiff, round(avg(a.w - b.w), 6) + 0 AS CommonOppWinPctDiff
FROM met a JOIN met b ON a.Season = b.Season AND a.OppID = b.OppID AND a.TeamID < b.TeamID WHERE a.OppID <> a.TeamID AND a.OppID <> b.TeamID GROUP BY 1, 2, 3""")


@query("join_self_common_opponent", COMMON)
def join_self_common_opponent(spark, sf_dir):
    out = R.join_common_opponents(view(spark, sf_dir, "glog"))
    return out.withColumns({c: r6(c) for c in ("CommonOppMarginDiff", "CommonOppWinPctDiff")})


@query("join_opponent_lookup", with_views("glog rating", "SELECT g.GameID, g.Season, g.TeamID, g.OppID, round(r.Rating, 6) AS OppRating FROM glog g LEFT JOIN rating r ON r.Season = g.Season AND r.TeamID = g.OppID"))
def join_opponent_lookup(spark, sf_dir):
    rating = view(spark, sf_dir, "rating").select("Season", F.col("TeamID").alias("OppID"), r6("Rating").alias("OppRating"))
    return view(spark, sf_dir, "glog").select("GameID", *KEY, "OppID").join(rating, ["Season", "OppID"], "left")


@query("join_semi_membership", with_views("regular tourney", "SELECT GameID, Season, WTeamID, LTeamID, CASE WHEN EXISTS (SELECT 1 FROM tourney t WHERE t.Season = r.Season AND t.WTeamID = r.WTeamID) THEN 1 ELSE 0 END AS WinnerInField FROM regular r WHERE EXISTS (SELECT 1 FROM tourney t WHERE t.Season = r.Season AND t.LTeamID = r.LTeamID)"))
def join_semi_membership(spark, sf_dir):
    games, field = view(spark, sf_dir, "regular").select("GameID", "Season", "WTeamID", "LTeamID"), view(spark, sf_dir, "tourney")
    return R.flag_membership(games.join(field, ["Season", "LTeamID"], "left_semi"), ["Season", "WTeamID"], field, "WinnerInField")


@query("join_anti_gap", with_views("contest", "SELECT 'missing' AS Kind, s_suppkey AS TeamID FROM supplier WHERE NOT EXISTS (SELECT 1 FROM contest WHERE WTeamID = s_suppkey) UNION ALL SELECT DISTINCT 'extra', WTeamID FROM contest WHERE WTeamID NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)"))
def join_anti_gap(spark, sf_dir):
    expected = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("TeamID"), "s_acctbal")
    actual = view(spark, sf_dir, "contest").select(F.col("WTeamID").alias("TeamID")).distinct()
    missing = expected.select("TeamID").join(actual, "TeamID", "left_anti").select(F.lit("missing").alias("Kind"), "TeamID")
    extra = actual.join(expected.where("s_acctbal > 0"), "TeamID", "left_anti").select(F.lit("extra").alias("Kind"), "TeamID")
    return missing.unionByName(extra)


FIELD = "field AS (SELECT Season, WTeamID AS TeamID FROM tourney UNION SELECT Season, LTeamID FROM tourney)"


def field(spark, sf_dir):
    games = view(spark, sf_dir, "tourney")
    return games.select("Season", F.explode(F.array("WTeamID", "LTeamID")).alias("TeamID")).distinct()


@query("join_pair_enumeration", with_views("tourney", f", {FIELD} SELECT a.Season, a.TeamID AS T1, b.TeamID AS T2 FROM field a JOIN field b ON a.Season = b.Season AND a.TeamID < b.TeamID"))
def join_pair_enumeration(spark, sf_dir):
    return R.join_pairs(field(spark, sf_dir))


@query("join_grid_cross", with_views("seeds", "SELECT s.Season, CAST(b.range AS INT) AS SeedBucket FROM (SELECT DISTINCT Season FROM seeds) s CROSS JOIN range(1, 17) b"))
def join_grid_cross(spark, sf_dir):
    seasons = view(spark, sf_dir, "seeds").select("Season").distinct()
    return seasons.withColumn("SeedBucket", F.explode(F.sequence(F.lit(1), F.lit(16))))


@query("join_asof_latest", with_views("ordinals", "SELECT Season, TeamID, SystemName, RankingDayNum, OrdinalRank FROM ordinals WHERE RankingDayNum <= 133 QUALIFY row_number() OVER (PARTITION BY Season, TeamID, SystemName ORDER BY RankingDayNum DESC, OrdinalRank) = 1"))
def join_asof_latest(spark, sf_dir):
    return R.join_asof_latest(view(spark, sf_dir, "ordinals"), ["Season", "TeamID", "SystemName"], "RankingDayNum", 133, ["OrdinalRank"]).select("Season", "TeamID", "SystemName", "RankingDayNum", "OrdinalRank")


@query("join_string_prefix", "SELECT DISTINCT p_name, a.alias FROM (SELECT DISTINCT p_name FROM part) p JOIN (SELECT DISTINCT string_split(p_name, ' ')[1] AS alias FROM part UNION SELECT DISTINCT p_name FROM part WHERE p_size % 2 = 0) a ON p_name = alias OR starts_with(p_name, alias || ' ') QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY length(alias) DESC, alias) = 1")
def join_string_prefix(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    aliases = part.select(F.split("p_name", " ")[0].alias("alias")).union(part.where("p_size % 2 = 0").select("p_name")).distinct()
    return R.join_longest_prefix(part, "p_name", aliases, "alias")


@query("agg_mean_count", with_views("glog", "SELECT Season, TeamID, round(avg(Margin), 6) AS AvgMargin, count(Margin) AS Games, sum(Win) AS Wins, min(Margin) AS WorstMargin, max(Margin) AS BestMargin FROM glog GROUP BY 1, 2"))
def agg_mean_count(spark, sf_dir):
    return view(spark, sf_dir, "glog").groupBy(*KEY).agg(r6(F.avg("Margin")).alias("AvgMargin"), F.count("Margin").alias("Games"), F.sum("Win").alias("Wins"), F.min("Margin").alias("WorstMargin"), F.max("Margin").alias("BestMargin"))


@query("agg_distinct_count", with_views("glog", "SELECT Season, TeamID, count(DISTINCT OppID) AS Opponents FROM glog GROUP BY 1, 2"))
def agg_distinct_count(spark, sf_dir):
    return view(spark, sf_dir, "glog").groupBy(*KEY).agg(F.countDistinct("OppID").alias("Opponents"))


@query("agg_stddev", with_views("glog", "SELECT Season, TeamID, round(stddev_samp(Margin), 6) AS SdSample, round(stddev_pop(Margin), 6) AS SdPopulation FROM glog GROUP BY 1, 2"))
def agg_stddev(spark, sf_dir):
    return view(spark, sf_dir, "glog").groupBy(*KEY).agg(r6(F.stddev_samp("Margin")).alias("SdSample"), r6(F.stddev_pop("Margin")).alias("SdPopulation"))


QUANTILES = (0.001, 0.01, 0.05, 0.25, 0.75, 0.95, 0.99, 0.999)


@query("agg_median_quantile", with_views("glog", "SELECT Season, median(Margin) AS Median, " + ", ".join(f"round(quantile_cont(Margin, {q}), 6) AS Q{str(q)[2:]}" for q in QUANTILES) + " FROM glog GROUP BY 1"))
def agg_median_quantile(spark, sf_dir):
    return view(spark, sf_dir, "glog").groupBy("Season").agg(F.median("Margin").alias("Median"), *(r6(F.percentile("Margin", q)).alias(f"Q{str(q)[2:]}") for q in QUANTILES))


@query("agg_conditional", with_views("glog", "SELECT Season, TeamID, CAST(sum(CASE WHEN IsHome = 1 THEN Win END) AS DOUBLE) AS HomeWins, bool_or(Margin > 40) AS AnyBlowout, round(avg(CASE WHEN abs(Margin) <= 5 THEN 1.0 ELSE 0.0 END), 6) AS CloseShare FROM glog GROUP BY 1, 2"))
def agg_conditional(spark, sf_dir):
    return view(spark, sf_dir, "glog").groupBy(*KEY).agg(F.sum(F.when(F.col("IsHome") == 1, F.col("Win"))).alias("HomeWins"), F.bool_or(F.col("Margin") > 40).alias("AnyBlowout"), r6(F.avg((F.abs("Margin") <= 5).cast("double"))).alias("CloseShare"))


@query("agg_weighted_mean", "SELECT l_linenumber, round(sum(greatest(coalesce(l_quantity, 1), 10.0) * l_discount) / sum(greatest(coalesce(l_quantity, 1), 10.0)), 6) AS MeanDiscount FROM lineitem GROUP BY 1")
def agg_weighted_mean(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(r6(R.weighted_mean(F.col("l_discount"), F.col("l_quantity"), 10.0)).alias("MeanDiscount"))


@query("agg_last_non_null", with_views("quotes", "SELECT Season, T1, T2, arg_max(Team1DecimalOdds, (SnapshotTime, Line, GameID, Part, Team1DecimalOdds)) FILTER (WHERE Team1DecimalOdds IS NOT NULL) AS Odds, arg_max(LastSpread, (SnapshotTime, Line, GameID, Part)) AS LastSpread FROM quotes GROUP BY 1, 2, 3"))
def agg_last_non_null(spark, sf_dir):
    order = [F.col(c) for c in ("SnapshotTime", "Line", "GameID", "Part")]
    return view(spark, sf_dir, "quotes").groupBy("Season", "T1", "T2").agg(R.last_non_null("Team1DecimalOdds", *order, F.col("Team1DecimalOdds")).alias("Odds"), R.last_non_null("LastSpread", *order).alias("LastSpread"))


@query("agg_null_preserving_sum", with_views("quotes", "SELECT Season, T1, T2, Line, round(sum(Team1DecimalOdds), 6) AS Total, round(coalesce(sum(Team1DecimalOdds), 0), 6) AS TotalOrZero FROM quotes GROUP BY 1, 2, 3, 4"))
def agg_null_preserving_sum(spark, sf_dir):
    total = F.sum("Team1DecimalOdds")
    return view(spark, sf_dir, "quotes").groupBy("Season", "T1", "T2", "Line").agg(r6(total).alias("Total"), r6(F.coalesce(total, F.lit(0.0))).alias("TotalOrZero"))


@query("agg_sorted_concat", with_views("quotes", "SELECT Season, T1, T2, string_agg(DISTINCT Book, '|' ORDER BY Book) AS Books FROM quotes GROUP BY 1, 2, 3"))
def agg_sorted_concat(spark, sf_dir):
    return view(spark, sf_dir, "quotes").groupBy("Season", "T1", "T2").agg(R.sorted_concat("Book").alias("Books"))


@query("agg_mixed_override", with_views("quotes", "SELECT Season, T1, T2, round(avg(1 / Team1DecimalOdds), 6) AS OverrideProb, max(1 / Team2DecimalOdds) AS ProbFloor, min(Team1DecimalOdds) AS ProbCeil, sum(LastSpread) AS LogitShift FROM quotes GROUP BY 1, 2, 3"))
def agg_mixed_override(spark, sf_dir):
    return view(spark, sf_dir, "quotes").groupBy("Season", "T1", "T2").agg(r6(F.avg(1 / F.col("Team1DecimalOdds"))).alias("OverrideProb"), F.max(1 / F.col("Team2DecimalOdds")).alias("ProbFloor"), F.min("Team1DecimalOdds").alias("ProbCeil"), F.sum("LastSpread").alias("LogitShift"))


SYSTEMS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")


@query("agg_pivot", with_views("ordinals", "SELECT Season, TeamID, " + ", ".join(f"round(avg(OrdinalRank) FILTER (WHERE SystemName = '{s}'), 6) AS \"{s}\"" for s in SYSTEMS) + " FROM ordinals GROUP BY 1, 2"))
def agg_pivot(spark, sf_dir):
    return view(spark, sf_dir, "ordinals").groupBy(*KEY).pivot("SystemName", list(SYSTEMS)).agg(r6(F.avg("OrdinalRank")))


@query("agg_coverage", with_views("quotes", "SELECT Season, round(avg(CASE WHEN Team1DecimalOdds IS NULL THEN 0.0 ELSE 1.0 END), 6) AS OddsCoverage, round(count(DISTINCT CASE WHEN Team1DecimalOdds IS NOT NULL THEN GameID END) / count(DISTINCT GameID), 6) AS GameCoverage FROM quotes GROUP BY 1"))
def agg_coverage(spark, sf_dir):
    has = F.col("Team1DecimalOdds").isNotNull()
    return view(spark, sf_dir, "quotes").groupBy("Season").agg(r6(F.avg(has.cast("double"))).alias("OddsCoverage"), r6(F.countDistinct(F.when(has, F.col("GameID"))) / F.countDistinct("GameID")).alias("GameCoverage"))


@query("agg_histogram", "SELECT CAST(b.range AS INT) AS bin, count(v) AS n FROM range(20) b LEFT JOIN (SELECT least(floor((s_acctbal + 1000) / 550.0), 19) AS v FROM supplier WHERE s_acctbal BETWEEN -1000 AND 10000) s ON s.v = b.range GROUP BY 1")
def agg_histogram(spark, sf_dir):
    return R.histogram(table(spark, sf_dir, "supplier"), "s_acctbal", -1000.0, 10000.0, 20)


@query("win_group_zscore", with_views("rating", "SELECT Season, TeamID, round((Rating - avg(Rating) OVER (PARTITION BY Season)) / CASE WHEN stddev_samp(Rating) OVER (PARTITION BY Season) IS NOT NULL THEN greatest(stddev_samp(Rating) OVER (PARTITION BY Season), 0.1) END, 6) AS Rating_z FROM rating"))
def win_group_zscore(spark, sf_dir):
    return view(spark, sf_dir, "rating").select(*KEY, r6(R.zscore("Rating")).alias("Rating_z"))


@query("win_rank_first", with_views("wins", "SELECT League, Season, TeamID, row_number() OVER (PARTITION BY League, Season ORDER BY Wins DESC, TeamID) AS rk FROM wins"))
def win_rank_first(spark, sf_dir):
    w = Window.partitionBy("League", "Season").orderBy(F.desc("Wins"), "TeamID")
    return view(spark, sf_dir, "wins").select("League", "Season", "TeamID", F.row_number().over(w).cast("long").alias("rk"))


@query("win_rank_pct_avg", with_views("wins", "SELECT Season, TeamID, League, round((rank() OVER (PARTITION BY League, Season ORDER BY Wins) + (count(*) OVER (PARTITION BY League, Season, Wins) - 1) / 2.0) / count(*) OVER (PARTITION BY League, Season), 6) AS Pct FROM wins"))
def win_rank_pct_avg(spark, sf_dir):
    return view(spark, sf_dir, "wins").select("Season", "TeamID", "League", r6(R.rank_pct_average("Wins", "League", "Season")).alias("Pct"))


@query("win_last_n", with_views("glog", "SELECT Season, TeamID, GameID, DayNum, Margin FROM glog QUALIFY row_number() OVER (PARTITION BY Season, TeamID ORDER BY DayNum DESC, GameID DESC) <= 10"))
def win_last_n(spark, sf_dir):
    return R.last_n(view(spark, sf_dir, "glog"), 10, KEY).select(*KEY, "GameID", "DayNum", "Margin")


@query("win_lookback_days", with_views("glog", "SELECT Season, TeamID, GameID, DayNum FROM (SELECT *, max(DayNum) OVER (PARTITION BY Season) AS last FROM glog) t WHERE DayNum >= last - 30"))
def win_lookback_days(spark, sf_dir):
    return R.lookback_days(view(spark, sf_dir, "glog"), 30).select(*KEY, "GameID", "DayNum")


@query("win_exp_decay", with_views("glog", "SELECT Season, TeamID, round(sum(Win * exp(-0.14 * (rn - 1))) / sum(exp(-0.14 * (rn - 1))), 6) AS DecayedWin FROM (SELECT *, row_number() OVER (PARTITION BY Season, TeamID ORDER BY DayNum DESC, GameID DESC) AS rn FROM glog) t WHERE rn <= 15 GROUP BY 1, 2"))
def win_exp_decay(spark, sf_dir):
    weight = F.exp(-0.14 * (F.col("_rn") - 1))
    return R.last_n(view(spark, sf_dir, "glog"), 15, KEY).groupBy(*KEY).agg(r6(F.sum(F.col("Win") * weight) / F.sum(weight)).alias("DecayedWin"))


@query("win_cumsum_prior", with_views("wins", "SELECT League, Season, TeamID, CAST(coalesce(sum(Wins) OVER (PARTITION BY League, TeamID ORDER BY Season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS PriorWins FROM wins"))
def win_cumsum_prior(spark, sf_dir):
    return view(spark, sf_dir, "wins").select("League", "Season", "TeamID", R.prior_sum("Wins", ["League", "TeamID"], "Season").alias("PriorWins"))


PRIMARY = """, spans AS (SELECT Season, TeamID, CoachName, sum(greatest(LastDayNum - FirstDayNum + 1, 1)) AS SpanDays FROM coaches GROUP BY 1, 2, 3),
chosen AS (SELECT Season, TeamID, CoachName, SpanDays FROM spans QUALIFY row_number() OVER (PARTITION BY Season, TeamID ORDER BY SpanDays DESC, CoachName) = 1)"""


@query("win_primary_by_weight", with_views("coaches", PRIMARY + " SELECT Season, TeamID, CoachName, CAST(SpanDays AS BIGINT) AS SpanDays FROM chosen"))
def win_primary_by_weight(spark, sf_dir):
    spans = view(spark, sf_dir, "coaches").groupBy(*KEY, "CoachName").agg(F.sum(F.greatest(F.col("LastDayNum") - F.col("FirstDayNum") + 1, F.lit(1))).alias("SpanDays"))
    return R.keep_last(spans, KEY, F.desc("SpanDays"), F.col("CoachName"))


STREAK = PRIMARY + """, marked AS (SELECT *, CASE WHEN lag(CoachName) OVER w = CoachName AND lag(Season) OVER w = Season - 1 THEN 0 ELSE 1 END AS brk, CASE WHEN lag(CoachName) OVER w <> CoachName THEN 1 ELSE 0 END AS Changed FROM chosen WINDOW w AS (PARTITION BY TeamID ORDER BY Season)),
islands AS (SELECT *, sum(brk) OVER (PARTITION BY TeamID ORDER BY Season) AS island FROM marked),
tenure AS (SELECT Season, TeamID, CAST(row_number() OVER (PARTITION BY TeamID, island ORDER BY Season) AS INT) AS Streak, Changed FROM islands)"""


@query("win_streak_islands", with_views("coaches", STREAK + " SELECT Season, TeamID, Streak, Changed FROM tenure"))
def win_streak_islands(spark, sf_dir):
    return R.streaks(win_primary_by_weight(spark, sf_dir), "TeamID", "Season", "CoachName").select(*KEY, "Streak", "Changed")


@query("dedup_keep_last", with_views("quotes", "SELECT Season, T1, T2, SnapshotTime, Line, GameID, Part FROM quotes QUALIFY row_number() OVER (PARTITION BY Season, T1, T2 ORDER BY SnapshotTime DESC, Line DESC, GameID DESC, Part DESC) = 1"))
def dedup_keep_last(spark, sf_dir):
    rows = view(spark, sf_dir, "quotes").select("Season", "T1", "T2", "SnapshotTime", "Line", "GameID", "Part")
    return R.keep_last(rows, ["Season", "T1", "T2"], F.desc("SnapshotTime"), F.desc("Line"), F.desc("GameID"), F.desc("Part"))


@query("topk_global", with_views("regular", "SELECT GameID, WScore - LScore AS Margin FROM regular ORDER BY 2 DESC, GameID LIMIT 50"))
def topk_global(spark, sf_dir):
    return view(spark, sf_dir, "regular").select("GameID", (F.col("WScore") - F.col("LScore")).alias("Margin")).orderBy(F.desc("Margin"), "GameID").limit(50)


@query("sort_custom_order", "SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END AS PriorityRank FROM orders ORDER BY PriorityRank, o_totalprice DESC, o_orderkey")
def sort_custom_order(spark, sf_dir):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).when(F.col("o_orderpriority") == "3-MEDIUM", 2).otherwise(3)
    return table(spark, sf_dir, "orders").withColumn("PriorityRank", rank).orderBy("PriorityRank", F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_orderpriority", "PriorityRank")


@query("extremes", with_views("rating", "(SELECT 'high' AS Kind, Season, TeamID, round(Rating, 6) AS Rating FROM rating ORDER BY Rating DESC, Season, TeamID LIMIT 20) UNION ALL (SELECT 'low', Season, TeamID, round(Rating, 6) FROM rating ORDER BY Rating, Season, TeamID LIMIT 20)"))
def extremes(spark, sf_dir):
    rating = view(spark, sf_dir, "rating")
    ends = [rating.orderBy(o, "Season", "TeamID").limit(20).select(F.lit(k).alias("Kind"), *KEY, r6("Rating").alias("Rating")) for k, o in (("high", F.desc("Rating")), ("low", F.asc("Rating")))]
    return ends[0].unionByName(ends[1])


@query("quote_gap_topk", with_views("tourney quotes", """, have AS (SELECT Season, least(T1, T2) AS T1, greatest(T1, T2) AS T2, count(DISTINCT Book) AS Books, count(Team1DecimalOdds) AS Probs, count(LastSpread) AS Spreads, count(DISTINCT Source) AS Sources FROM quotes GROUP BY 1, 2, 3),
pairs AS (SELECT DISTINCT Season, least(WTeamID, LTeamID) AS T1, greatest(WTeamID, LTeamID) AS T2 FROM tourney)
SELECT p.Season, p.T1, p.T2, 'books=' || coalesce(Books, 0) || ';probs=' || coalesce(Probs, 0) || ';spreads=' || coalesce(Spreads, 0) || ';sources=' || coalesce(Sources, 0) AS Note
FROM pairs p LEFT JOIN have h ON h.Season = p.Season AND h.T1 = p.T1 AND h.T2 = p.T2 ORDER BY p.Season DESC, coalesce(Books, 0), coalesce(Probs, 0), coalesce(Spreads, 0), coalesce(Sources, 0), p.T1, p.T2 LIMIT 100"""))
def quote_gap_topk(spark, sf_dir):
    pair = lambda a, b: [F.least(a, b).alias("T1"), F.greatest(a, b).alias("T2")]
    have = view(spark, sf_dir, "quotes").groupBy("Season", *pair("T1", "T2")).agg(F.countDistinct("Book").alias("Books"), F.count("Team1DecimalOdds").alias("Probs"), F.count("LastSpread").alias("Spreads"), F.countDistinct("Source").alias("Sources"))
    wanted = view(spark, sf_dir, "tourney").select("Season", *pair("WTeamID", "LTeamID")).distinct()
    counts = ["Books", "Probs", "Spreads", "Sources"]
    rows = wanted.join(have, ["Season", "T1", "T2"], "left").fillna(0, counts).orderBy(F.desc("Season"), *counts, "T1", "T2").limit(100)
    return rows.select("Season", "T1", "T2", F.format_string("books=%d;probs=%d;spreads=%d;sources=%d", *counts).alias("Note"))


@query("union_by_name", with_views("wins regular", "SELECT Season, TeamID, Wins, CAST(NULL AS BIGINT) AS Losses FROM (SELECT Season, TeamID, Wins FROM wins) a UNION ALL SELECT Season, LTeamID, NULL, count(*) FROM regular GROUP BY 1, 2"))
def union_by_name(spark, sf_dir):
    losses = view(spark, sf_dir, "regular").groupBy("Season", F.col("LTeamID").alias("TeamID")).agg(F.count("*").alias("Losses"))
    return view(spark, sf_dir, "wins").select("Season", "TeamID", "Wins").unionByName(losses, allowMissingColumns=True)


@query("union_distinct_ids", with_views("tourney", f", {FIELD} SELECT Season, TeamID FROM field"))
def union_distinct_ids(spark, sf_dir):
    games = view(spark, sf_dir, "tourney")
    return games.select("Season", F.col("WTeamID").alias("TeamID")).union(games.select("Season", "LTeamID")).distinct()


@query("intersect_ids", with_views("regular tourney", "SELECT Season, WTeamID AS TeamID FROM regular INTERSECT SELECT Season, LTeamID FROM tourney"))
def intersect_ids(spark, sf_dir):
    return view(spark, sf_dir, "regular").select("Season", F.col("WTeamID").alias("TeamID")).intersect(view(spark, sf_dir, "tourney").select("Season", "LTeamID"))


@query("except_ids", with_views("regular tourney", "SELECT Season, WTeamID AS TeamID FROM regular EXCEPT SELECT Season, WTeamID FROM tourney"))
def except_ids(spark, sf_dir):
    return view(spark, sf_dir, "regular").select("Season", F.col("WTeamID").alias("TeamID")).subtract(view(spark, sf_dir, "tourney").select("Season", "WTeamID"))


@query("drop_missing_keys", "SELECT try_cast(props->>'$.k' AS BIGINT) AS TeamID, event_id FROM events WHERE event_type <> 'view' AND try_cast(props->>'$.k' AS BIGINT) IS NOT NULL")
def drop_missing_keys(spark, sf_dir):
    raw = table(spark, sf_dir, "events").where("event_type <> 'view'").select(F.get_json_object("props", "$.k").alias("TeamID"), "event_id")
    return R.drop_missing_keys(raw, ["TeamID"])
