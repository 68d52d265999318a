"""Queries of quotes and matchups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import features as FE
from ..operators import market as M
from ..operators import matchup as U
from ..operators import relational as R
from .inputs import table, view, with_views
from .q_expressions import BIAS
from .q_features import POOL, VECTORS, pooled, rounded
from .q_relational import COMMON, FIELD, field
from .registry import query, r6

ODDS = ("Team1DecimalOdds", "Team2DecimalOdds")
TIE = ("Line", "GameID", "Part")


def quotes(spark, sf_dir):
    return view(spark, sf_dir, "quotes")


@query("canonicalize_pairs", with_views("quotes", BIAS + " SELECT GameID, Line, Part, least(T1, T2) AS T1, greatest(T1, T2) AS T2, round(CASE WHEN T1 > T2 THEN 1 - p ELSE p END, 6) AS p, CASE WHEN T1 > T2 THEN -LastSpread ELSE LastSpread END + 0 AS LastSpread FROM bias"))
def canonicalize_pairs(spark, sf_dir):
    rows = X.with_bias_corrected_prob(quotes(spark, sf_dir), *ODDS)
    out = M.canonicalize_pairs(rows.select("GameID", "Line", "Part", "T1", "T2", "p", "LastSpread"), complement=("p",), negate=("LastSpread",))
    return out.withColumns({"p": r6("p"), "LastSpread": F.col("LastSpread") + F.lit(0.0)})


def std_sql(mode: str) -> str:
    existing = "CASE WHEN Line % 2 = 0 THEN 0.4 + 0.02 * Line END"
    chosen = {"goto_prefer": f"coalesce(p, {existing})", "existing_prefer": f"coalesce({existing}, p)", "goto_only": "p", "existing_live_goto": f"CASE WHEN Season >= 1999 THEN coalesce(p, {existing}) ELSE {existing} END"}[mode]
    return with_views("quotes", BIAS + f""", c AS (SELECT *, greatest(0.000001, least(0.999999, CAST(coalesce({chosen}, 0.5) AS DOUBLE))) AS mp FROM bias),
g AS (SELECT Season, least(T1, T2) AS T1, greatest(T1, T2) AS T2, avg(CASE WHEN T1 > T2 THEN 1 - mp ELSE mp END) AS m, avg(CASE WHEN T1 > T2 THEN -LastSpread ELSE LastSpread END) AS s FROM c GROUP BY 1, 2, 3)
SELECT Season, T1, T2, round(m, 6) AS MarketProb, round(s, 6) AS LastSpread, round(ln(m / (1 - m)), 6) AS MarketLogit, round(abs(m - 0.5), 6) AS MarketConfidence FROM g""")


def _standard(mode):
    def run(spark, sf_dir):
        existing = F.when(F.col("Line") % 2 == 0, F.col("Line") * 0.02 + 0.4)
        return rounded(M.market_standardize(quotes(spark, sf_dir), existing, mode, 1999))

    return run


for _mode in ("goto_only", "goto_prefer", "existing_prefer", "existing_live_goto"):
    query(f"market_standardize_{_mode}", std_sql(_mode))(_standard(_mode))


FILL = ", filled AS (SELECT *, (1 / Team1DecimalOdds) / (1 / Team1DecimalOdds + 1 / Team2DecimalOdds) AS MarketProb, CAST(1 AS DOUBLE) AS BookCount FROM quotes)"


@query("market_standardize_fill", with_views("quotes", FILL + " SELECT GameID, Line, Part, round(MarketProb, 6) AS MarketProb, LastSpread, BookCount, Source FROM filled"))
def market_standardize_fill(spark, sf_dir):
    return rounded(M.market_fill(quotes(spark, sf_dir)).select("GameID", "Line", "Part", "MarketProb", "LastSpread", "BookCount", "Source"))


@query("market_mean_table", with_views("quotes", FILL + ", s AS (SELECT Source, Season, T1, T2, avg(MarketProb) AS p, avg(LastSpread) AS l FROM filled WHERE MarketProb IS NOT NULL GROUP BY 1, 2, 3, 4) SELECT Season, T1, T2, round(avg(p), 6) AS MarketProb, round(avg(ln(p / (1 - p))), 6) AS MarketLogit, round(avg(abs(p - 0.5)), 6) AS MarketConfidence, round(avg(l), 6) AS LastSpread, round(abs(avg(l)), 6) AS AbsLastSpread FROM s GROUP BY 1, 2, 3"))
def market_mean_table(spark, sf_dir):
    filled = M.market_fill(quotes(spark, sf_dir)).where("MarketProb is not null")
    each = filled.groupBy("Source", *M.PAIR).agg(F.avg("MarketProb").alias("MarketProb"), F.avg("LastSpread").alias("LastSpread"))
    return rounded(M.market_mean(each.withColumns({"MarketLogit": X.logit("MarketProb"), "MarketConfidence": F.abs(F.col("MarketProb") - 0.5)})))


ORDER = "(SnapshotTime, Source, Line, GameID, Part, coalesce({0}, -1e9))"
CONSENSUS = FILL + f""", cons AS (SELECT Season, T1, T2, arg_max(MarketProb, {ORDER.format('MarketProb')}) FILTER (WHERE MarketProb IS NOT NULL) AS p, arg_max(LastSpread, {ORDER.format('LastSpread')}) AS s, avg(MarketProb) AS pm, median(MarketProb) AS pd, stddev_pop(MarketProb) AS ps, avg(LastSpread) AS sm, median(LastSpread) AS sd, stddev_pop(LastSpread) AS ss, avg(BookCount) AS bm, max(BookCount) AS bx, sum(BookCount) AS bt, count(*) AS n, count(DISTINCT Source) AS k FROM filled GROUP BY 1, 2, 3)"""


@query("market_consensus", with_views("quotes", CONSENSUS + """ SELECT Season, T1, T2, round(p, 6) AS MarketProb, round(s, 6) AS LastSpread, round(pm, 6) AS MarketProbMean, round(pd, 6) AS MarketProbMedian, round(ps, 6) AS MarketProbStd, round(sm, 6) AS SpreadMean, round(sd, 6) AS SpreadMedian, round(ss, 6) AS SpreadStd, round(bm, 6) AS BookCountMean, round(bx, 6) AS BookCountMax, round(bt, 6) AS BookCountTotal, n AS MarketRowCount, k AS MarketSourceCount, round(ln(p / (1 - p)), 6) AS MarketLogit, round(abs(p - 0.5) * 2, 6) AS MarketConfidence, round(abs(s), 6) AS AbsLastSpread FROM cons"""))
def market_consensus(spark, sf_dir):
    filled = M.market_fill(quotes(spark, sf_dir)).withColumn("_p", F.coalesce("MarketProb", F.lit(-1e9)))
    return rounded(M.market_consensus(filled, *TIE, "_p"))


MODEL = ", model AS (SELECT Season, T1, T2, Source, SnapshotTime, Line, GameID, Part, CASE WHEN Line % 3 = 0 THEN NULL ELSE CAST(0.3 AS DOUBLE) + CAST(0.05 AS DOUBLE) * Line END AS ModelProb, LastSpread AS ModelSpread FROM quotes)"


@query("model_consensus", with_views("quotes", MODEL + " SELECT Season, T1, T2, round(CAST(l.p AS DOUBLE), 6) AS ModelMatchupProb, round(l.s, 6) AS ModelMatchupSpread, l.src AS Source, round(CAST(pm AS DOUBLE), 6) AS ModelMatchupProbMean, round(CAST(pd AS DOUBLE), 6) AS ModelMatchupProbMedian, round(ps, 6) AS ModelMatchupProbStd, round(sm, 6) AS ModelMatchupSpreadMean, k AS ModelSourceCount, n AS ModelRowCount, lst AS ModelSourceList FROM (SELECT Season, T1, T2, arg_max(struct_pack(p := ModelProb, s := ModelSpread, src := Source), (SnapshotTime, Source, Line, GameID, Part)) AS l, avg(ModelProb) AS pm, median(ModelProb) AS pd, stddev_pop(ModelProb) AS ps, avg(ModelSpread) AS sm, count(DISTINCT Source) AS k, count(*) AS n, string_agg(DISTINCT Source, '|' ORDER BY Source) AS lst FROM model GROUP BY 1, 2, 3) t"))
def model_consensus(spark, sf_dir):
    rows = quotes(spark, sf_dir).withColumns({"ModelProb": F.when(F.col("Line") % 3 != 0, F.col("Line") * 0.05 + 0.3), "ModelSpread": F.col("LastSpread")})
    return rounded(M.model_consensus(rows, *TIE))


@query("model_standardize", with_views("quotes", " SELECT GameID, Line, Part, least(T1, T2) AS T1, greatest(T1, T2) AS T2, round(CAST(CASE WHEN T1 > T2 THEN 1 - v ELSE v END AS DOUBLE), 6) AS ModelProb, round(CASE WHEN T1 > T2 THEN -LastSpread ELSE LastSpread END, 6) AS ModelSpread FROM (SELECT *, CASE WHEN Line % 3 = 0 THEN CAST(Line AS DOUBLE) / 10 ELSE 1 / Team1DecimalOdds END AS v FROM quotes) t"))
def model_standardize(spark, sf_dir):
    rows = quotes(spark, sf_dir).withColumns({"VendorProb": F.when(F.col("Line") % 3 == 0, F.col("Line") / 10), "Prob": X.decimal_to_prob(ODDS[0])})
    out = rows.select("GameID", "Line", "Part", "T1", "T2", X.coalesce_aliases(rows, ["ModelProb", "VendorProb", "Prob"]).alias("ModelProb"), X.coalesce_aliases(rows, ["ModelSpread", "LastSpread"]).alias("ModelSpread"))
    return rounded(M.canonicalize_pairs(out, complement=("ModelProb",), negate=("ModelSpread",)))


@query("market_file_metrics", with_views("quotes", FILL + " SELECT Season, count(*) AS n, round(avg(CASE WHEN LastSpread IS NULL THEN 0.0 ELSE 1.0 END), 6) AS SpreadCoverage, count(DISTINCT (T1, T2)) AS Pairs, count(DISTINCT CASE WHEN MarketProb IS NOT NULL THEN (T1, T2) END) AS PairsWithProb FROM filled GROUP BY 1"))
def market_file_metrics(spark, sf_dir):
    pair = F.struct("T1", "T2")
    return M.market_fill(quotes(spark, sf_dir)).groupBy("Season").agg(F.count("*").alias("n"), r6(F.avg(F.col("LastSpread").isNotNull().cast("double"))).alias("SpreadCoverage"), F.countDistinct(pair).alias("Pairs"), F.countDistinct(F.when(F.col("MarketProb").isNotNull(), pair)).alias("PairsWithProb"))


CURVE = ", curve AS (SELECT LastSpread AS Spread, sum(greatest(Line, 2.0) * Won) / sum(greatest(Line, 2.0)) AS WinPct, sum(Line) AS Games FROM (SELECT LastSpread, Line, CASE WHEN (T1 + Part) % 3 = 0 THEN 1.0 ELSE 0.0 END AS Won FROM quotes) t GROUP BY 1)"


def curve(spark, sf_dir):
    rows = quotes(spark, sf_dir).select("LastSpread", "Line", ((F.col("T1") + F.col("Part")) % 3 == 0).cast("double").alias("Won"))
    return rows.groupBy(F.col("LastSpread").alias("Spread")).agg(R.weighted_mean(F.col("Won"), F.col("Line"), 2.0).alias("WinPct"), F.sum("Line").alias("Games"))


@query("spread_curve", with_views("quotes", CURVE + " SELECT Spread, round(WinPct, 6) AS WinPct, CAST(Games AS BIGINT) AS Games FROM curve"))
def spread_curve(spark, sf_dir):
    return rounded(curve(spark, sf_dir), "Spread")


@query("flatten_event_snapshot", with_views("contest", "SELECT CAST(GameID AS VARCHAR) AS id, 'T' || WTeamID AS home_team, 'T' || LTeamID AS away_team, b.book, CASE WHEN GameID % 5 <> 0 OR b.book = 'beta' THEN 1 + WScore / 100 END AS home_price, CASE WHEN GameID % 5 <> 0 OR b.book = 'beta' THEN CASE WHEN GameID % 7 <> 0 THEN 1 + LScore / 100 END END AS away_price, CASE WHEN GameID % 3 = 0 THEN LScore - WScore END AS home_spread FROM contest CROSS JOIN (VALUES ('alpha'), ('beta')) b(book)"))
def flatten_event_snapshot(spark, sf_dir):
    outcome = lambda n, price, point: F.struct(n.alias("name"), price.alias("price"), point.alias("point"))
    none = F.lit(None).cast("double")
    home, away = F.concat(F.lit("T"), "WTeamID"), F.concat(F.lit("T"), "LTeamID")
    h2h = F.struct(F.lit("h2h").alias("key"), F.array(outcome(home, F.col("WScore") / 100 + 1, none), outcome(F.when(F.col("GameID") % 7 != 0, away).otherwise(F.lit("draw")), F.col("LScore") / 100 + 1, none)).alias("outcomes"))
    spreads = F.struct(F.when(F.col("GameID") % 3 == 0, "spreads").otherwise("totals").alias("key"), F.array(outcome(home, none, F.col("LScore") - F.col("WScore"))).alias("outcomes"))
    books = F.array(F.struct(F.lit("alpha").alias("key"), F.when(F.col("GameID") % 5 != 0, F.array(h2h, spreads)).otherwise(F.array(spreads)).alias("markets")), F.struct(F.lit("beta").alias("key"), F.array(h2h, spreads).alias("markets")))
    events = view(spark, sf_dir, "contest").select(F.to_json(F.struct(F.col("GameID").cast("string").alias("id"), home.alias("home_team"), away.alias("away_team"), books.alias("bookmakers"))).alias("event"))
    return M.flatten_events(events)


@query("prediction_market_rows", "WITH r AS (SELECT l_orderkey AS event, l_linenumber % 2 + 1 AS side, coalesce((bid + ask) / 2, last, bid, ask) AS q FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 THEN l_discount * 9 END AS bid, CASE WHEN l_linenumber % 4 <> 0 THEN l_discount * 9 + 0.05 END AS ask, CASE WHEN l_linenumber <> 7 THEN l_tax * 10 END AS last FROM lineitem) t), s AS (SELECT event, avg(q) FILTER (WHERE side = 1) AS q1, avg(q) FILTER (WHERE side = 2) AS q2 FROM r GROUP BY 1), f AS (SELECT event, coalesce(q1, 1 - q2) AS p1, coalesce(q2, 1 - q1) AS p2 FROM s) SELECT event, round(greatest(0.001, least(0.999, p1 / nullif(p1 + p2, 0))), 6) AS p1 FROM f WHERE p1 IS NOT NULL")
def prediction_market_rows(spark, sf_dir):
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event"), (n % 2 + 1).alias("side"), F.when(n % 3 != 0, F.col("l_discount") * 9).alias("bid"), F.when(n % 4 != 0, F.col("l_discount") * 9 + 0.05).alias("ask"), F.when(n != 7, F.col("l_tax") * 10).alias("last"))
    return rounded(M.prediction_contracts(rows))


@query("season_period_counts", with_views("tourney", f", {FIELD}, t AS (SELECT Season, count(*) AS Games, count(DISTINCT (least(WTeamID, LTeamID), greatest(WTeamID, LTeamID))) AS Pairs FROM tourney GROUP BY 1), u AS (SELECT Season, count(*) AS Teams FROM field GROUP BY 1) SELECT t.Season, Games, Pairs, Teams FROM t JOIN u ON t.Season = u.Season"))
def season_period_counts(spark, sf_dir):
    games = view(spark, sf_dir, "tourney").groupBy("Season").agg(F.count("*").alias("Games"), F.countDistinct(F.struct(F.least("WTeamID", "LTeamID"), F.greatest("WTeamID", "LTeamID"))).alias("Pairs"))
    return games.join(field(spark, sf_dir).groupBy("Season").agg(F.count("*").alias("Teams")), "Season")


# Matchups

LAB = ", lab AS (SELECT GameID, League, Season, DayNum, least(WTeamID, LTeamID) AS T1, greatest(WTeamID, LTeamID) AS T2, CASE WHEN WTeamID < LTeamID THEN 1 ELSE 0 END AS Label, CASE WHEN WTeamID < LTeamID THEN WScore - LScore ELSE LScore - WScore END AS MarginLabel FROM tourney)"


@query("matchup_labels", with_views("tourney", LAB + " SELECT * FROM lab"))
def matchup_labels(spark, sf_dir):
    return U.matchup_labels(view(spark, sf_dir, "tourney"))


TF = ", tf AS (SELECT Season, TeamID, avg(Win) AS WinRate, avg(Margin) AS AvgMargin, count(*) AS Games FROM glog GROUP BY 1, 2)"


def team_rows(spark, sf_dir):
    return FE.win_rate(FE.compact_game_log(view(spark, sf_dir, "regular")))


def sided(select: str, where: str = "") -> str:
    return with_views("tourney glog", LAB + TF + f" SELECT {select} FROM lab LEFT JOIN tf a ON a.Season = lab.Season AND a.TeamID = T1 LEFT JOIN tf b ON b.Season = lab.Season AND b.TeamID = T2 {where}")


@query("matchup_diffs", sided("GameID, round(a.WinRate - b.WinRate, 6) AS D_WinRate, round(a.AvgMargin - b.AvgMargin, 6) AS D_AvgMargin, a.Games - b.Games AS D_Games"))
def matchup_diffs(spark, sf_dir):
    rows = U.R.join_twice_prefixed(U.matchup_labels(view(spark, sf_dir, "tourney")), team_rows(spark, sf_dir))
    return rounded(U.matchup_diffs(rows, ["WinRate", "AvgMargin", "Games"]).select("GameID", "D_WinRate", "D_AvgMargin", "D_Games"))


CTX = TF + ", sn AS (SELECT Season, TeamID, CAST(substr(Seed, 2) AS INT) AS SeedNum FROM seeds), full_ AS (SELECT tf.*, SeedNum, ConfAbbrev FROM tf LEFT JOIN sn ON sn.Season = tf.Season AND sn.TeamID = tf.TeamID LEFT JOIN conferences c ON c.Season = tf.Season AND c.TeamID = tf.TeamID)"


@query("matchup_context", with_views("tourney glog seeds conferences", LAB + CTX + " SELECT GameID, abs(a.SeedNum - b.SeedNum) AS AbsSeedDiff, CASE WHEN a.SeedNum < b.SeedNum THEN 1 ELSE 0 END AS T1BetterSeed, CASE WHEN a.ConfAbbrev = b.ConfAbbrev THEN 1 ELSE 0 END AS SameConference, round(abs(a.WinRate - b.WinRate), 6) AS AbsWinRateDiff, round(coalesce(abs(a.WinRate - b.WinRate), 0) + coalesce(abs(a.AvgMargin - b.AvgMargin), 0), 6) AS StyleMismatchScore FROM lab LEFT JOIN full_ a ON a.Season = lab.Season AND a.TeamID = T1 LEFT JOIN full_ b ON b.Season = lab.Season AND b.TeamID = T2"))
def matchup_context(spark, sf_dir):
    key = ["Season", "TeamID"]
    rows = team_rows(spark, sf_dir).join(FE.seed_number(view(spark, sf_dir, "seeds")).select(*key, "SeedNum"), key, "left").join(view(spark, sf_dir, "conferences"), key, "left")
    out = U.matchup_context(U.R.join_twice_prefixed(U.matchup_labels(view(spark, sf_dir, "tourney")), rows), ["WinRate", "AvgMargin"])
    return rounded(out.select("GameID", "AbsSeedDiff", "T1BetterSeed", "SameConference", "AbsWinRateDiff", "StyleMismatchScore"))


H2H = ", h2h AS (SELECT Season, least(WTeamID, LTeamID) AS T1, greatest(WTeamID, LTeamID) AS T2, count(*) AS H2HGames, avg(CASE WHEN WTeamID < LTeamID THEN 1.0 ELSE 0.0 END) AS w, avg(CASE WHEN WTeamID < LTeamID THEN WScore - LScore ELSE LScore - WScore END) AS m FROM regular GROUP BY 1, 2, 3)"


@query("head_to_head", with_views("regular", H2H + " SELECT Season, T1, T2, H2HGames, round(w, 6) AS H2HT1WinPct, round(m, 6) AS H2HT1Margin FROM h2h"))
def head_to_head(spark, sf_dir):
    return rounded(U.head_to_head(view(spark, sf_dir, "regular")))


@query("common_opponents", COMMON)
def common_opponents(spark, sf_dir):
    return rounded(R.join_common_opponents(view(spark, sf_dir, "glog")))


@query("matchup_table", with_views("tourney glog regular", LAB + TF + H2H + " SELECT GameID, lab.Season, lab.T1, lab.T2, Label, round(a.WinRate - b.WinRate, 6) AS D_WinRate, round(a.AvgMargin - b.AvgMargin, 6) AS D_AvgMargin, H2HGames FROM lab LEFT JOIN tf a ON a.Season = lab.Season AND a.TeamID = lab.T1 LEFT JOIN tf b ON b.Season = lab.Season AND b.TeamID = lab.T2 LEFT JOIN h2h h ON h.Season = lab.Season AND h.T1 = lab.T1 AND h.T2 = lab.T2 WHERE a.WinRate - b.WinRate IS NOT NULL"))
def matchup_table(spark, sf_dir):
    out = U.matchup_table(view(spark, sf_dir, "tourney"), team_rows(spark, sf_dir), [U.head_to_head(view(spark, sf_dir, "regular"))], "WinRate")
    return rounded(out.select("GameID", "Season", "T1", "T2", "Label", "D_WinRate", "D_AvgMargin", "H2HGames"))


@query("market_merge", with_views("tourney quotes", LAB + CONSENSUS + ", mk AS (SELECT Season, least(T1, T2) AS T1, greatest(T1, T2) AS T2, avg(CASE WHEN T1 > T2 THEN 1 - pm ELSE pm END) AS p FROM cons GROUP BY 1, 2, 3) SELECT GameID, round(p, 6) AS MarketProb, CASE WHEN p IS NULL THEN 0 ELSE 1 END AS MarketAvailable FROM lab LEFT JOIN mk ON mk.Season = lab.Season AND mk.T1 = lab.T1 AND mk.T2 = lab.T2"))
def market_merge(spark, sf_dir):
    cons = M.market_consensus(M.market_fill(quotes(spark, sf_dir)), *TIE).select(*M.PAIR, F.col("MarketProbMean").alias("MarketProb"))
    market = M.canonicalize_pairs(cons, complement=("MarketProb",)).groupBy(*M.PAIR).agg(F.avg("MarketProb").alias("MarketProb"))
    return rounded(U.market_merge(U.matchup_labels(view(spark, sf_dir, "tourney")), market).select("GameID", "MarketProb", "MarketAvailable"))


@query("signal_merge", sided("GameID, round(a.WinRate, 6) AS T1_Signal, round(b.WinRate, 6) AS T2_Signal, round(coalesce(a.WinRate, 0) - coalesce(b.WinRate, 0), 6) AS D_Signal"))
def signal_merge(spark, sf_dir):
    signals = team_rows(spark, sf_dir).select("Season", "TeamID", F.col("WinRate").alias("Signal"))
    return rounded(U.signal_merge(U.matchup_labels(view(spark, sf_dir, "tourney")), signals).select("GameID", "T1_Signal", "T2_Signal", "D_Signal"))


@query("pair_template", with_views("tourney", f", {FIELD} SELECT a.Season || '_' || a.TeamID || '_' || b.TeamID AS ID, CAST(0.5 AS DOUBLE) AS Pred FROM field a JOIN field b ON a.Season = b.Season AND a.TeamID < b.TeamID"))
def pair_template(spark, sf_dir):
    return R.join_pairs(field(spark, sf_dir)).select(X.pair_id(F.col("Season"), F.col("T1"), F.col("T2")).alias("ID"), F.lit(0.5).alias("Pred"))


@query("field_profile", with_views("tourney glog", TF + f", {FIELD}, d AS (SELECT x.Season, a.WinRate - b.WinRate AS w, a.AvgMargin - b.AvgMargin AS m FROM field x JOIN field y ON x.Season = y.Season AND x.TeamID < y.TeamID LEFT JOIN tf a ON a.Season = x.Season AND a.TeamID = x.TeamID LEFT JOIN tf b ON b.Season = y.Season AND b.TeamID = y.TeamID) SELECT Season, 'WinRate' AS Feature, round(avg(w), 6) AS FieldMean, round(CASE WHEN stddev_samp(w) IS NOT NULL THEN greatest(stddev_samp(w), 0.1) END, 6) AS FieldStd FROM d GROUP BY 1 UNION ALL SELECT Season, 'AvgMargin', round(avg(m), 6), round(CASE WHEN stddev_samp(m) IS NOT NULL THEN greatest(stddev_samp(m), 0.1) END, 6) FROM d GROUP BY 1"))
def field_profile(spark, sf_dir):
    return rounded(U.field_profile(field(spark, sf_dir), team_rows(spark, sf_dir).select("Season", "TeamID", "WinRate", "AvgMargin")))


def _text_sql() -> str:
    side = lambda t, v: f"coalesce({t}.{v}, list_resize(CAST([] AS DOUBLE[]), (SELECT max(len({v})) FROM pool), CAST(0 AS DOUBLE)))"
    three = [f"list_transform(list_zip({side('a', v)}, {side('b', v)}), lambda x: round({e}, 6)) AS {n}_{v}" for v in VECTORS for n, e in (("D", "x[1] - x[2]"), ("AbsD", "abs(x[1] - x[2])"), ("Mean", "(x[1] + x[2]) / 2"))]
    n = lambda t, c: f"coalesce({t}.{c}, 0)"
    counts = [f"{n('a', c)} - {n('b', c)} AS D_{c}" for c in ("DocCount", "WindowDocCount")] + [f"{n('a', 'DocCount')} + {n('b', 'DocCount')} AS DocCountTotal", f"least({n('a', 'DocCount')}, {n('b', 'DocCount')}) AS DocCountMin"]
    return f"{LAB}, {POOL} SELECT GameID, {', '.join(three + counts)} FROM lab LEFT JOIN pool a ON a.Season = lab.Season AND a.TeamID = T1 LEFT JOIN pool b ON b.Season = lab.Season AND b.TeamID = T2"


@query("text_matchup_features", with_views("tourney", _text_sql()))
def text_matchup_features(spark, sf_dir):
    out, names = U.text_matchup_features(U.matchup_labels(view(spark, sf_dir, "tourney")), pooled(spark, sf_dir), list(VECTORS))
    lists = {c for c, t in out.dtypes if t == "array<double>"}
    return out.select("GameID", *(F.transform(c, lambda x: r6(x)).alias(c) if c in lists else F.col(c) for c in names))
