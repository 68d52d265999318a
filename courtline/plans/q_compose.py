"""Queries of compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import layouts as LY
from ..operators import compose as C
from ..operators import features as FE
from ..operators import market as M
from ..operators import ratings as RT
from ..operators import relational as R
from . import q_live  # noqa: F401
from .inputs import table, view, with_views
from .q_features import log_of, rounded
from .q_rules import FINAL, S, final_rows
from .registry import query, r6

KEY = ["Season", "TeamID"]
ODDS = ("Team1DecimalOdds", "Team2DecimalOdds")
FIN = f", fin AS (SELECT *, {FINAL} AS FinalProb FROM scored)"


@query("odds_prepare", with_views("quotes", "SELECT Season, T1, T2, round(avg(greatest(0.001, least(0.999, (1 / Team1DecimalOdds) / (1 / Team1DecimalOdds + 1 / Team2DecimalOdds)))) FILTER (WHERE Team1DecimalOdds IS NOT NULL), 6) AS NoVigProb, round(avg(1 / Team1DecimalOdds + 1 / Team2DecimalOdds - 1), 6) AS Hold, round(avg(LastSpread), 6) AS LastSpread, string_agg(DISTINCT Book, '|' ORDER BY Book) AS Books, count(DISTINCT Book) AS BookCount, max(SnapshotTime) AS SnapshotTime FROM quotes GROUP BY 1, 2, 3"))
def odds_prepare(spark, sf_dir):
    return rounded(C.odds_prepare(view(spark, sf_dir, "quotes"), ODDS, "SnapshotTime"))


MH = ", mq AS (SELECT Season, least(T1, T2) AS T1, greatest(T1, T2) AS T2, CASE WHEN T1 > T2 THEN 1 - q ELSE q END AS MarketProb FROM (SELECT *, (1 / Team1DecimalOdds) / (1 / Team1DecimalOdds + 1 / Team2DecimalOdds) AS q FROM quotes) t), ok AS (SELECT Season, T1, T2, avg(MarketProb) AS p, count(*) AS n FROM mq WHERE MarketProb > 0 AND MarketProb < 1 GROUP BY 1, 2, 3), real AS (SELECT DISTINCT Season, T1, T2 FROM lab)"


def history(spark, sf_dir):
    rows = view(spark, sf_dir, "quotes")
    a, b = (X.decimal_to_prob(c) for c in ODDS)
    rows = M.canonicalize_pairs(rows.select(*M.PAIR, F.try_divide(a, a + b).alias("MarketProb")), complement=("MarketProb",))
    return C.market_history(rows, view(spark, sf_dir, "lab"))


@query("market_history", with_views("quotes lab", MH + " SELECT Season, T1, T2, round(p, 6) AS MarketProb, n AS Rows FROM ok"))
def market_history(spark, sf_dir):
    return rounded(history(spark, sf_dir)[0])


@query("market_history_coverage", with_views("quotes lab", MH + " SELECT r.Season, count(*) AS Pairs, count(p) AS Covered, round(avg(CASE WHEN p IS NULL THEN 0.0 ELSE 1.0 END), 6) AS Coverage FROM real r LEFT JOIN ok ON ok.Season = r.Season AND ok.T1 = r.T1 AND ok.T2 = r.T2 GROUP BY 1"))
def market_history_coverage(spark, sf_dir):
    return rounded(history(spark, sf_dir)[1])


START = ", st AS (SELECT Season, WTeamID AS T1, LTeamID AS T2, max(make_date(Season, 1, 1) + CAST(DayNum AS INT)) AS StartDate FROM contest GROUP BY 1, 2, 3)"


@query("historical_odds_training_rows", with_views("quotes contest", START + " SELECT GameID, Line, Part, CASE WHEN SnapshotTime <= StartDate THEN 1 ELSE 0 END AS Verified FROM quotes q JOIN st ON st.Season = q.Season AND st.T1 = q.T1 AND st.T2 = q.T2"))
def historical_odds_training_rows(spark, sf_dir):
    games = view(spark, sf_dir, "contest").groupBy("Season", F.col("WTeamID").alias("T1"), F.col("LTeamID").alias("T2")).agg(F.max(F.date_add(F.make_date("Season", F.lit(1), F.lit(1)), F.col("DayNum"))).alias("StartDate"))
    return C.training_quotes(view(spark, sf_dir, "quotes"), games, "SnapshotTime", "StartDate").select("GameID", "Line", "Part", "Verified")


@query("historical_odds_snapshot", with_views("quotes", "SELECT Season, T1, T2, round((1 / Team1DecimalOdds) / (1 / Team1DecimalOdds + 1 / Team2DecimalOdds), 6) AS MarketProb, Source FROM quotes QUALIFY row_number() OVER (PARTITION BY Season, T1, T2 ORDER BY SnapshotTime DESC, Line DESC, GameID DESC, Part DESC) = 1"))
def historical_odds_snapshot(spark, sf_dir):
    filled = M.market_fill(view(spark, sf_dir, "quotes"))
    last = R.keep_last(filled, M.PAIR, F.desc("SnapshotTime"), F.desc("Line"), F.desc("GameID"), F.desc("Part"))
    return rounded(last.select(*M.PAIR, "MarketProb", "Source"))


CENTS = """, x AS (SELECT *, CAST(Part % 105 - 2 AS DOUBLE) / 100 AS a, CASE WHEN Part % 3 <> 0 THEN CAST(Part % 97 AS DOUBLE) / 100 END AS b, CASE WHEN Line <> 3 THEN Book ELSE 'prediction_market' END AS bk FROM quotes),
y AS (SELECT *, CASE WHEN a > 0 AND a < 1 THEN a END AS va, CASE WHEN b > 0 AND b < 1 THEN b END AS vb FROM x), z AS (SELECT *, greatest(0.001, least(0.999, coalesce(va, 1 - vb))) AS p1, greatest(0.001, least(0.999, coalesce(vb, 1 - va))) AS p2, va IS NULL AND vb IS NULL AS no FROM y),
m AS (SELECT *, {am1} AS m1, {am2} AS m2, T1 > T2 AS f FROM z), k AS (SELECT * FROM (SELECT *, least(T1, T2) AS c1, greatest(T1, T2) AS c2 FROM m) t QUALIFY row_number() OVER (PARTITION BY Season, c1, c2, bk, SnapshotTime ORDER BY GameID DESC, Line DESC, Part DESC) = 1)
SELECT Season, c1 AS T1, c2 AS T2, bk AS Book, round(CASE WHEN no THEN NULL WHEN f THEN 1 - p1 ELSE p1 END, 6) AS MarketProb, CASE WHEN f THEN m2 ELSE m1 END AS Team1Moneyline, CASE WHEN f THEN m1 ELSE m2 END AS Team2Moneyline, round(CASE WHEN f THEN -LastSpread ELSE LastSpread END, 6) AS LastSpread, Source FROM k""".format(
    **{f"am{i}": f"CASE WHEN no THEN NULL ELSE CAST(round_even(CASE WHEN p{i} >= 0.5 THEN p{i} * -100 / (1 - p{i}) ELSE (1 - p{i}) * 100 / p{i} END, 0) AS BIGINT) END" for i in (1, 2)}
)


@query("prediction_market_convert", with_views("quotes", CENTS))
def prediction_market_convert(spark, sf_dir):
    q = view(spark, sf_dir, "quotes")
    rows = q.select("Season", "T1", "T2", (F.col("Part") % 105 - 2).alias("YesCents"), F.when(F.col("Part") % 3 != 0, F.col("Part") % 97).alias("NoPriceCents"), "LastSpread", F.when(F.col("Line") != 3, F.concat(F.lit(" "), "Book", F.lit(" "))).alias("Book"), "SnapshotTime", "Source", "GameID", "Line", "Part")
    out = C.prediction_market_convert(rows, F.desc("GameID"), F.desc("Line"), F.desc("Part"))
    return rounded(out.select("Season", "T1", "T2", "Book", "MarketProb", "Team1Moneyline", "Team2Moneyline", "LastSpread", "Source"))


@query("host_structure", with_views("scored", "SELECT GameID, CASE WHEN Round = 1 THEN 1 ELSE 0 END AS IsRound1, CASE WHEN Round = 2 THEN 1 ELSE 0 END AS IsRound2, CASE WHEN Round IN (1, 2) THEN 1 ELSE 0 END AS IsRound1Or2, CASE WHEN Round IN (1, 2) AND T1_SeedNum <= 4 AND T1_SeedNum < T2_SeedNum THEN 1 WHEN Round IN (1, 2) AND T2_SeedNum <= 4 AND T2_SeedNum < T1_SeedNum THEN -1 ELSE 0 END AS D_HostLikely FROM (SELECT *, CAST(GameID % 4 AS INT) AS Round FROM scored) t"))
def host_structure(spark, sf_dir):
    rows = view(spark, sf_dir, "scored").withColumn("Round", (F.col("GameID") % 4).cast("int"))
    return C.host_structure(rows).select("GameID", "IsRound1", "IsRound2", "IsRound1Or2", "D_HostLikely")


POD = " OR ".join(f"(x = {s} AND y IN {f})" for s, f in ((1, "(16)"), (2, "(15)"), (3, "(14)"), (4, "(13)")))
POD2 = " OR ".join(f"(x = {s} AND y IN {f})" for s, f in ((1, "(8, 9)"), (2, "(7, 10)"), (3, "(6, 11)"), (4, "(5, 12)")))


@query("host_pod_match", with_views("seeds", f"SELECT League, Season, A, B, CASE WHEN {POD} THEN 'round1' WHEN {POD2} THEN 'round2' END AS Pod FROM (SELECT a.League, a.Season, a.TeamID AS A, b.TeamID AS B, CAST(substr(a.Seed, 2) AS INT) AS x, CAST(substr(b.Seed, 2) AS INT) AS y FROM seeds a JOIN seeds b ON a.League = b.League AND a.Season = b.Season AND a.TeamID <> b.TeamID AND substr(a.Seed, 1, 1) = substr(b.Seed, 1, 1)) t"))
def host_pod_match(spark, sf_dir):
    seeds = view(spark, sf_dir, "seeds").withColumn("Region", F.substring("Seed", 1, 1))
    side = lambda t, s: seeds.select("League", "Season", "Region", F.col("TeamID").alias(t), F.col("Seed").alias(s))
    both = side("A", "sa").join(side("B", "sb"), ["League", "Season", "Region"]).where("A <> B")
    return both.select("League", "Season", "A", "B", C.host_pod_match(F.col("sa"), F.col("sb")).alias("Pod"))


FILL = "coalesce((coalesce(RawProb, 0) + coalesce(MarketProb, 0) + coalesce(ModelMatchupProb, 0)) / nullif((RawProb IS NOT NULL)::INT + (MarketProb IS NOT NULL)::INT + (ModelMatchupProb IS NOT NULL)::INT, 0), 0.5)"


@query("route_group_features", with_views("live", f", g AS (SELECT *, {FILL} AS mm FROM live), h AS (SELECT *, coalesce(RawProb, mm) AS r, coalesce(MarketProb, mm) AS m, coalesce(ModelMatchupProb, mm) AS d FROM g) SELECT GameID, round((m + d) / 2, 6) AS market_mean, round(sqrt((m - (m + d) / 2) ** 2 + (d - (m + d) / 2) ** 2), 6) AS market_std, (MarketProb IS NOT NULL)::INT + (ModelMatchupProb IS NOT NULL)::INT AS market_count, round(r, 6) AS stats_mean, round(0, 6) AS stats_std, CAST(1 AS INT) AS stats_count, round(0.5, 6) AS text_mean, round(0, 6) AS text_std, CAST(0 AS INT) AS text_count FROM h".replace("round(0, 6)", "CAST(0 AS DOUBLE)").replace("round(0.5, 6)", "CAST(0.5 AS DOUBLE)")))
def route_group_features(spark, sf_dir):
    groups = {"market": ["MarketProb", "ModelMatchupProb"], "stats": ["RawProb"], "text": []}
    out, names = C.route_group_features(C.fill_routes(view(spark, sf_dir, "live"), [c for g in groups.values() for c in g]), groups)
    return rounded(out.select("GameID", *names), "text_mean", "text_std", "stats_std")


@query("simple_candidates", S("Candidate, round(Brier, 6) AS Brier, CASE WHEN row_number() OVER (ORDER BY round(Brier, 9), Candidate) = 1 THEN 1 ELSE 0 END AS Best FROM (SELECT 'raw' AS Candidate, avg((RawProb - Label) ** 2) AS Brier FROM fin UNION ALL SELECT 'half', avg((0.5 * RawProb + 0.5 * coalesce(MarketProb, RawProb) - Label) ** 2) FROM fin) t", FIN))
def simple_candidates(spark, sf_dir):
    return rounded(C.simple_candidates(final_rows(spark, sf_dir), {"raw": {"RawProb": 1.0}, "half": {"RawProb": 0.5, "MarketProb": 0.5}}))


W = "power({0} + 0.0001, -1.5)"
L1, L2 = "(RawProb - 0.5) ** 2", "0.05"


@query("loss_weighted_selector", S(f"GameID, round(CASE WHEN MarketProb IS NULL THEN RawProb ELSE ({W.format(L1)} * RawProb + {W.format(L2)} * MarketProb) / ({W.format(L1)} + {W.format(L2)}) END, 6) AS Selected FROM scored"))
def loss_weighted_selector(spark, sf_dir):
    rows = view(spark, sf_dir, "scored").withColumns({"l1": F.pow(F.col("RawProb") - 0.5, 2), "l2": F.lit(0.05)})
    return rounded(C.loss_weights(rows, ["RawProb", "MarketProb"], ["l1", "l2"]).select("GameID", "Selected"))


RESUME = """, pc AS (SELECT Season, TeamID AS OppID, CAST((rank() OVER (PARTITION BY Season ORDER BY -Rating) + (count(*) OVER (PARTITION BY Season, Rating) - 1) / 2.0) / count(*) OVER (PARTITION BY Season) AS DOUBLE) AS pct FROM rating),
x AS (SELECT g.*, pct, CASE WHEN r.WLoc = 'N' THEN 1.0 ELSE 0.0 END AS neutral, CASE WHEN pct <= 0.25 THEN 1 WHEN pct <= 0.5 THEN 2 WHEN pct <= 0.75 THEN 3 WHEN pct IS NOT NULL THEN 4 END AS q FROM glog g JOIN regular r ON r.GameID = g.GameID LEFT JOIN pc ON pc.Season = g.Season AND pc.OppID = g.OppID),
y AS (SELECT *, Win = 1 AND row_number() OVER (PARTITION BY Season, TeamID, Win ORDER BY pct NULLS LAST, GameID) <= 5 AS best, Win = 0 AND row_number() OVER (PARTITION BY Season, TeamID, Win ORDER BY pct DESC NULLS LAST, GameID) <= 5 AS worst FROM x)
SELECT Season, TeamID, count(*) FILTER (WHERE q = 1) AS Q1Games, count(*) FILTER (WHERE q = 1 AND Win = 1) AS Q1Wins, count(*) FILTER (WHERE q = 2) AS Q2Games, count(*) FILTER (WHERE q = 2 AND Win = 1) AS Q2Wins, round(avg(CASE WHEN abs(Margin) <= 5 THEN 1.0 ELSE 0.0 END), 6) AS CloseGameRate, round(avg(Win) FILTER (WHERE abs(Margin) <= 5), 6) AS CloseGameWinRate, round(avg(neutral), 6) AS NeutralGameRate,
round(avg(1 - pct) FILTER (WHERE best), 6) AS BestWinQualityMean, round(max(1 - pct) FILTER (WHERE best), 6) AS BestWinQualityMax, count(*) FILTER (WHERE best AND q = 1) AS BestWinQ1Count, round(avg(q) FILTER (WHERE worst), 6) AS WorstLossQuadrantMean, count(*) FILTER (WHERE worst AND q >= 3) AS BadLossCountQ3Q4 FROM y GROUP BY 1, 2"""


@query("schedule_resume_summary", with_views("glog regular rating", RESUME))
def schedule_resume_summary(spark, sf_dir):
    rating = view(spark, sf_dir, "rating").withColumn("_neg", -F.col("Rating"))
    pct = rating.select("Season", F.col("TeamID").alias("OppID"), R.rank_pct_average("_neg", "Season").alias("OppPct"))
    games = view(spark, sf_dir, "regular").select("GameID", (F.col("WLoc") == "N").cast("int").alias("IsNeutral"))
    return rounded(C.schedule_resume(view(spark, sf_dir, "glog").join(games, "GameID").join(pct, ["Season", "OppID"], "left")))


@query("manual_signals", with_views("contest", "SELECT Season, WTeamID AS TeamID, round(sum(WScore / 100), 6) AS Signal_Power, round(sum(CASE WHEN DayNum % 2 = 0 THEN LScore / 100 END), 6) AS Signal_Form, round(coalesce(sum(WScore / 100), 0) + coalesce(sum(CASE WHEN DayNum % 2 = 0 THEN LScore / 100 END), 0), 6) AS Signal_ManualComposite FROM contest GROUP BY 1, 2"))
def manual_signals(spark, sf_dir):
    sums = view(spark, sf_dir, "contest").groupBy("Season", F.col("WTeamID").alias("TeamID")).agg(F.sum(F.col("WScore") / 100).alias("Signal_Power"), F.sum(F.when(F.col("DayNum") % 2 == 0, F.col("LScore") / 100)).alias("Signal_Form"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rounded(sums.withColumn("Signal_ManualComposite", zero(F.col("Signal_Power")) + zero(F.col("Signal_Form"))))


@query("event_date", "SELECT event_id, CASE WHEN event_id % 7 = 6 THEN NULL ELSE CAST(ts AS DATE) END AS at FROM events")
def event_date(spark, sf_dir):
    """Seven layouts by number: ticker, five texts (one after a text that is no date), a time stamp, and nothing that can be read."""
    k = F.col("event_id") % 7
    as_ = lambda f: F.date_format("ts", f)
    ticker = F.when(k == 0, F.concat(F.lit("GAME-"), F.upper(as_("yyMMMdd")), F.lit("AAABBB"))).otherwise("GAME-26XYZ01")
    first = F.when(k == 1, as_("yyyy-MM-dd")).when(k == 2, as_("MMM d, yyyy")).when(k == 3, F.lit("Round of 64"))
    second = F.when(k == 3, as_("MMMM d yyyy")).when(k == 4, as_("M/d/yyyy"))
    stamp = F.when(k == 5, as_("yyyy-MM-dd'T'HH:mm:ss")).when(k == 6, F.lit("soon"))
    return table(spark, sf_dir, "events").select("event_id", LY.event_date(ticker, [first, second], [stamp]).alias("at"))


@query("name_variants", r"SELECT p_partkey, v AS variant FROM (SELECT p_partkey, unnest(list_distinct([p_name, p_name || ' w', string_split(p_name, ' ')[1]])) AS v FROM part) t")
def name_variants(spark, sf_dir):
    variants = F.array_distinct(F.array("p_name", F.concat("p_name", F.lit(" w")), F.split("p_name", " ")[0]))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(variants).alias("variant"))


@query("holdout_plan", S("Season, CASE WHEN Season > (SELECT max(Season) - 2 FROM scored) THEN 'holdout' ELSE 'tune' END AS Part, count(*) AS n, round(avg((RawProb - Label) ** 2), 6) AS Brier FROM scored GROUP BY 1, 2"))
def holdout_plan(spark, sf_dir):
    rows = view(spark, sf_dir, "scored")
    last = rows.agg((F.max("Season") - 2).alias("_cut"))
    part = F.when(F.col("Season") > F.col("_cut"), "holdout").otherwise("tune")
    return rounded(rows.crossJoin(F.broadcast(last)).groupBy("Season", part.alias("Part")).agg(F.count("*").alias("n"), F.avg(F.pow(F.col("RawProb") - F.col("Label"), 2)).alias("Brier")))


@query("seed_path_features", with_views("slots seeds rating", ", sides AS (SELECT Slot, 'strong' AS Side, StrongSeed AS Node FROM slots UNION ALL SELECT Slot, 'weak', WeakSeed FROM slots), kids AS (SELECT Slot AS Node, StrongSeed AS child FROM slots UNION ALL SELECT Slot, WeakSeed FROM slots), d AS (SELECT Slot, Side, Node FROM sides UNION SELECT d.Slot, d.Side, kids.child FROM d JOIN kids ON kids.Node = d.Node), leaf AS (SELECT * FROM d WHERE Node NOT IN (SELECT Slot FROM slots)), mt AS (SELECT DISTINCT CAST(substr(a.Slot, 2, 1) AS INT) AS Round, CAST(substr(a.Node, 2) AS INT) AS x, CAST(substr(b.Node, 2) AS INT) AS y FROM leaf a JOIN leaf b ON a.Slot = b.Slot AND a.Side <> b.Side), bk AS (SELECT s.League, s.Season, s.TeamID, CAST(substr(Seed, 2) AS INT) AS b, Rating FROM seeds s JOIN rating r ON r.Season = s.Season AND r.TeamID = s.TeamID), st AS (SELECT League, Season, b, avg(Rating) AS m FROM bk GROUP BY 1, 2, 3) SELECT k.League, k.Season, k.TeamID, mt.Round, round(avg(st.m), 6) AS PathDifficulty, round(avg(mt.y), 6) AS PathSeedMean FROM bk k JOIN mt ON mt.x = k.b LEFT JOIN st ON st.League = k.League AND st.Season = k.Season AND st.b = mt.y GROUP BY 1, 2, 3, 4", recursive=True))
def seed_path_features(spark, sf_dir):
    by = ["League", "Season"]
    teams = FE.seed_number(view(spark, sf_dir, "seeds")).join(view(spark, sf_dir, "rating"), KEY).select(*by, "TeamID", "SeedNum", "Rating")
    strength = teams.groupBy(*by, F.col("SeedNum").alias("OppSeed")).agg(F.avg("Rating").alias("m"))
    paths = F.broadcast(RT.seed_opponent_map(view(spark, sf_dir, "slots")).select("SeedNum", "Round", F.explode("Opponents").alias("OppSeed")))  # 16 seeds, 6 rounds
    met = teams.join(paths, "SeedNum").join(strength, [*by, "OppSeed"], "left")
    return rounded(met.groupBy(*by, "TeamID", "Round").agg(F.avg("m").alias("PathDifficulty"), F.avg("OppSeed").alias("PathSeedMean")))
