"""Queries of the scalar expressions, filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import layouts as LY
from ..functions import filters as P
from .inputs import table, view, with_views
from .registry import query, r6

D1, D2 = "Team1DecimalOdds", "Team2DecimalOdds"
CLIPPED = "CASE WHEN {0} IS NOT NULL THEN greatest(0.000001, least(0.999999, {0})) END"
AMERICAN = "round((l_discount - 0.05) * 8000)"


def quotes(spark, sf_dir):
    return view(spark, sf_dir, "quotes")


def priced(spark, sf_dir):
    """Line items with American odds made of their discount: negative, zero and positive."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.round((F.col("l_discount") - 0.05) * 8000).alias("odds"))


@query("american_to_prob", f"SELECT l_orderkey, l_partkey, l_linenumber, round(CASE WHEN {AMERICAN} < 0 THEN -{AMERICAN} / (-{AMERICAN} + 100) ELSE 100 / ({AMERICAN} + 100) END, 6) AS prob FROM lineitem")
def american_to_prob(spark, sf_dir):
    return priced(spark, sf_dir).select("l_orderkey", "l_partkey", "l_linenumber", r6(X.american_to_prob("odds")).alias("prob"))


@query("american_to_decimal", f"SELECT l_orderkey, l_partkey, l_linenumber, round(CASE WHEN {AMERICAN} < 0 THEN 1 + 100 / -{AMERICAN} ELSE 1 + {AMERICAN} / 100 END, 6) AS odds FROM lineitem")
def american_to_decimal(spark, sf_dir):
    return priced(spark, sf_dir).select("l_orderkey", "l_partkey", "l_linenumber", r6(X.american_to_decimal("odds")).alias("odds"))


@query("decimal_to_prob", with_views("quotes", f"SELECT GameID, Line, Part, round(1 / {D1}, 6) AS p1, round(1 / {D2}, 6) AS p2 FROM quotes"))
def decimal_to_prob(spark, sf_dir):
    return quotes(spark, sf_dir).select("GameID", "Line", "Part", r6(X.decimal_to_prob(D1)).alias("p1"), r6(X.decimal_to_prob(D2)).alias("p2"))


@query("prob_to_american", "SELECT l_orderkey, l_partkey, l_linenumber, CAST(round_even(CASE WHEN p >= 0.5 THEN p * -100 / (1 - p) ELSE (1 - p) * 100 / p END, 0) AS BIGINT) AS odds FROM (SELECT *, l_quantity / 60 + 0.05 AS p FROM lineitem) t")
def prob_to_american(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", X.prob_to_american(F.col("l_quantity") / 60 + 0.05).alias("odds"))


@query("no_vig_prob", with_views("quotes", f"SELECT GameID, Line, Part, round(greatest(0.001, least(0.999, coalesce((1 / {D1}) / (1 / {D1} + 1 / {D2}), 0.5))), 6) AS p, round(1 / {D1} + 1 / {D2} - 1, 6) + 0 AS hold FROM quotes"))
def no_vig_prob(spark, sf_dir):
    p, hold = X.no_vig_prob(X.decimal_to_prob(D1), X.decimal_to_prob(D2))
    return quotes(spark, sf_dir).select("GameID", "Line", "Part", r6(p).alias("p"), r6(hold).alias("hold"))


BIAS = f""", inv AS (SELECT *, 1 / {D1} AS a, 1 / {D2} AS b FROM quotes), se AS (SELECT *, sqrt(greatest(a - a * a, 0) / greatest(a, 1e-12)) AS sa, sqrt(greatest(b - b * b, 0) / greatest(b, 1e-12)) AS sb FROM inv),
steps AS (SELECT *, a - sa * (a + b - 1) / greatest(sa + sb, 1e-12) AS pa, b - sb * (a + b - 1) / greatest(sa + sb, 1e-12) AS pb FROM se),
bias AS (SELECT GameID, Season, T1, T2, League, Line, Part, LastSpread, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(0.000001, least(0.999999, CASE WHEN pa <= 0 OR pb <= 0 OR a + b <= 1 THEN a / greatest(a + b, 1e-12) ELSE pa END)) END AS p FROM steps)"""


@query("bias_corrected_prob", with_views("quotes", BIAS + " SELECT GameID, Line, Part, round(p, 6) AS p FROM bias"))
def bias_corrected_prob(spark, sf_dir):
    return X.with_bias_corrected_prob(quotes(spark, sf_dir), D1, D2).select("GameID", "Line", "Part", r6("p").alias("p"))


@query("clip_logit_shrink", "SELECT l_orderkey, l_partkey, l_linenumber, round(c, 6) AS clipped, round(ln(c / (1 - c)), 6) + 0 AS logit, round(greatest(0.000001, least(0.999999, 1 / (1 + exp(-(ln(c / (1 - c)) + 0.2))))), 6) AS shifted, round(0.5 + (c - 0.5) * (1 - 0.06), 6) AS shrunk FROM (SELECT *, greatest(0.000001, least(0.999999, l_discount * 10)) AS c FROM lineitem) t")
def clip_logit_shrink(spark, sf_dir):
    p = F.col("l_discount") * 10
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", r6(X.clip_prob(p)).alias("clipped"), r6(X.logit(p)).alias("logit"), r6(X.logit_shift(p, F.lit(0.2))).alias("shifted"), r6(X.shrink_half(p, 0.06)).alias("shrunk"))


@query("margin_to_prob", with_views("regular", "SELECT GameID, round(1 / (1 + exp(-(WScore - LScore) / CASE League WHEN 'M' THEN 10.0 ELSE 9.0 END)), 6) AS p FROM regular"))
def margin_to_prob(spark, sf_dir):
    scale = F.when(F.col("League") == "M", 10.0).otherwise(9.0)
    return view(spark, sf_dir, "regular").select("GameID", r6(X.margin_to_prob(F.col("WScore") - F.col("LScore"), scale)).alias("p"))


@query("temperature_soften", with_views("quotes", BIAS + " SELECT GameID, Line, Part, round(1 / (1 + exp(-(ln(p / (1 - p)) / 1.75))), 6) AS p175, round(p, 6) AS p1 FROM bias"))
def temperature_soften(spark, sf_dir):
    rows = X.with_bias_corrected_prob(quotes(spark, sf_dir), D1, D2)
    return rows.select("GameID", "Line", "Part", r6(X.temperature_soften("p", 1.75)).alias("p175"), r6(X.temperature_soften("p", 1.0)).alias("p1"))


@query("possessions", with_views("boxscore", "SELECT GameID, round(greatest(WFGA - WOR + WTO + WFTA * CAST(0.475 AS DOUBLE), 1), 6) AS WPoss, round(greatest(LFGA - LOR + LTO + LFTA * CAST(0.475 AS DOUBLE), 1), 6) AS LPoss FROM boxscore"))
def possessions(spark, sf_dir):
    return view(spark, sf_dir, "boxscore").select("GameID", *(r6(X.possessions(f"{s}FGA", f"{s}OR", f"{s}TO", f"{s}FTA")).alias(f"{s}Poss") for s in "WL"))


@query("normalize_name", r"SELECT p_partkey, trim(regexp_replace(replace(regexp_replace(lower(trim(p_name || ' & ' || p_brand || ' (' || p_size || ')')), '\(\d+\)', '', 'g'), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS name FROM part")
def normalize_name(spark, sf_dir):
    raw = F.concat("p_name", F.lit(" & "), "p_brand", F.lit(" ("), "p_size", F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", X.normalize_name(raw).alias("name"))


@query("parse_seed", with_views("seeds", "SELECT League, Season, TeamID, substr(Seed, 1, 1) AS Region, CAST(substr(Seed, 2) AS INT) AS SeedNum, '' AS PlayIn FROM seeds"))
def parse_seed(spark, sf_dir):
    region, num, play_in = X.parse_seed("Seed")
    return view(spark, sf_dir, "seeds").select("League", "Season", "TeamID", region.alias("Region"), num.alias("SeedNum"), play_in.alias("PlayIn"))


@query("split_pair_id", with_views("tourney", "SELECT GameID, CAST(Season AS BIGINT) AS Season, least(WTeamID, LTeamID) AS T1, greatest(WTeamID, LTeamID) AS T2 FROM tourney"))
def split_pair_id(spark, sf_dir):
    named = view(spark, sf_dir, "tourney").select("GameID", X.pair_id(F.col("Season"), F.col("WTeamID"), F.col("LTeamID")).alias("ID"))
    season, t1, t2 = X.split_pair_id("ID")
    return named.select("GameID", season.alias("Season"), t1.alias("T1"), t2.alias("T2"))


@query("count_distinct_tokens", "SELECT o_orderkey, CAST(len(list_distinct(list_filter(list_transform(string_split_regex(o_orderpriority || ' |' || o_orderstatus || ',' || o_orderstatus || '| ', '[|,]'), lambda x: trim(x)), lambda x: x <> ''))) AS INT) AS n FROM orders")
def count_distinct_tokens(spark, sf_dir):
    text = F.concat("o_orderpriority", F.lit(" |"), "o_orderstatus", F.lit(","), "o_orderstatus", F.lit("| "))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.count_distinct_tokens(text).alias("n"))


@query("source_host", "SELECT page_id, coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), ''), 'unknown') AS host FROM pages")
def source_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.source_host("url").alias("host"))


@query("round_down_time", "SELECT DISTINCT time_bucket(INTERVAL 15 MINUTES, ts) AS slot FROM events")
def round_down_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select(X.round_down_time("ts", 15).cast("timestamp_ntz").alias("slot")).distinct()


@query("extract_event_time", "SELECT event_id, coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('second', ts) END, CAST(strftime(ts, '%Y-%m-%d') AS TIMESTAMP)) AS at FROM events")
def extract_event_time(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    when = F.when(F.col("event_type") == "error", "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    url = F.concat(F.lit("https://host/odds/"), F.date_format("ts", "yyyy-MM-dd"), F.lit("/final"))
    return events.select("event_id", X.event_time([when], url).cast("timestamp_ntz").alias("at"))


STATS = ("l_quantity", "l_discount", "l_tax")


@query("row_stats", "SELECT l_orderkey, l_partkey, l_linenumber, n, round(s / n, 6) AS mean, round(sqrt(((a - s / n) ** 2 * (a IS NOT NULL)::INT + (b - s / n) ** 2 + (c - s / n) ** 2) / n), 6) AS sd, least(a, b, c) AS lo, greatest(a, b, c) AS hi FROM (SELECT *, 3 AS n, a + b + c AS s FROM (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity / 50 AS a, l_discount AS b, l_tax AS c FROM lineitem) u) t")
def row_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("l_quantity", F.col("l_quantity") / 50)
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", X.row_count(*STATS).alias("n"), r6(X.row_mean(*STATS)).alias("mean"), r6(X.row_std(*STATS)).alias("sd"), X.row_min(*STATS).alias("lo"), X.row_max(*STATS).alias("hi"))


@query("interp_piecewise", """WITH curve AS (SELECT CAST(l_linenumber AS DOUBLE) AS x, avg(l_quantity) AS y FROM lineitem GROUP BY 1),
pieces AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM curve), spots AS (SELECT p_partkey, greatest(1.0, least(7.0, p_size / 6.0)) AS v FROM part)
SELECT p_partkey, round(CASE WHEN x1 IS NULL THEN y0 ELSE y0 + (v - x0) * (y1 - y0) / (x1 - x0) END, 6) AS y FROM spots JOIN pieces ON v >= x0 AND (v < x1 OR x1 IS NULL)""")
def interp_piecewise(spark, sf_dir):
    curve = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("double").alias("x")).agg(F.avg("l_quantity").alias("y"))
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 6).alias("v"))
    return X.interpolate(parts, "v", curve, "x", "y", "y").select("p_partkey", r6("y").alias("y"))


@query("first_present_column", "SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice AS price FROM lineitem")
def first_present_column(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", X.first_present(rows, ["MarketPrice", "l_extendedprice", "l_quantity"]).alias("price"))


@query("coalesce_aliases", with_views("quotes", f"SELECT GameID, Line, Part, coalesce({D1}, {D2}, LastSpread) AS v FROM quotes"))
def coalesce_aliases(spark, sf_dir):
    rows = quotes(spark, sf_dir)
    return rows.select("GameID", "Line", "Part", X.coalesce_aliases(rows, [D1, "NoSuchOdds", D2, "LastSpread"]).alias("v"))


@query("coerce_numeric", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN value END AS value FROM events")
def coerce_numeric(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, "abc").when(F.col("event_id") % 3 == 1, F.col("value").cast("string")).otherwise("nan")
    return table(spark, sf_dir, "events").select("event_id", X.number(text).alias("value"))


@query("coerce_timestamp", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) END AS at FROM events")
def coerce_timestamp(spark, sf_dir):
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    return table(spark, sf_dir, "events").select("event_id", X.timestamp(text).cast("timestamp_ntz").alias("at"))


@query("feature_views", with_views("glog", "SELECT Season, TeamID, coalesce(avg(CASE WHEN IsHome = 1 THEN Win END), 0) AS HomeRate, CAST(0 AS DOUBLE) AS Absent, CAST(count(*) AS DOUBLE) AS Games FROM glog GROUP BY 1, 2"))
def feature_views(spark, sf_dir):
    made = view(spark, sf_dir, "glog").groupBy("Season", "TeamID").agg(F.avg(F.when(F.col("IsHome") == 1, F.col("Win"))).alias("HomeRate"), F.count("*").alias("Games"))
    return P.feature_view(made, ["Season", "TeamID"], ["HomeRate", "Absent", "Games"])


@query("drop_feature_groups", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate FROM lineitem")
def drop_feature_groups(spark, sf_dir):
    return P.drop_feature_groups(table(spark, sf_dir, "lineitem"), ["l_tax", "l_discount"], ["l_return", "l_linest"])


@query("keyword_predicate", "SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name || ' ' || p_type), 'ring|promo')")
def keyword_predicate(spark, sf_dir):
    return table(spark, sf_dir, "part").where(P.keyword_predicate(["p_name", "p_type"], ["Ring", "PROMO"])).select("p_partkey")


@query("evidence_filter", with_views("quotes", "SELECT GameID, Line, Part, Season FROM quotes WHERE lower(Source) LIKE '%urgent%' OR SnapshotTime >= TIMESTAMP '2000-06-01'"))
def evidence_filter(spark, sf_dir):
    evidence = P.keyword_predicate(["Source"], ["urgent"]) | (F.col("SnapshotTime") >= F.lit("2000-06-01").cast("timestamp"))
    return P.evidence_filter(quotes(spark, sf_dir), evidence, "Season", 2000).select("GameID", "Line", "Part", "Season")


CUTOFF = ", cutoffs AS (SELECT Season, make_date(Season, 1, 1) + CAST(min(DayNum) - 3 AS INT) AS CutoffDate FROM tourney GROUP BY 1)"


def cutoffs(spark, sf_dir):
    first = view(spark, sf_dir, "tourney").groupBy("Season").agg(F.min("DayNum").alias("d"))
    return first.select("Season", F.date_add(F.make_date("Season", F.lit(1), F.lit(1)), F.greatest(F.col("d") - 2, F.lit(1)) - 1).alias("CutoffDate"))


@query("snapshot_cutoffs", with_views("tourney", CUTOFF + " SELECT Season, CutoffDate FROM cutoffs"))
def snapshot_cutoffs(spark, sf_dir):
    return cutoffs(spark, sf_dir)


@query("verified_snapshot_filter", with_views("tourney quotes", CUTOFF + " SELECT GameID, Line, Part, q.Season FROM quotes q JOIN cutoffs c ON q.Season = c.Season WHERE Line % 2 = 1 AND SnapshotTime <= CutoffDate"))
def verified_snapshot_filter(spark, sf_dir):
    rows = quotes(spark, sf_dir).withColumn("Verified", F.col("Line") % 2)
    return P.verified_snapshots(rows, cutoffs(spark, sf_dir), "Verified", "SnapshotTime", "CutoffDate").select("GameID", "Line", "Part", "Season")


@query("market_time_policy", with_views("tourney quotes", CUTOFF + " SELECT GameID, Line, Part, q.Season, CASE WHEN SnapshotTime > CutoffDate + INTERVAL 7 DAYS THEN 1 ELSE 0 END AS LateQuote FROM quotes q LEFT JOIN cutoffs c ON q.Season = c.Season"))
def market_time_policy(spark, sf_dir):
    bounds = cutoffs(spark, sf_dir).withColumn("CutoffDate", F.col("CutoffDate").cast("timestamp"))
    return P.market_time_policy(quotes(spark, sf_dir), bounds, "flag", "SnapshotTime", "CutoffDate").select("GameID", "Line", "Part", "Season", "LateQuote")


@query("league_split", with_views("contest", "SELECT GameID, 'low' AS Part FROM contest WHERE WTeamID < 5 UNION ALL SELECT GameID, 'high' FROM contest WHERE WTeamID >= 7"))
def league_split(spark, sf_dir):
    games = view(spark, sf_dir, "contest")
    return games.where("WTeamID < 5 or WTeamID >= 7").select("GameID", F.when(F.col("WTeamID") < 5, "low").otherwise("high").alias("Part"))


@query("probability_validity_filter", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_discount * 10 > 0 AND l_discount * 10 < 1")
def probability_validity_filter(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_discount") * 10).where(P.valid_probability("p")).select("l_orderkey", "l_partkey", "l_linenumber")


@query("eval_season_window", with_views("tourney", "SELECT GameID, Season FROM tourney WHERE Season IN (SELECT DISTINCT Season FROM tourney ORDER BY Season DESC LIMIT 3)"))
def eval_season_window(spark, sf_dir):
    return P.last_periods(view(spark, sf_dir, "tourney"), 3).select("GameID", "Season")


@query("route_row_filter", with_views("quotes", f"SELECT GameID, Line, Part FROM quotes WHERE {D1} IS NOT NULL AND Season IN (SELECT Season FROM quotes WHERE {D1} IS NOT NULL GROUP BY 1 HAVING count(*) >= 100)"))
def route_row_filter(spark, sf_dir):
    having = quotes(spark, sf_dir).where(F.col(D1).isNotNull())
    enough = having.groupBy("Season").count().where("count >= 100")
    return having.join(enough, "Season", "left_semi").select("GameID", "Line", "Part")


@query("threshold_rule_mask", with_views("quotes", f"SELECT GameID, Line, Part, coalesce({D1} >= 1.8 AND LastSpread <= 0, false) AS hit FROM quotes"))
def threshold_rule_mask(spark, sf_dir):
    return quotes(spark, sf_dir).select("GameID", "Line", "Part", P.rule_mask([D1, "LastSpread"], [">=", "<="], [1.8, 0.0]).alias("hit"))


SIDE = "CASE WHEN WTeamID % 2 = 0 THEN 1 - (50 + WTeamID % 40) / 100.0 ELSE (50 + WTeamID % 40) / 100.0 END"


@query("parse_line_text", with_views("regular", f"SELECT GameID, CASE WHEN GameID % 11 = 0 THEN NULL ELSE round({SIDE}, 6) END AS Prob, CASE WHEN GameID % 11 = 0 THEN NULL ELSE CASE WHEN WTeamID % 2 = 0 THEN 1 ELSE -1 END * CASE WHEN GameID % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE (WScore - LScore) / 2 END END + 0 AS Spread, CASE WHEN GameID % 11 = 0 THEN NULL ELSE CAST(CAST(WScore AS INT) + CAST(LScore AS INT) AS DOUBLE) END AS Total FROM regular"))
def parse_line_text(spark, sf_dir):
    """Lines with points or a pick, of either sign, with loose spaces; the winner is the first or second team, or neither."""
    winner = F.format_string("St. Team %d", "WTeamID")
    points = F.when(F.col("GameID") % 5 == 0, F.when(F.col("GameID") % 2 == 0, "PK").otherwise("pick")).otherwise(F.format_string("%s%.1f", F.when(F.col("GameID") % 3 == 0, "+").otherwise("-"), (F.col("WScore") - F.col("LScore")) / 2))
    text = F.format_string("  %s  %s , %d -%d (%d%%)", winner, points, F.col("WScore").cast("int"), F.col("LScore").cast("int"), (F.col("WTeamID") % 40 + 50).cast("int"))
    other = F.when(F.col("GameID") % 11 == 0, "Nobody").otherwise(winner)
    odd = F.col("WTeamID") % 2 == 1
    prob, spread, total = LY.forecast_line(text, F.when(odd, other).otherwise("Else"), F.when(odd, F.lit("Else")).otherwise(other))
    return view(spark, sf_dir, "regular").select("GameID", r6(prob).alias("Prob"), (spread + 0.0).alias("Spread"), total.alias("Total"))


@query("snapshot_from_filename", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('hour', ts) WHEN 1 THEN date_trunc('minute', ts) WHEN 2 THEN date_trunc('day', ts) END AS at FROM events")
def snapshot_from_filename(spark, sf_dir):
    """Digits with an hour, month and day with or without a time, and a name without any."""
    k, as_ = F.col("event_id") % 4, lambda f: F.date_format("ts", f)
    name = F.when(k == 0, F.concat(F.lit("ratings_"), as_("yyyyMMdd_HH"), F.lit(".csv"))).when(k == 1, F.concat(F.lit("Model_"), as_("MMMM_d_hmm"), F.lower(as_("a")), F.lit(".xlsx"))).when(k == 2, F.concat(as_("MMMM_d"), F.lit("_final.xlsx"))).otherwise("notes_May.csv")
    return table(spark, sf_dir, "events").select("event_id", LY.file_time(name, F.year("ts")).cast("timestamp_ntz").alias("at"))
