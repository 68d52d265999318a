"""Queries of season-forward choices, specialists, the resolved bracket and review inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import fusion as U
from ..operators import market as M
from ..operators import ratings as RT
from ..sources.files import checkpoint
from .inputs import view, with_views
from .q_features import rounded
from .q_live import live
from .q_models import FEATURES, matchups
from .q_rules import clip
from .registry import query

COLUMNS = ["RawProb", "MarketProb", "ModelMatchupProb"]


def _scores(options: dict[str, str]) -> str:
    """SQL of the seasonal Brier score of every option and shrinkage."""
    rows = " UNION ALL ".join(f"SELECT Season, Label, '{name}' AS Strategy, CAST({s} AS DOUBLE) AS Shrinkage, (({p}) - 0.5) * (1 - CAST({s} AS DOUBLE)) + 0.5 AS p FROM live" for name, p in options.items() for s in U.SHRINKAGES)
    return f", opts AS ({rows}), b AS (SELECT Strategy, Shrinkage, Season, avg((p - Label) ** 2) AS b FROM opts GROUP BY 1, 2, 3)"


def _mean(*cols: str) -> str:
    return f"({' + '.join(f'coalesce({c}, 0)' for c in cols)}) / nullif({' + '.join(f'CASE WHEN {c} IS NULL THEN 0 ELSE 1 END' for c in cols)}, 0)"


SCORES = _scores({c: c for c in COLUMNS})
CHOSEN = "CASE Strategy " + " ".join(f"WHEN '{c}' THEN coalesce({c}, {_mean(*(o for o in COLUMNS if o != c))}, 0.5)" for c in COLUMNS) + " END"
SHRUNK = clip("(c - 0.5) * (1 - Shrinkage) + 0.5")


@query(
    "strategy_oof",
    with_views(
        "live",
        SCORES
        + f", best AS (SELECT Season, Strategy, Shrinkage FROM (SELECT *, avg(b) OVER (PARTITION BY Strategy, Shrinkage ORDER BY Season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM b) t WHERE pb IS NOT NULL QUALIFY row_number() OVER (PARTITION BY Season ORDER BY round(pb, 9), Strategy, Shrinkage) = 1), x AS (SELECT GameID, Strategy, Shrinkage, {clip(CHOSEN)} AS c FROM live JOIN best USING (Season)), y AS (SELECT *, {SHRUNK} AS f FROM x) SELECT GameID, Strategy, Shrinkage, round(c, 6) AS ChosenProb, round(f, 6) AS FinalProb, round(greatest(f, 1 - f), 6) AS FavoriteProb FROM y",
    ),
)
def strategy_oof(spark, sf_dir):
    return rounded(U.strategy_oof(live(spark, sf_dir), COLUMNS).select("GameID", "Strategy", "Shrinkage", "ChosenProb", "FinalProb", "FavoriteProb"), "Shrinkage")


@query("strict_holdout", with_views("live", SCORES + ", t AS (SELECT Strategy, Shrinkage, avg(b) FILTER (WHERE Season <= (SELECT max(Season) - 2 FROM live)) AS t, avg(b) FILTER (WHERE Season > (SELECT max(Season) - 2 FROM live)) AS h FROM b GROUP BY 1, 2) SELECT Strategy, Shrinkage, round(t, 6) AS TuneBrier, round(h, 6) AS HoldoutBrier, round(h - t, 6) AS OptimismGap FROM t WHERE t IS NOT NULL ORDER BY round(t, 9), Strategy, Shrinkage LIMIT 1"))
def strict_holdout(spark, sf_dir):
    return rounded(U.strict_holdout(live(spark, sf_dir), COLUMNS), "Shrinkage")


SETS = {"raw": ["RawProb"], "raw_market": ["RawProb", "MarketProb"], "all": COLUMNS}


@query("model_set_search", with_views("live", _scores({n: _mean(*c) for n, c in SETS.items()}) + ", s AS (SELECT Strategy, Shrinkage, avg(b) AS Brier FROM b GROUP BY 1, 2) SELECT Strategy AS ModelSet, Shrinkage, round(Brier, 6) AS Brier, CASE WHEN row_number() OVER (ORDER BY round(Brier, 9), Strategy, Shrinkage) = 1 THEN 1 ELSE 0 END AS Best FROM s"))
def model_set_search(spark, sf_dir):
    return rounded(U.model_set_search(live(spark, sf_dir), SETS), "Shrinkage")


WEIGHTS = [i / 10 for i in range(11)]
TRIED = " UNION ALL ".join(f"SELECT Season, Label, CAST({w} AS DOUBLE) AS Weight, CASE WHEN a THEN {clip(f'(1 - {w}) * RawProb + {w} * ModelMatchupProb')} ELSE RawProb END AS p, a FROM act" for w in WEIGHTS)


@query("residual_overlay_search", with_views("live", f", act AS (SELECT *, MarketProb IS NOT NULL AND ModelMatchupProb IS NOT NULL AS a FROM live WHERE Season > (SELECT max(Season) - 5 FROM live)), tried AS ({TRIED}), s AS (SELECT Weight, Season, avg((p - Label) ** 2) AS b, sum(CASE WHEN a THEN 1 ELSE 0 END) AS n FROM tried GROUP BY 1, 2), w AS (SELECT Weight, CASE WHEN sum(n) >= 60 THEN avg(b) END AS Brier, CAST(sum(n) AS BIGINT) AS ActiveRows FROM s GROUP BY 1) SELECT Weight, round(Brier, 6) AS Brier, ActiveRows, CASE WHEN Brier IS NOT NULL AND row_number() OVER (ORDER BY round(Brier, 9) NULLS LAST, Weight) = 1 THEN 1 ELSE 0 END AS Best FROM w"))
def residual_overlay_search(spark, sf_dir):
    return rounded(U.residual_overlay_search(live(spark, sf_dir), "RawProb", "ModelMatchupProb", WEIGHTS), "Weight")


def _priced(spark, sf_dir):
    return matchups(spark, sf_dir).join(view(spark, sf_dir, "mk").select("Season", "T1", "T2", "MarketProb"), ["Season", "T1", "T2"], "left")


@query("market_residual_model")
def market_residual_model(spark, sf_dir):
    out = U.market_residual_model(_priced(spark, sf_dir), FEATURES, since=1992)
    return rounded(out.select("GameID", "Season", "MarketProb", "Prob_residual"))


@query("gated_expert_blend")
def gated_expert_blend(spark, sf_dir):
    rows = matchups(spark, sf_dir).withColumn("BaseProb", X.clip_prob(X.margin_to_prob("D_AvgMargin")))
    out = U.gated_expert_blend(rows, "BaseProb", FEATURES, F.abs(F.col("BaseProb") - 0.5) <= 0.3)
    return rounded(out.select("GameID", "Season", "Gated", "BaseProb", "Prob_gated"))


@query("live_model_merge", with_views("mk scored", ", v AS (SELECT Season, T1, T2, CASE WHEN GameID % 3 = 0 THEN RawProb ELSE MarketProb END AS p, LastSpread FROM scored QUALIFY row_number() OVER (PARTITION BY Season, T1, T2 ORDER BY GameID DESC) = 1) SELECT mk.Season, mk.T1, mk.T2, round(MarketProb, 6) AS ModelMatchupProb, round(p, 6) AS SilverMatchupProb, round(v.LastSpread, 6) AS SilverMatchupSpread FROM mk LEFT JOIN v ON v.Season = mk.Season AND v.T1 = mk.T1 AND v.T2 = mk.T2"))
def live_model_merge(spark, sf_dir):
    consensus = view(spark, sf_dir, "mk").select("Season", "T1", "T2", F.col("MarketProb").alias("ModelMatchupProb"))
    third = F.col("GameID") % 3 == 0
    vendor = view(spark, sf_dir, "scored").select("Season", "T1", "T2", "GameID", F.when(third, F.col("RawProb")).alias("WinProb"), F.when(~third, F.col("MarketProb")).alias("Prob"), F.col("LastSpread").alias("Line"))
    return rounded(U.live_model_merge(consensus, vendor, {"SilverMatchupProb": ["WinProb", "Prob"], "SilverMatchupSpread": ["Spread", "Line"]}, F.desc("GameID")))


Q = "(1 / Team1DecimalOdds) / (1 / Team1DecimalOdds + 1 / Team2DecimalOdds)"


@query("review_inputs", with_views("lab quotes", f", q AS (SELECT Season, least(T1, T2) AS T1, greatest(T1, T2) AS T2, CASE WHEN T1 > T2 THEN 1 - {Q} ELSE {Q} END AS p, CASE WHEN League = 'M' THEN CASE WHEN T1 > T2 THEN -LastSpread ELSE LastSpread END END AS s, SnapshotTime, Line, GameID, Part FROM quotes), l AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY Season, T1, T2 ORDER BY SnapshotTime DESC, Line DESC, GameID DESC, Part DESC, p DESC NULLS LAST) = 1) SELECT lab.GameID, lab.T1, lab.T2, round(p, 6) AS MarketProb, round(s, 6) AS LastSpread FROM lab LEFT JOIN l ON l.Season = lab.Season AND l.T1 = lab.T1 AND l.T2 = lab.T2"))
def review_inputs(spark, sf_dir):
    a, b = (X.decimal_to_prob(c) for c in ("Team1DecimalOdds", "Team2DecimalOdds"))
    rows = view(spark, sf_dir, "quotes").select("League", *M.PAIR, F.try_divide(a, a + b).alias("MarketProb"), "LastSpread", "SnapshotTime", "Line", F.col("GameID").alias("QuoteGame"), "Part")
    rows = M.canonicalize_pairs(rows, complement=("MarketProb",), negate=("LastSpread",))
    frames = [rows.where("League = 'M'").drop("League"), rows.where("League = 'W'").drop("League", "LastSpread")]
    order = [F.desc("SnapshotTime"), F.desc("Line"), F.desc("QuoteGame"), F.desc("Part"), F.desc_nulls_last("MarketProb")]
    out = U.review_inputs(view(spark, sf_dir, "lab"), frames, *order)
    return rounded(out.select("GameID", "T1", "T2", "MarketProb", "LastSpread"))


SNAP = ", cut AS (SELECT Season, CAST(make_date(Season, 1, 1) + CAST(max(DayNum) AS INT) AS DATE) AS SnapshotDate FROM regular WHERE Season % 4 <> 3 GROUP BY 1), snap AS (SELECT o.Season, TeamID, OrdinalRank, SnapshotDate, 1 AS VerifiedPreTourney FROM (SELECT * FROM ordinals QUALIFY row_number() OVER (PARTITION BY Season, TeamID ORDER BY RankingDayNum DESC, SystemName DESC) = 1) o JOIN cut ON cut.Season = o.Season)"


def snapshot(spark, sf_dir):
    regular = view(spark, sf_dir, "regular").where("Season % 4 <> 3").groupBy("Season").agg(F.max("DayNum").alias("d"))
    cutoffs = regular.select("Season", F.date_add(F.make_date("Season", F.lit(1), F.lit(1)), F.col("d")).alias("SnapshotDate"))
    return U.historical_ratings_snapshot(view(spark, sf_dir, "ordinals"), cutoffs, ["OrdinalRank", "NetRank"], F.desc("RankingDayNum"), F.desc("SystemName"))


@query("historical_ratings_snapshot", with_views("ordinals regular", SNAP + " SELECT CAST(Season AS BIGINT) AS Season, TeamID, OrdinalRank, SnapshotDate, VerifiedPreTourney FROM snap"))
def historical_ratings_snapshot(spark, sf_dir):
    return snapshot(spark, sf_dir).withColumn("Season", F.col("Season").cast("bigint"))


@query("historical_ratings_coverage", with_views("ordinals regular seeds", SNAP + " SELECT CAST(f.Season AS BIGINT) AS Season, count(s.TeamID) AS Covered, count(*) AS Teams, round(avg(CASE WHEN s.TeamID IS NULL THEN 0.0 ELSE 1.0 END), 6) AS Coverage FROM seeds f LEFT JOIN snap s ON s.Season = f.Season AND s.TeamID = f.TeamID GROUP BY 1"))
def historical_ratings_coverage(spark, sf_dir):
    out = U.snapshot_coverage(snapshot(spark, sf_dir), view(spark, sf_dir, "seeds").select("Season", "TeamID"))
    return rounded(out.withColumn("Season", F.col("Season").cast("bigint")))


def _bracket_sql(rounds: int = 6) -> str:
    """One view for each round: both sides' teams and ratings, the better one (the stronger seed on ties) goes on."""
    parts = ["w0 AS (SELECT s.League, s.Season, s.Seed AS Node, s.Seed, s.TeamID, Rating FROM seeds s LEFT JOIN rating r ON r.Season = s.Season AND r.TeamID = s.TeamID)"]
    for r in range(1, rounds + 1):
        won = "a.TeamID IS NOT NULL AND (b.TeamID IS NULL OR coalesce(a.Rating >= b.Rating, true))"
        sides = " LEFT JOIN ".join(["(SELECT DISTINCT League, Season FROM seeds) k CROSS JOIN slots", f"w{r - 1} a ON a.League = k.League AND a.Season = k.Season AND a.Node = StrongSeed", f"w{r - 1} b ON b.League = k.League AND b.Season = k.Season AND b.Node = WeakSeed"])
        pick = ", ".join(f"CASE WHEN {won} THEN a.{c} ELSE b.{c} END AS {c}" for c in ("Seed", "TeamID", "Rating"))
        parts.append(f"w{r} AS (SELECT k.League, k.Season, Slot AS Node, {pick} FROM {sides} WHERE Slot LIKE 'R{r}%' AND coalesce(a.TeamID, b.TeamID) IS NOT NULL)")
    return ", " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT League, Season, Node AS Slot, Seed, TeamID, {r} AS Round FROM w{r}" for r in range(1, rounds + 1))


@query("bracket_resolve", with_views("slots seeds rating", _bracket_sql()))
def bracket_resolve(spark, sf_dir):
    by = ["League", "Season"]
    seeds = checkpoint(view(spark, sf_dir, "seeds").join(view(spark, sf_dir, "rating"), ["Season", "TeamID"], "left"))  # a field holds 64 teams at most
    rated = seeds.where("Rating is not null").select(*by, "TeamID", "Rating")
    both = rated.join(rated.select(*by, F.col("TeamID").alias("OppID"), F.col("Rating").alias("_o")), by).where("TeamID <> OppID")
    win = both.select(*by, "TeamID", "OppID", ((F.col("Rating") - F.col("_o")) / 2 + 0.5).alias("p"))
    return RT.bracket_resolve(view(spark, sf_dir, "slots"), seeds, win, by)
