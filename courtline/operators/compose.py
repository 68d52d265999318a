"""Compositions: assembled team features, quote histories, vendor forms, route blends."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import market as M
from . import relational as R
from .features import impute_seeds

KEY = ["Season", "TeamID"]


#: Rounds whose path features are also averaged.
STAGES = {"Early": (1, 2), "Middle": (3, 4), "Late": (5, 6)}


def path_columns(paths: DataFrame, by: list[str]) -> DataFrame:
    """Path difficulty and mean seed by round (by..., TeamID, Round, PathDifficulty, PathSeedMean) as columns R1 to R6 and stages."""
    names = ("PathDifficulty", "PathSeedMean")
    at = lambda c, r: F.max(F.when(F.col("Round") == r, F.col(c)))
    wide = paths.groupBy(*by, "TeamID").agg(*(at(c, r).alias(f"{c}R{r}") for c in names for r in range(1, 7)))
    return wide.withColumns({f"{c}{stage}": X.row_mean(*(f"{c}R{r}" for r in rounds)) for c in names for stage, rounds in STAGES.items()})


def team_features(base: DataFrame, parts: list[DataFrame], seeds: DataFrame | None = None, priors: DataFrame | None = None, paths: DataFrame | None = None, strength: str = "Rating") -> DataFrame:
    """All feature tables of a team and season in one row, with seeds, recent-minus-season differences and declared values for what is missing.

    base and parts have one row for Season and TeamID; of a column in several the first counts. seeds (Season, TeamID, SeedNum): teams without one get it from
    the rank of `strength`, and SeedImputed. priors (Season, SeedBucket, ...) meet by the seed, cut to 1 to 17; paths are path_columns.
    Differences come where both columns are there. Counts that are missing are 0, tenures 1, rates of nothing 0.
    """
    rows, have = base, list(base.columns)
    for part in parts:
        new = [c for c in part.columns if c not in have]
        rows, have = rows.join(part.select(*KEY, *new), KEY, "left"), have + new
    if seeds is not None:
        rows = rows.join(seeds.select(*KEY, "SeedNum"), KEY, "left").withColumn("SeedImputed", F.col("SeedNum").isNull().cast("int"))
        rows = impute_seeds(rows, strength).withColumn("SeedBucket", F.greatest(F.lit(1), F.least(F.lit(17), F.round("SeedNum"))).cast("int"))
    if priors is not None:
        rows = rows.join(priors, [c for c in ("League", "Season", "SeedBucket") if c in priors.columns and c in rows.columns], "left")
    if paths is not None:
        rows = rows.join(paths, [c for c in ("League", *KEY) if c in paths.columns and c in rows.columns], "left")
    late = {"MomentumWinRate": ("Last10WinRate", "WinRate"), "MomentumMargin": ("Last10Margin", "AvgMargin"), "Momentum30WinRate": ("Last30WinRate", "WinRate"), "Momentum30Margin": ("Last30Margin", "AvgMargin")}
    for new, old in (("Momentum", "RecentEff"), ("Momentum30", "Recent30Eff")):
        late |= {f"{new}{c}": (f"{old}{c}", c) for c in ("NetRtg", "NetRtg_z", "AdjNetRtg", "AdjNetRtg_z")}
    rows = rows.withColumns({n: F.col(a) - F.col(b) for n, (a, b) in late.items() if {a, b} <= set(rows.columns)})
    zero = [c for c in rows.columns if c in ("ConfTourneyWins", "CloseGameCount", "CoachChange", "CoachMidseasonChange", "SeedPriorExpectedWins", "SeedPriorWinPct", "CloseGameWinRate", "RankMomentum", "OWP", "OOWP", "RPIStyle", "RPIStyleSOS", "PageRank", "PageRank_z", "PageRankSOS") or re.match(r"(Last30)?(Top\d+(Games|Wins|WinRate)|Close(Count|WinRate))$|Path(Difficulty|SeedMean)", c)]
    return rows.fillna(0, zero).fillna(1, [c for c in ("CoachTenure", "CoachCount") if c in rows.columns])


def odds_prepare(quotes: DataFrame, odds: tuple[str, str], time: str) -> DataFrame:
    """Pair means of no-vig probability, hold and spread over books, with the books in order and the latest time."""
    p, hold = X.no_vig_prob(X.decimal_to_prob(odds[0]), X.decimal_to_prob(odds[1]))
    rows = quotes.withColumns({"NoVigProb": F.when(F.col(odds[0]).isNotNull() & F.col(odds[1]).isNotNull(), p), "Hold": hold}).where("NoVigProb is not null or LastSpread is not null")
    return rows.groupBy(*M.PAIR).agg(F.avg("NoVigProb").alias("NoVigProb"), F.avg("Hold").alias("Hold"), F.avg("LastSpread").alias("LastSpread"), R.sorted_concat("Book").alias("Books"), F.countDistinct("Book").alias("BookCount"), F.max(time).alias("SnapshotTime"))


def market_history(quotes: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Consensus of valid quotes, and the share of the real pairs that have one by season."""
    valid = quotes.where("MarketProb > 0 and MarketProb < 1")
    consensus = valid.groupBy(*M.PAIR).agg(F.avg("MarketProb").alias("MarketProb"), F.count("*").alias("Rows"))
    real = pairs.select(*M.PAIR).distinct()
    coverage = real.join(consensus.select(*M.PAIR, F.lit(1).alias("_has")), M.PAIR, "left").groupBy("Season").agg(F.count("*").alias("Pairs"), F.count("_has").alias("Covered"), F.avg(F.coalesce("_has", F.lit(0)).cast("double")).alias("Coverage"))
    return consensus, coverage


def training_quotes(quotes: DataFrame, games: DataFrame, time: str, start: str) -> DataFrame:
    """Quotes of pairs that really met, marked verified if published no later than the start."""
    return quotes.join(games, M.PAIR).withColumn("Verified", F.coalesce((F.col(time) <= F.col(start)).cast("int"), F.lit(0))).drop(start)


# Names of both sides' prices in prediction market files, and what they are divided by.
CONTRACTS = (
    (("Team1Prob", "T1Prob", "Prob1", "YesProb"), ("Team2Prob", "T2Prob", "Prob2", "NoProb"), 1.0),
    (("Team1Percent", "T1Percent", "Prob1Percent", "YesPercent"), ("Team2Percent", "T2Percent", "Prob2Percent", "NoPercent"), 100.0),
    (("Team1Cents", "T1Cents", "Prob1Cents", "YesCents", "YesPriceCents"), ("Team2Cents", "T2Cents", "Prob2Cents", "NoCents", "NoPriceCents"), 100.0),
)


def contract_probs(rows: DataFrame) -> tuple[Column, Column]:
    """Both sides' probabilities from the first kind of price that the table has: probabilities, percents or cents.

    A price that is not strictly between 0 and 1 is none; a missing side is the other's complement.
    """
    for left, right, scale in CONTRACTS:
        if any(c in rows.columns for c in (*left, *right)):
            side = lambda names: X.number(X.first_present(rows, names)) / scale  # noqa: B023, E731
            a, b = (F.when((p > 0) & (p < 1), p) for p in (side(left), side(right)))
            inside = lambda p: F.when(p.isNotNull(), F.greatest(F.lit(0.001), F.least(F.lit(0.999), p)))
            first, second = F.coalesce(a, F.lit(1.0) - b), F.coalesce(b, F.lit(1.0) - a)
            return inside(first), inside(second)
    raise ValueError("no column of probabilities, percents or cents for either side")


def prediction_market_convert(rows: DataFrame, *order: Column) -> DataFrame:
    """Contracts of prediction markets as quotes: one row for each pair, book and time, the last by `order`.

    rows: Season, T1, T2, a price of either side, and perhaps LastSpread, Book, BookCount, SnapshotTime, Source. Pairs are put in order of their ids,
    prices and spread with them; rows without ids are dropped.
    """
    p1, p2 = contract_probs(rows)
    text = lambda c, other: F.coalesce(F.trim(X.first_present(rows, [c], "string").cast("string")), F.lit(other))
    told = X.first_present(rows, ["SnapshotTime"], "string")
    time = told if dict(rows.dtypes).get("SnapshotTime") == "timestamp" else X.timestamp(told)  # only text is parsed
    priced = rows.withColumns({"_p1": p1, "_p2": p2})  # a projection of their own, as prices name them many times
    made = priced.withColumns({
        "MarketProb": F.col("_p1"), "Team1Moneyline": X.prob_to_american("_p1"), "Team2Moneyline": X.prob_to_american("_p2"), "LastSpread": X.number(X.first_present(rows, ["LastSpread"])), "Book": text("Book", "prediction_market"),
        "BookCount": F.coalesce(X.number(X.first_present(rows, ["BookCount"])), F.lit(1.0)), "SnapshotTime": time, "Source": text("Source", "prediction_market_proxy"),
    })
    known = M.canonicalize_pairs(R.drop_missing_keys(made.drop("_p1", "_p2"), list(M.PAIR)), complement=("MarketProb",), negate=("LastSpread",), swap=(("Team1Moneyline", "Team2Moneyline"),))
    return R.keep_last(known, [*M.PAIR, "Book", "SnapshotTime"], *order)


def host_structure(rows: DataFrame) -> DataFrame:
    """Early rounds, and whether a side probably plays at home: early, seeded 4 or better, and better seeded."""
    early = F.col("Round").isin(1, 2)
    hosts = lambda a, b: (early & (F.col(a) <= 4) & (F.col(a) < F.col(b)))
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return rows.withColumns({"IsRound1": flag(F.col("Round") == 1), "IsRound2": flag(F.col("Round") == 2), "IsRound1Or2": flag(early), "T1HostLikely": flag(hosts("T1_SeedNum", "T2_SeedNum")), "T2HostLikely": flag(hosts("T2_SeedNum", "T1_SeedNum"))}).withColumn("D_HostLikely", F.col("T1HostLikely") - F.col("T2HostLikely"))


def host_pod_match(seed_a: Column, seed_b: Column) -> Column:
    """round1 or round2 if seed_a (1 to 4) can host seed_b of its region then, by the fixed pods of four."""
    pods = {1: ((16,), (8, 9)), 2: ((15,), (7, 10)), 3: ((14,), (6, 11)), 4: ((13,), (5, 12))}
    num = lambda s: F.substring(s, 2, 2).cast("int")
    out = F.lit(None).cast("string")
    for seed, (first, second) in pods.items():
        out = F.when((num(seed_a) == seed) & num(seed_b).isin(*first), "round1").when((num(seed_a) == seed) & num(seed_b).isin(*second), "round2").otherwise(out)
    return F.when(F.substring(seed_a, 1, 1) == F.substring(seed_b, 1, 1), out)


def average(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, map(F.col, columns)) / len(columns)


def spread(columns: Sequence[str]) -> Column:
    """Sample deviation of columns without nulls; 0 for one column."""
    if len(columns) < 2:
        return F.lit(0.0)
    return F.sqrt(reduce(lambda a, b: a + b, (F.pow(F.col(c) - average(columns), 2) for c in columns)) / (len(columns) - 1))


def fill_routes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A missing route takes the row's mean over the others, 0.5 if there is none; <column>_avail tells which were there."""
    mean = F.coalesce(X.row_mean(*columns), F.lit(0.5))
    return df.withColumns({f"{c}_avail": F.col(c).isNotNull().cast("int") for c in columns} | {c: F.coalesce(F.col(c), mean) for c in columns})


def route_group_features(filled: DataFrame, groups: dict[str, list[str]]) -> tuple[DataFrame, list[str]]:
    """Mean, sample deviation and number of available routes of each group of filled routes; 0.5, 0 and 0 for an empty group."""
    add: dict[str, Column] = {}
    for g, cols in groups.items():
        add |= {f"{g}_mean": average(cols) if cols else F.lit(0.5), f"{g}_std": spread(cols), f"{g}_count": reduce(lambda a, b: a + b, (F.col(f"{c}_avail") for c in cols), F.lit(0))}
    return filled.withColumns(add), list(add)


def simple_candidates(df: DataFrame, blends: dict[str, dict[str, float]], label: str = "Label") -> DataFrame:
    """Brier score of fixed blends, the best marked; a missing column takes the row's mean."""
    every = sorted({c for b in blends.values() for c in b})
    blend = lambda b: reduce(lambda x, y: x + y, (F.coalesce(F.col(c), X.row_mean(*every), F.lit(0.5)) * w for c, w in b.items()))
    long = df.select(label, F.inline(F.array(*(F.struct(F.lit(k).alias("Candidate"), blend(b).alias("p")) for k, b in blends.items()))))
    scores = long.groupBy("Candidate").agg(F.avg(F.pow(F.col("p") - F.col(label), 2)).alias("Brier"))
    best = scores.agg(F.min_by("Candidate", F.struct(F.round("Brier", 9), "Candidate")).alias("_best"))
    return scores.crossJoin(F.broadcast(best)).withColumn("Best", (F.col("Candidate") == F.col("_best")).cast("int")).drop("_best")


def loss_weights(df: DataFrame, candidates: list[str], losses: list[str], top: int = 3) -> DataFrame:
    """Each row's blend of the candidates with the least predicted losses, weighted by (loss + 1e-4)^-1.5."""
    pairs = F.array(*(F.struct(F.col(lo).alias("l"), F.lit(i).alias("i"), F.col(c).alias("p")) for i, (c, lo) in enumerate(zip(candidates, losses, strict=True))))
    best = F.slice(F.array_sort(F.filter(pairs, lambda x: x["p"].isNotNull() & x["l"].isNotNull())), 1, top)
    weight = lambda x: F.pow(x["l"] + 1e-4, -1.5)
    total = F.aggregate("_b", F.lit(0.0), lambda a, x: a + weight(x))
    mixed = F.aggregate("_b", F.lit(0.0), lambda a, x: a + weight(x) * x["p"])
    return df.withColumn("_b", best).withColumn("Selected", F.try_divide(mixed, total)).drop("_b")


def schedule_resume(log: DataFrame, close: float = 5.0, top: int = 5) -> DataFrame:
    """Games and wins against the first two quarters of opponents, shares of close and neutral games, best wins and worst losses.

    log: Season, TeamID, GameID, Win, Margin, IsNeutral, OppPct (the opponent's rank in its season, 0 best). Quadrants are quarters of OppPct; a game
    against an unranked opponent is in none. The `top` wins of highest quality (1 - OppPct) and the losses of lowest count as best and worst.
    """
    quadrant = F.when(F.col("OppPct") <= 0.25, 1).when(F.col("OppPct") <= 0.5, 2).when(F.col("OppPct") <= 0.75, 3).when(F.col("OppPct").isNotNull(), 4)
    w = Window.partitionBy(*KEY, "Win")
    won, quality = F.col("Win") == 1, F.lit(1.0) - F.col("OppPct")
    rows = log.withColumns({"_q": quadrant, "_good": F.row_number().over(w.orderBy(F.col("OppPct").asc_nulls_last(), "GameID")), "_bad": F.row_number().over(w.orderBy(F.col("OppPct").desc_nulls_last(), "GameID"))})
    n = lambda c: F.count(F.when(c, 1))
    near = F.abs("Margin") <= close
    best, worst = won & (F.col("_good") <= top), ~won & (F.col("_bad") <= top)
    q = F.col("_q")
    return rows.groupBy(*KEY).agg(
        n(q == 1).alias("Q1Games"), n((q == 1) & won).alias("Q1Wins"), n(q == 2).alias("Q2Games"), n((q == 2) & won).alias("Q2Wins"),
        F.avg(near.cast("double")).alias("CloseGameRate"), F.avg(F.when(near, F.col("Win"))).alias("CloseGameWinRate"), F.avg(F.col("IsNeutral").cast("double")).alias("NeutralGameRate"),
        F.avg(F.when(best, quality)).alias("BestWinQualityMean"), F.max(F.when(best, quality)).alias("BestWinQualityMax"), n(best & (q == 1)).alias("BestWinQ1Count"),
        F.avg(F.when(worst, q)).alias("WorstLossQuadrantMean"), n(worst & (q >= 3)).alias("BadLossCountQ3Q4"),
    )
