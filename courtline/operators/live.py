"""Scoring frames and the rules and blends that are applied to live predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import matchup as U
from . import relational as R
from .compose import host_pod_match

PAIR = ["Season", "T1", "T2"]


def prediction_frame(pairs: DataFrame, features: DataFrame, market: DataFrame | None = None, signals: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """The table to be scored: pairs by ID (Season_T1_T2) with both sides' features, differences, market, signals and manual rules."""
    ids = F.split("ID", "_")
    frame = pairs.select("ID", *(ids[i].cast("bigint").alias(c) for i, c in enumerate(PAIR)))
    names = [c for c, t in features.dtypes if c not in ("Season", "TeamID") and t in ("double", "int", "bigint", "float")]
    frame = U.matchup_diffs(R.join_twice_prefixed(frame, features), names)
    if market is not None:
        frame = U.market_merge(frame, market)
    if signals is not None:
        frame = U.signal_merge(frame, signals)
    return frame.join(rules, PAIR, "left") if rules is not None else frame


def field_frame(field: DataFrame, features: DataFrame, market: DataFrame, signals: DataFrame) -> DataFrame:
    """prediction_frame of all pairs of a field (Season, TeamID): tables meet the teams, so that no pair is shuffled.

    market: Season, T1, T2 and MarketProb, one row a pair. features, signals: one row a season and team.
    """
    key = ["Season", "TeamID"]
    names = [c for c, t in features.dtypes if c not in key and t in ("double", "int", "bigint", "float")]
    shown = [c for c in signals.columns if c not in key]
    rows = R.pair_rows(field.select(*key).distinct().join(features, key, "left").join(signals, key, "left"), known=market.select(*PAIR, "MarketProb"))
    frame = U.matchup_diffs(rows.withColumn("ID", X.pair_id(F.col("Season"), F.col("T1"), F.col("T2"))), names)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    priced = frame.withColumn("MarketProb", F.col("_known.MarketProb")).withColumn("MarketAvailable", F.col("MarketProb").isNotNull().cast("int")).drop("_known")
    return priced.select("*", *((zero(f"T1_{c}") - zero(f"T2_{c}")).alias(f"D_{c}") for c in shown))


def standardize_ratings(df: DataFrame, renames: dict[str, str], prefix: str) -> DataFrame:
    """A vendor's table as Season, TeamName and prefixed numbers; text that is no number becomes null, absent columns stay away."""
    present = {old: new for old, new in renames.items() if old in df.columns}
    keys = [F.col(old).alias(new) for old, new in present.items() if new in ("Season", "TeamName", "TeamID")]
    number = lambda c: F.expr(f"nullif(try_cast(nullif(trim(cast(`{c}` AS string)), '') AS double), double('NaN'))")
    return df.select(*keys, *(number(old).alias(f"{prefix}{new}") for old, new in present.items() if new not in ("Season", "TeamName", "TeamID")))


def collapse_team_ratings(df: DataFrame) -> DataFrame:
    """One row a season and team: means of the numbers, the first name in order."""
    numbers = [c for c, t in df.dtypes if c not in ("Season", "TeamID", "TeamName") and t in ("double", "float", "int", "bigint")]
    return df.where("TeamID is not null").groupBy("Season", "TeamID").agg(F.min("TeamName").alias("TeamName"), *(F.avg(c).alias(c) for c in numbers))


def public_rating_signals(tables: list[DataFrame], futures: DataFrame) -> DataFrame:
    """Collapsed rating tables joined outer, title odds attached, the first table's name that a team has."""
    named = [t.withColumnRenamed("TeamName", f"_name{i}") for i, t in enumerate([*map(collapse_team_ratings, tables), collapse_team_ratings(futures)])]
    joined = reduce(lambda a, b: a.join(b, ["Season", "TeamID"], "full"), named[:-1]).join(named[-1], ["Season", "TeamID"], "left")
    return joined.withColumn("TeamName", F.coalesce(*(F.col(f"_name{i}") for i in range(len(named))))).drop(*(f"_name{i}" for i in range(len(named))))


def futures_prob(df: DataFrame, odds: str) -> DataFrame:
    return df.withColumn("MarketTitleProb", X.american_to_prob(odds))


def vendor_team_metrics(df: DataFrame, record: str, prefix: str, metrics: dict[str, str], fields: dict[str, str]) -> DataFrame:
    """A nested team record as columns, with a win rate that is null without games."""
    flat = {f"{prefix}{new}": F.col(f"{record}.{old}") for old, new in fields.items()} | {f"{prefix}{new}": F.col(f"{record}.metrics.{old}") for old, new in metrics.items()}
    out = df.withColumns(flat)
    wins, losses = F.col(f"{prefix}Wins"), F.col(f"{prefix}Losses")
    return out.withColumn(f"{prefix}WinRate", F.try_divide(wins.cast("double"), wins + losses)).drop(record)


def team_meta_attach(pairs: DataFrame, features: DataFrame, candidates: dict[str, list[str]]) -> DataFrame:
    """D_<name> of the first column of each list that the features have."""
    found = {name: next((c for c in cols if c in features.columns), None) for name, cols in candidates.items()}
    picked = features.select("Season", "TeamID", *(F.col(c).alias(name) for name, c in found.items() if c))
    joined = R.join_twice_prefixed(pairs, picked)
    return joined.select(*pairs.columns, *((F.col(f"T1_{n}") - F.col(f"T2_{n}")).alias(f"D_{n}") for n, c in found.items() if c))


# Rules


def _number(df: DataFrame, *names: str, pick=F.greatest) -> Column:
    """The largest (or least) of the columns that are there, nulls skipped."""
    cols = [F.col(c).cast("double") for c in names if c in df.columns]
    return (pick(*cols) if len(cols) > 1 else cols[0]) if cols else F.lit(None).cast("double")


def _any(*conditions: Column) -> Column:
    """Whether one holds; an unknown one does not."""
    return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in conditions))


def _raised(p: Column, gates: list[tuple[Column, float]], target: Column) -> Column:
    for gate, cap in gates:
        p = F.when(gate, F.greatest(p, F.least(target, F.lit(cap)))).otherwise(p)
    return X.clip_prob(p)


def live_rules_confirm(df: DataFrame, prob: str, routes: list[str]) -> DataFrame:
    """PostProb and RuleGroup: a lagging favourite is raised to what market, models and routes say, if ratings or models confirm it."""
    market, spread, gap = _number(df, "MarketProb"), _number(df, "LastSpread"), _number(df, "AbsSeedDiff")
    net, elo = _number(df, "D_SB_BNetRating", "D_SB_NetRating"), _number(df, "D_SB_BXelo", "D_SB_Xelo", "D_SB_DisplayElo")
    edge, comp = -_number(df, "D_SB_DisplayRank"), _number(df, "D_SB_AdjustedComposite", "D_SB_Composite", "D_SB_Cooper")
    model = _number(df, "SilverMatchupProb", "ModelMatchupProb", "ModelMatchupProbMean", "ModelMatchupProbMedian")
    line = _number(df, "SilverMatchupSpread", "ModelMatchupSpread", "ModelMatchupSpreadMean", "ModelMatchupSpreadMedian", pick=F.least)
    sources, p = _number(df, "ModelSourceCount"), F.col(prob)
    active = _any(market.isNotNull() & _any(market >= 0.79, spread <= -7.5, gap >= 5), model.isNotNull() & _any(model >= 0.80, line <= -7.5))
    target = F.least(F.greatest(p, market, model, *(_number(df, c) for c in routes)), F.lit(0.985))
    confirmed = _any(
        model >= 0.82,
        (model >= 0.76) & (line <= -6.5),
        (sources >= 2) & (model >= 0.74),
        net >= 8,
        elo >= 180,
        edge >= 25,
        comp >= 120,
        (net >= 5) & (edge >= 15),
        (elo >= 120) & (edge >= 18),
        (model >= 0.72) & (comp >= 60),
    )
    confirm = active & F.coalesce(p + 0.015 < target, F.lit(False)) & confirmed
    extreme = confirm & _any(market >= 0.90, model >= 0.92, spread <= -13.5, line <= -12.5, (net >= 12) & (gap >= 7))
    return df.withColumns({"PostProb": _raised(p, [(confirm, 0.94), (extreme, 0.975)], target), "RuleGroup": F.when(extreme, "extreme").when(confirm, "confirm")})


def live_rules_host(df: DataFrame, prob: str, routes: list[str]) -> DataFrame:
    """PostProb and RuleGroup: a lagging home favourite of an early round is raised to market and routes, if ratings or models confirm it."""
    market, spread, gap = _number(df, "MarketProb"), _number(df, "LastSpread"), _number(df, "AbsSeedDiff")
    host, early = _number(df, "D_HostLikely"), _number(df, "IsRound1Or2")
    net, edge = _number(df, "D_SB_BNetRating", "D_SB_NetRating"), -_number(df, "D_SB_DisplayRank")
    home = _number(df, "D_SB_CurrentHFA", "D_SB_XeloCurrentHFA", "D_SB_HomeCourtDisplay")
    model = _number(df, "SilverMatchupProb", "ModelMatchupProb", "ModelMatchupProbMean", "ModelMatchupProbMedian")
    line = _number(df, "SilverMatchupSpread", "ModelMatchupSpread", "ModelMatchupSpreadMean", "ModelMatchupSpreadMedian", pick=F.least)
    p = F.col(prob)
    target = F.least(F.greatest(market, *(_number(df, c) for c in routes)), F.lit(0.985))
    gate = F.coalesce(market.isNotNull() & (host >= 1) & (early >= 1) & (p + 0.02 < target), F.lit(False)) & _any(net >= 5, edge >= 18, (home >= 8) & (host >= 1), model >= 0.82)
    strong = gate & _any(market >= 0.86, (market >= 0.82) & (spread <= -6.5), (market >= 0.78) & (spread <= -10.5) & (gap >= 5), (model >= 0.84) & (line <= -5.5))
    extreme = gate & _any(market >= 0.93, (market >= 0.86) & (spread <= -13.5), (model >= 0.90) & (line <= -10.5))
    return df.withColumns({"PostProb": _raised(p, [(strong, 0.93), (extreme, 0.97)], target), "RuleGroup": F.when(extreme, "extreme").when(strong, "strong")})


def host_boost(p: Column, seed1: Column, seed2: Column, round1: float, round2: float) -> Column:
    """Moves p towards the side that hosts the other's pod, by a step for each of the first two rounds."""
    mine, theirs = host_pod_match(seed1, seed2), host_pod_match(seed2, seed1)
    step = lambda r: F.when(r == "round1", F.lit(round1)).otherwise(F.lit(round2))
    return X.clip_prob(F.when(mine.isNotNull() & theirs.isNull(), p + step(mine)).when(theirs.isNotNull() & mine.isNull(), p - step(theirs)).otherwise(p))


def postprocess_mined(p: Column, rules: list[tuple[Column, int, float, float]], least_edge: float) -> Column:
    """The first eight rules (mask, direction, floor, edge) with an edge 0.02 above the least: confident ones bound p from below or above."""
    for mask, direction, floor, edge in rules[:8]:
        hit = F.coalesce(mask, F.lit(False)) & F.lit(edge >= least_edge + 0.02)
        if direction > 0 and floor >= 0.80:
            p = F.when(hit, F.greatest(p, F.lit(min(0.999, floor)))).otherwise(p)
        elif direction < 0 and floor <= 0.20:
            p = F.when(hit, F.least(p, F.lit(max(0.001, floor)))).otherwise(p)
    return p


def postrules_manual(df: DataFrame) -> DataFrame:
    """Manual rules on canonical pairs: a swapped pair's values are mirrored; several rules of a pair give mean, strictest bounds and summed shift."""
    swap = F.col("T1") > F.col("T2")
    turned = lambda own, other: F.when(swap, 1 - F.col(other)).otherwise(F.col(own))
    rows = df.select(
        "Season",
        F.least("T1", "T2").alias("T1"),
        F.greatest("T1", "T2").alias("T2"),
        turned("OverrideProb", "OverrideProb").alias("OverrideProb"),
        turned("ProbFloor", "ProbCeil").alias("ProbFloor"),
        turned("ProbCeil", "ProbFloor").alias("ProbCeil"),
        F.when(swap, -F.col("LogitShift")).otherwise(F.col("LogitShift")).alias("LogitShift"),
    )
    return rows.groupBy(*PAIR).agg(F.avg("OverrideProb").alias("OverrideProb"), F.max("ProbFloor").alias("ProbFloor"), F.min("ProbCeil").alias("ProbCeil"), F.sum("LogitShift").alias("LogitShift"))


# Blends


def blend_columns(df: DataFrame, stats: list[str], anchor: str, market_weights: list[float], anchor_weights: list[float]) -> DataFrame:
    """Fixed blends of the statistical models' mean, an anchor model and the market, which the mean replaces where it is missing."""
    mean = X.row_mean(*stats)
    market = F.coalesce(F.col("MarketProb"), mean)
    filled = lambda c: X.clip_prob(F.coalesce(c, F.lit(0.5)))
    out = {"Prob_market_only": filled(market)}
    out |= {f"Prob_market_tilt_{round(w * 100)}": filled((1 - w) * mean + w * market) for w in market_weights}
    out |= {f"Prob_anchor_market_tilt_{round(w * 100)}": filled((1 - w) * F.coalesce(F.col(anchor), mean) + w * market) for w in anchor_weights}
    return df.withColumns(out)


def season_blend_override(df: DataFrame, prob: str, blends: dict[int, tuple[str, str, float]]) -> DataFrame:
    """OverriddenProb: seasons with an entry take a weighted pair of columns (unknown values count as one half), others keep prob."""
    side = lambda c: X.clip_prob(F.coalesce(F.col(c), F.lit(0.5)))
    out = F.col(prob)
    for season, (left, right, weight) in blends.items():
        out = F.when(F.col("Season") == season, X.clip_prob(weight * side(left) + (1 - weight) * side(right))).otherwise(out)
    return df.withColumn("OverriddenProb", out)
