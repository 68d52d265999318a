"""Rows of a pair of teams: labels, differences, context, history."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import relational as R

PAIR = ["Season", "T1", "T2"]


def matchup_labels(games: DataFrame) -> DataFrame:
    """T1 is the smaller id; Label says whether it won and MarginLabel by how much."""
    won = F.col("WTeamID") < F.col("LTeamID")
    margin = F.col("WScore") - F.col("LScore")
    kept = [c for c in ("GameID", "League", "Season", "DayNum") if c in games.columns]
    return games.select(*kept, F.least("WTeamID", "LTeamID").alias("T1"), F.greatest("WTeamID", "LTeamID").alias("T2"), won.cast("int").alias("Label"), F.when(won, margin).otherwise(-margin).alias("MarginLabel"))


def matchup_diffs(df: DataFrame, features: list[str]) -> DataFrame:
    """D_x = T1_x - T2_x for every feature that both sides have, in one projection."""
    return df.select("*", *((F.col(f"T1_{c}") - F.col(f"T2_{c}")).alias(f"D_{c}") for c in features if f"T1_{c}" in df.columns and f"T2_{c}" in df.columns))


def matchup_context(df: DataFrame, styles: list[str]) -> DataFrame:
    """Seed gap, who is better seeded, same conference, absolute style gaps and their sum (missing counts as 0)."""
    gaps = {f"Abs{c}Diff": F.abs(F.col(f"T1_{c}") - F.col(f"T2_{c}")) for c in styles}
    return df.withColumns(
        {
            "AbsSeedDiff": F.abs(F.col("T1_SeedNum") - F.col("T2_SeedNum")),
            "T1BetterSeed": F.coalesce((F.col("T1_SeedNum") < F.col("T2_SeedNum")).cast("int"), F.lit(0)),
            "SameConference": F.coalesce((F.col("T1_ConfAbbrev") == F.col("T2_ConfAbbrev")).cast("int"), F.lit(0)),
            **gaps,
            "StyleMismatchScore": reduce(add, (F.coalesce(g, F.lit(0.0)) for g in gaps.values())),
        }
    )


def head_to_head(games: DataFrame) -> DataFrame:
    rows = matchup_labels(games)
    return rows.groupBy(*PAIR).agg(F.count("*").alias("H2HGames"), F.avg("Label").alias("H2HT1WinPct"), F.avg("MarginLabel").alias("H2HT1Margin"))


def matchup_table(games: DataFrame, features: DataFrame, history: list[DataFrame] = (), required: str = "") -> DataFrame:
    """Labels, both sides' features, differences and pair history; rows without the required difference are dropped."""
    names = [c for c, t in features.dtypes if c not in ("Season", "TeamID") and t in ("double", "int", "bigint", "float")]
    out = matchup_diffs(R.join_twice_prefixed(matchup_labels(games), features), names)
    for h in history:
        out = out.join(h, PAIR, "left")
    return out.where(F.col(f"D_{required}").isNotNull()) if required else out


def market_merge(df: DataFrame, market: DataFrame, column: str = "MarketProb") -> DataFrame:
    return df.join(market, PAIR, "left").withColumn("MarketAvailable", F.col(column).isNotNull().cast("int"))


def signal_merge(df: DataFrame, signals: DataFrame) -> DataFrame:
    """Two-sided signals and their difference, missing ones counting as 0."""
    names = [c for c in signals.columns if c not in ("Season", "TeamID")]
    out = R.join_twice_prefixed(df, signals)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return out.select("*", *((zero(f"T1_{c}") - zero(f"T2_{c}")).alias(f"D_{c}") for c in names))


def text_matchup_features(df: DataFrame, pooled: DataFrame, components: list[str]) -> tuple[DataFrame, list[str]]:
    """Differences, absolute differences and means of both teams' vectors, and how many documents they rest on.

    pooled: Season, TeamID, the vector columns `components`, and DocCount and WindowDocCount if there are any. A team without vectors
    counts as zeros, as long as the longest vector of its component. Returns the rows and the new columns.
    """
    counts = [c for c in ("DocCount", "WindowDocCount") if c in pooled.columns]
    lengths = pooled.agg(*(F.coalesce(F.max(F.size(c)), F.lit(0)).alias(f"_{c}") for c in components))  # one row
    out = R.join_twice_prefixed(df, pooled.select("Season", "TeamID", *components, *counts)).crossJoin(F.broadcast(lengths))
    new: dict[str, Column] = {}
    for c in components:
        a, b = (F.coalesce(F.col(f"{t}_{c}"), F.array_repeat(F.lit(0.0), F.col(f"_{c}"))) for t in ("T1", "T2"))
        zero = lambda x: F.coalesce(x, F.lit(0.0))
        new |= {f"D_{c}": F.zip_with(a, b, lambda x, y: zero(x) - zero(y)), f"AbsD_{c}": F.zip_with(a, b, lambda x, y: F.abs(zero(x) - zero(y))), f"Mean_{c}": F.zip_with(a, b, lambda x, y: (zero(x) + zero(y)) / 2)}
    side = lambda c: [F.coalesce(F.col(f"{t}_{c}"), F.lit(0)) for t in ("T1", "T2")]
    for c in counts:
        a, b = side(c)
        new |= {f"D_{c}": a - b} | ({f"{c}Total": a + b, f"{c}Min": F.least(a, b)} if c == "DocCount" else {})
    return out.withColumns(new).drop(*(f"_{c}" for c in components), *(f"{t}_{c}" for t in ("T1", "T2") for c in [*components, *counts])), list(new)


def field_difference_sums(field: DataFrame, features: DataFrame, absolute: bool) -> DataFrame:
    """Per season and feature: number, mean and deviation of the differences over all pairs of the field, without a row for each pair.

    field: Season, TeamID. features: one row a season and team. The value at place k of n (by id, or by size if differences are
    absolute) is the first side of some pairs and the second of others, so it counts n + 1 - 2k times in their sum; the sum of the squared differences is n times that of
    the squared distances from the mean. A pair counts if both have the value; a season without two teams has no row.
    """
    names = [c for c in features.columns if c not in ("Season", "TeamID")]
    rows = field.select("Season", "TeamID").dropna().distinct().join(features, ["Season", "TeamID"], "left")
    long = rows.select("Season", "TeamID", F.inline(F.array(*(F.struct(F.lit(c).alias("Feature"), F.col(c).cast("double").alias("x")) for c in names))))
    every = Window.partitionBy("Season", "Feature")
    n, k = F.count("x").over(every), F.row_number().over(every.orderBy(F.col("x").asc_nulls_last() if absolute else F.col("x").isNull(), "TeamID"))
    placed = long.select("Season", "Feature", n.alias("_n"), (F.col("x") - F.avg("x").over(every)).alias("_c"), ((k * 2 - n - 1) if absolute else (n + 1 - k * 2)).alias("_times"))
    sums = placed.groupBy("Season", "Feature").agg(F.count("*").alias("_teams"), F.max("_n").cast("double").alias("_n"), F.sum(F.col("_c") * F.col("_times")).alias("_s"), F.sum(F.col("_c") * F.col("_c")).alias("_q"))
    pairs = (F.col("_n") * (F.col("_n") - 1) / 2).alias("_pairs")
    known = sums.where("_teams > 1").select("Season", "Feature", pairs, "_s", (F.col("_q") * F.col("_n")).alias("_q"))
    spread = F.sqrt(F.greatest(F.col("_q") - F.col("_s") * F.col("_s") / F.col("_pairs"), F.lit(0.0)) / (F.col("_pairs") - 1))
    return known.select("Season", "Feature", F.col("_pairs").cast("long").alias("_n"), F.when(F.col("_pairs") > 0, F.col("_s") / F.col("_pairs")).alias("_mean"), F.when(F.col("_pairs") > 1, spread).alias("_sd"))


def field_profile(field: DataFrame, features: DataFrame, floor: float = 0.1) -> DataFrame:
    """Per season and feature: mean and floored deviation of the differences over all pairs of the field (Season, TeamID)."""
    sd = F.col("_sd")
    return field_difference_sums(field, features, False).select("Season", "Feature", F.col("_mean").alias("FieldMean"), F.when(sd.isNotNull(), F.greatest(sd, F.lit(floor))).alias("FieldStd"))


def kernel_profile(pairs: DataFrame, features: DataFrame, least: int = 12) -> DataFrame:
    """Per season and feature: mean of the absolute differences over all pairs of the field, and a scale for them.

    The scale is the deviation, a tenth of the mean or 0.15, whichever is largest; features with fewer than `least` pairs are left out.
    """
    names = [c for c in features.columns if c not in ("Season", "TeamID")]
    rows = matchup_diffs(R.join_twice_prefixed(pairs, features), names)
    long = rows.select("Season", F.inline(F.array(*(F.struct(F.lit(c).alias("Feature"), F.abs(F.col(f"D_{c}")).alias("d")) for c in names))))
    wide = long.groupBy("Season", "Feature").agg(F.count("d").alias("_n"), F.avg("d").alias("Mean"), F.stddev_samp("d").alias("_sd")).where(F.col("_n") >= least)
    return wide.select("Season", "Feature", "Mean", F.greatest("_sd", F.abs("Mean") * 0.10, F.lit(0.15)).alias("Scale"))


def field_kernel_profile(field: DataFrame, features: DataFrame, least: int = 12) -> DataFrame:
    """kernel_profile over all pairs of a field (Season, TeamID), from sums over its teams."""
    wide = field_difference_sums(field, features, True).where(F.col("_n") >= least)
    return wide.select("Season", "Feature", F.col("_mean").alias("Mean"), F.greatest("_sd", F.abs("_mean") * 0.10, F.lit(0.15)).alias("Scale"))


def field_kernel_weights(rows: DataFrame, profile: DataFrame, names: list[str], strength: float = 1.0, clip: float = 6.0, least_rows: int = 50, least_features: int = 4) -> DataFrame:
    """Weights of every season's earlier rows by how much they resemble the pairs of its field.

    rows: Season and D_<name>. profile: Season, Feature, Mean, Scale (kernel_profile). Each row comes once for each later season of
    the profile, with TargetSeason and Weight: 1 + strength * exp(-mean(z^2) / 2) over the features that at
    least `least_rows` earlier rows have, scaled to mean 1. A missing value counts as the field's mean; with fewer
    than `least_features` features every weight is 1.
    """
    pick = lambda c, v: F.max(F.when(F.col("Feature") == c, F.col(v)))
    wide = profile.groupBy(F.col("Season").alias("TargetSeason")).agg(*(pick(c, v).alias(f"_{v[0]}{i}") for i, c in enumerate(names) for v in ("Mean", "Scale")))
    tried = rows.join(F.broadcast(wide), F.col("Season") < F.col("TargetSeason"))  # a row for each season
    off = lambda i, c: (F.abs(F.col(f"D_{c}")) - F.col(f"_M{i}")) / F.greatest(F.col(f"_S{i}"), F.lit(0.15))
    z = {f"_z{i}": F.when(off(i, c).isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), off(i, c)))) for i, c in enumerate(names)}  # bounds alone would pass over a null
    tried = tried.withColumns(z)
    usable = tried.groupBy("TargetSeason").agg(*((F.count(k) >= least_rows).alias(f"_u{k[2:]}") for k in z))
    marked = tried.join(F.broadcast(usable), "TargetSeason")  # a row for each season
    square = reduce(add, (F.when(F.col(f"_u{k[2:]}"), F.coalesce(F.col(k) * F.col(k), F.lit(0.0))).otherwise(0.0) for k in z))
    used = reduce(add, (F.col(f"_u{k[2:]}").cast("int") for k in z))
    raw = marked.withColumn("_w", F.when(used >= least_features, F.exp(square / used * -0.5) * strength + 1).otherwise(1.0))
    mean = raw.groupBy("TargetSeason").agg(F.avg("_w").alias("_mean"))
    return raw.join(F.broadcast(mean), "TargetSeason").select(*rows.columns, "TargetSeason", (F.col("_w") / F.col("_mean")).alias("Weight"))
