"""Scores of probabilities against outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def squared_loss(p: Column | str, label: str = "Label") -> Column:
    return F.pow((F.col(p) if isinstance(p, str) else p) - F.col(label), 2)


def brier_by_season(df: DataFrame, p: str, period: list[str] = ["Season"]) -> DataFrame:  # noqa: B006
    return df.groupBy(*period).agg(F.avg(squared_loss(p)).alias("Brier"), F.count("*").alias("n"))


def calibration_bins(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """Right-closed bins of each probability with counts, means, rate, Brier score and gap; empty bins are kept."""
    long = df.select("Label", F.inline(F.array(*(F.struct(F.lit(c).alias("ProbType"), F.col(c).alias("p")) for c in columns))))
    at = F.greatest(F.ceil(F.col("p") * bins) - 1, F.lit(0)).cast("int")
    found = long.where("p is not null").groupBy("ProbType", at.alias("Bin")).agg(F.count("*").alias("Count"), F.avg("p").alias("PredMean"), F.avg("Label").alias("ActualRate"), F.avg(squared_loss("p")).alias("Brier"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("Bin"), F.explode(F.array(*(F.lit(c) for c in columns))).alias("ProbType"))
    return every.join(found, ["ProbType", "Bin"], "left").withColumn("Count", F.coalesce("Count", F.lit(0))).withColumn("CalibrationGap", F.abs(F.col("PredMean") - F.col("ActualRate")))


def calibration_slices(df: DataFrame, raw: str, final: str) -> DataFrame:
    """Scores by seed gap, favourite's probability and, if SameConference is there, conference: one pass over exploded slice names."""
    gap, fav = F.col("AbsSeedDiff"), F.greatest(F.col(final), F.lit(1.0) - F.col(final))
    slices = [
        F.struct(F.lit("AbsSeedDiff").alias("SliceType"), F.when(gap <= 1, "seed_0_1").when(gap <= 4, "seed_2_4").when(gap <= 8, "seed_5_8").when(gap > 8, "seed_9_plus").otherwise("nan").alias("SliceValue")),
        F.struct(F.lit("FavoriteProb").alias("SliceType"), F.when(fav <= 0.6, "fav_50_60").when(fav <= 0.7, "fav_60_70").when(fav <= 0.8, "fav_70_80").otherwise("fav_80_100").alias("SliceValue")),
    ]
    if "SameConference" in df.columns:
        slices.append(F.struct(F.lit("Conference").alias("SliceType"), F.when(F.col("SameConference") == 1, "same_conf").otherwise("cross_conf").alias("SliceValue")))
    rows = df.select("Label", F.col(raw).alias("_raw"), F.col(final).alias("_final"), F.inline(F.array(*slices)))
    return rows.groupBy("SliceType", "SliceValue").agg(F.count("*").alias("Count"), F.avg(squared_loss("_raw")).alias("RawBrier"), F.avg(squared_loss("_final")).alias("FinalBrier"), F.avg("Label").alias("FinalActualRate"), F.avg("_final").alias("FinalPredMean"))


def strategy_grid(df: DataFrame, columns: list[str], shrinkages: tuple[float, ...] = (0.0, 0.03, 0.06, 0.10)) -> DataFrame:
    """Mean seasonal Brier score of each column and shrinkage towards one half, the best marked."""
    options = F.array(*(F.struct(F.lit(c).alias("Strategy"), F.lit(s).alias("Shrinkage"), ((F.col(c) - 0.5) * (1 - s) + 0.5).alias("p")) for c in columns for s in shrinkages))
    seasons = df.select("Season", "Label", F.inline(options)).groupBy("Strategy", "Shrinkage", "Season").agg(F.avg(squared_loss("p")).alias("b"))
    scores = seasons.groupBy("Strategy", "Shrinkage").agg(F.avg("b").alias("Brier"))
    best = F.row_number().over(Window.orderBy(F.round("Brier", 9), "Strategy", "Shrinkage"))  # a row for each option
    return scores.withColumn("Best", (best == 1).cast("int"))


def prob_fallback(df: DataFrame, chosen: str, others: list[str]) -> Column:
    """The chosen column, else the mean of the others that are there, else one half."""
    from ..functions.expressions import clip_prob, row_mean

    return clip_prob(F.coalesce(F.col(chosen), row_mean(*others), F.lit(0.5)))


def blend_weight_grid(df: DataFrame, columns: list[str], step: float = 0.1) -> DataFrame:
    """Convex weights of up to three probability columns by the Brier score of the seasons before.

    One pass gives each season's sums of products; the cumulative sums of earlier seasons are
    evaluated as a quadratic form at every point of the grid.
    """
    k = len(columns)
    y = F.col("Label").cast("double")
    sums = [F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"g{i}{j}") for i in range(k) for j in range(i, k)] + [F.sum(F.col(c) * y).alias(f"y{i}") for i, c in enumerate(columns)] + [F.sum(y * y).alias("yy"), F.count("*").alias("n")]
    per = df.groupBy("Season").agg(*sums)
    before = Window.orderBy("Season").rowsBetween(Window.unboundedPreceding, -1)  # a row for each season
    prior = per.select("Season", *(F.sum(c).over(before).alias(c) for c in per.columns[1:])).where("n is not null")
    n = round(1 / step)
    points = [(a / n, b / n, (n - a - b) / n) for a in range(n + 1) for b in range(n + 1 - a)] if k == 3 else [(a / n, (n - a) / n) for a in range(n + 1)]
    form = lambda w: sum((F.col(f"g{i}{j}") * (w[i] * w[j] * (1 if i == j else 2)) for i in range(k) for j in range(i, k)), F.lit(0.0)) - sum((F.col(f"y{i}") * (2 * w[i]) for i in range(k)), F.lit(0.0)) + F.col("yy")
    tried = prior.select("Season", F.inline(F.array(*(F.struct(F.lit(i).alias("Point"), *(F.lit(w[j]).alias(f"w{j}") for j in range(k)), (form(w) / F.col("n")).alias("Brier")) for i, w in enumerate(points)))))
    first = Window.partitionBy("Season").orderBy(F.round("Brier", 9), "Point")
    return tried.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn", "Point")
