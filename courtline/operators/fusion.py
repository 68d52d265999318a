"""Choices made from earlier seasons only, specialists on gated rows, and inputs of a live review."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..sources.files import checkpoint
from . import relational as R
from .evaluate import prob_fallback, squared_loss, strategy_grid
from .models import _forward, linear, probability

PAIR = ["Season", "T1", "T2"]
SHRINKAGES = (0.0, 0.03, 0.06, 0.10)


def _season_scores(df: DataFrame, columns: list[str], shrinkages: tuple[float, ...]) -> DataFrame:
    """Brier score of every column and shrinkage in every season: a row for each of them."""
    options = F.array(*(F.struct(F.lit(c).alias("Strategy"), F.lit(s).alias("Shrinkage"), ((F.col(c) - 0.5) * (1 - s) + 0.5).alias("p")) for c in columns for s in shrinkages))
    return df.select("Season", "Label", F.inline(options)).groupBy("Strategy", "Shrinkage", "Season").agg(F.avg(squared_loss("p")).alias("b"))


def _apply_choice(df: DataFrame, columns: list[str]) -> DataFrame:
    """RawProb, FinalProb and FavoriteProb of the row's Strategy and Shrinkage; an unknown value falls back to the mean of the others."""
    raw = reduce(lambda rest, c: F.when(F.col("Strategy") == c, prob_fallback(df, c, [o for o in columns if o != c])).otherwise(rest), columns, F.lit(None).cast("double"))
    rows = df.withColumn("_raw", raw)
    final = X.clip_prob((F.col("_raw") - 0.5) * (F.lit(1.0) - F.col("Shrinkage")) + 0.5)
    return rows.withColumns({"ChosenProb": F.col("_raw"), "FinalProb": final, "FavoriteProb": F.greatest(final, 1 - final)}).drop("_raw")


def strategy_oof(df: DataFrame, columns: list[str], shrinkages: tuple[float, ...] = SHRINKAGES) -> DataFrame:
    """Every season scored by the column and shrinkage that were best, by mean seasonal Brier score, in the seasons before.

    Seasons without an earlier one are left out. The choices are one row a season.
    """
    before = Window.partitionBy("Strategy", "Shrinkage").orderBy("Season").rowsBetween(Window.unboundedPreceding, -1)
    prior = _season_scores(df, columns, shrinkages).withColumn("_prior", F.avg("b").over(before)).where("_prior is not null")
    first = Window.partitionBy("Season").orderBy(F.round("_prior", 9), "Strategy", "Shrinkage")
    chosen = prior.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select("Season", "Strategy", "Shrinkage")
    return _apply_choice(df.join(chosen, "Season"), columns)


def strict_holdout(df: DataFrame, columns: list[str], seasons: int = 2, shrinkages: tuple[float, ...] = SHRINKAGES) -> DataFrame:
    """One row: the choice made without the last seasons, its score before and in them, and the gap between the two."""
    scores = _season_scores(df, columns, shrinkages)
    cut = df.agg((F.max("Season") - seasons).alias("_cut"))  # one row
    held = F.col("Season") > F.col("_cut")
    both = scores.crossJoin(F.broadcast(cut)).groupBy("Strategy", "Shrinkage").agg(F.avg(F.when(~held, F.col("b"))).alias("TuneBrier"), F.avg(F.when(held, F.col("b"))).alias("HoldoutBrier"))
    best = both.where("TuneBrier is not null").orderBy(F.round("TuneBrier", 9), "Strategy", "Shrinkage").limit(1)
    return best.withColumn("OptimismGap", F.col("HoldoutBrier") - F.col("TuneBrier"))


def model_set_search(df: DataFrame, sets: dict[str, list[str]], shrinkages: tuple[float, ...] = SHRINKAGES) -> DataFrame:
    """Mean probability of each set of models under each shrinkage, by mean seasonal Brier score, the best marked."""
    means = df.select("Season", "Label", *(X.row_mean(*cols).alias(name) for name, cols in sets.items()))
    return strategy_grid(means, list(sets), shrinkages).withColumnRenamed("Strategy", "ModelSet")


def residual_overlay_search(df: DataFrame, base: str, overlay: str, weights: list[float], folds: int = 5, least_folds: int = 1, least_rows: int = 60) -> DataFrame:
    """Mean Brier score over the last seasons of each weight of an overlay, which counts where there is a market.

    Too few scored seasons or overlaid rows leave the score null; the best score is marked.
    """
    active = F.col("MarketProb").isNotNull() & F.col(overlay).isNotNull()
    cut = df.agg((F.max("Season") - folds).alias("_cut"))  # one row
    rows = df.crossJoin(F.broadcast(cut)).where(F.col("Season") > F.col("_cut"))
    tried = F.array(*(F.struct(F.lit(w).alias("Weight"), F.when(active, X.clip_prob((1 - w) * F.col(base) + w * F.col(overlay))).otherwise(F.col(base)).alias("p")) for w in weights))
    seasons = rows.select("Season", "Label", active.cast("long").alias("_a"), F.inline(tried)).groupBy("Weight", "Season").agg(F.avg(squared_loss("p")).alias("b"), F.sum("_a").alias("a"))
    enough = (F.count("b") >= least_folds) & (F.sum("a") >= least_rows)
    scores = seasons.groupBy("Weight").agg(F.when(enough, F.avg("b")).alias("Brier"), F.sum("a").alias("ActiveRows"))
    best = F.row_number().over(Window.orderBy(F.round("Brier", 9).asc_nulls_last(), "Weight"))  # a row for each weight
    return scores.withColumn("Best", ((best == 1) & F.col("Brier").isNotNull()).cast("int"))


def market_residual_model(matchups: DataFrame, features: list[str], since: int = 2015, coverage: float = 0.85, min_prior: int = 1, least_rows: int = 50) -> DataFrame:
    """Season-forward Prob_residual: the market's probability plus a learned correction.

    Seasons count from `since` on if the market covers enough of their rows. Rows without a
    market, and seasons with too few earlier rows, have null.
    """
    share = matchups.groupBy("Season").agg(F.avg(F.col("MarketProb").isNotNull().cast("double")).alias("_c"))
    active = share.where((F.col("Season") >= since) & (F.col("_c") >= coverage)).select("Season")
    rows = checkpoint(matchups.join(active, "Season").fillna(0.0, features).withColumn("_target", F.col("Label") - F.col("MarketProb")))

    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        known = train.where("_target is not null")
        if known.count() < least_rows:
            return test.select(*matchups.columns, F.lit(None).cast("double").alias("Prob_residual"))
        model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), GBTRegressor(featuresCol="_x", labelCol="_target", maxIter=15, maxDepth=3, seed=7)]).fit(known)
        return model.transform(test).select(*matchups.columns, X.clip_prob(F.col("MarketProb") + F.col("prediction")).alias("Prob_residual"))

    return reduce(DataFrame.unionByName, _forward(rows, min_prior, run), rows.limit(0).select(*matchups.columns, F.lit(None).cast("double").alias("Prob_residual")))


def gated_expert_blend(matchups: DataFrame, prob: str, features: list[str], gate: Column, weight: float = 0.5, min_prior: int = 1, least_rows: int = 50) -> DataFrame:
    """Season-forward Prob_gated: in gated rows a specialist, fitted on earlier gated rows only, is blended in; weight 1 routes them to it."""
    rows = checkpoint(matchups.fillna(0.0, features).withColumn("_gate", F.coalesce(gate, F.lit(False))))

    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        own = train.where("_gate")
        labels = own.groupBy("Label").count().collect()  # two rows
        if len(labels) < 2 or sum(r["count"] for r in labels) < least_rows:
            return test.select(*matchups.columns, F.col("_gate").alias("Gated"), F.col(prob).alias("Prob_gated"))
        scored = linear(features).fit(own).transform(test)
        blend = X.clip_prob((1 - weight) * F.col(prob) + weight * probability(scored))
        return scored.select(*matchups.columns, F.col("_gate").alias("Gated"), F.when(F.col("_gate"), blend).otherwise(F.col(prob)).alias("Prob_gated"))

    return reduce(DataFrame.unionByName, _forward(rows, min_prior, run), rows.limit(0).select(*matchups.columns, F.col("_gate").alias("Gated"), F.col(prob).alias("Prob_gated")))


# Inputs of a live review


def live_model_merge(consensus: DataFrame, vendor: DataFrame, names: dict[str, list[str]], *order: Column) -> DataFrame:
    """The models' consensus with one vendor's last row of the pair: each new column is the first alias with a number."""
    last = R.keep_last(vendor, PAIR, *order)
    return consensus.join(last.select(*PAIR, *(X.coalesce_aliases(vendor, aliases).alias(new) for new, aliases in names.items())), PAIR, "left")


def review_inputs(scored: DataFrame, frames: list[DataFrame], *order: Column) -> DataFrame:
    """Scored pairs with the last row of their pair in any of the leagues' consensus frames."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    last = R.keep_last(every, PAIR, *order)
    return scored.join(last.select(*PAIR, *(c for c in last.columns if c not in scored.columns)), PAIR, "left")


def historical_ratings_snapshot(ratings: DataFrame, cutoffs: DataFrame, safe: list[str], *order: Column) -> DataFrame:
    """Columns that leak nothing, stamped with the season's cutoff date; the last row of a season and team stays.

    cutoffs: Season, SnapshotDate. Seasons without a date can't be verified and go.
    """
    last = R.keep_last(R.drop_missing_keys(ratings, ["Season", "TeamID"]), ["Season", "TeamID"], *order)
    kept = last.select("Season", "TeamID", *(c for c in safe if c in last.columns))
    return kept.join(cutoffs.where("SnapshotDate is not null"), "Season").withColumn("VerifiedPreTourney", F.lit(1))


def snapshot_coverage(snapshot: DataFrame, field: DataFrame) -> DataFrame:
    """Share of each season's field that a snapshot covers."""
    known = snapshot.select("Season", "TeamID").distinct().withColumn("_k", F.lit(1))
    return field.join(known, ["Season", "TeamID"], "left").groupBy("Season").agg(F.count("_k").alias("Covered"), F.count("*").alias("Teams"), F.avg(F.coalesce("_k", F.lit(0))).alias("Coverage"))
