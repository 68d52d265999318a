"""Season-forward models with Spark ML: fits only see earlier seasons, scores are out of sample."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..sources.files import checkpoint
from .relational import exact_quantiles

KEY = ["GameID", "Season"]


def linear(features: list[str], weight: str | None = None) -> Pipeline:
    scaled = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)
    model = LogisticRegression(featuresCol="_x", labelCol="Label", regParam=0.01, maxIter=50, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_raw"), scaled, model])


def trees(features: list[str], weight: str | None = None) -> Pipeline:
    model = GBTClassifier(featuresCol="_x", labelCol="Label", maxIter=15, maxDepth=3, seed=7, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), model])


def margins(features: list[str], weight: str | None = None) -> Pipeline:
    model = GBTRegressor(featuresCol="_x", labelCol="MarginLabel", maxIter=15, maxDepth=3, seed=7, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), model])


def probability(scored: DataFrame) -> Column:
    """The model's probability of Label 1; a margin is turned into one."""
    return F.get(vector_to_array("probability"), F.lit(1)) if "probability" in scored.columns else X.margin_to_prob("prediction")


def _forward(rows: DataFrame, min_prior: int, fit_and_score: Callable[[DataFrame, DataFrame], DataFrame]) -> list[DataFrame]:
    """Fits for each season with enough earlier ones; the seasons are a short list of numbers."""
    seasons = sorted(r.Season for r in rows.select("Season").distinct().collect())
    return [fit_and_score(rows.where(F.col("Season") < s), rows.where(F.col("Season") == s)) for s in seasons[min_prior:]]


def season_forward_oof(matchups: DataFrame, features: list[str], models: dict[str, Callable[[list[str]], Pipeline]], min_prior: int = 3) -> DataFrame:
    """One out-of-sample probability column Prob_<model> for every row of the later seasons; missing features are 0."""
    filled = checkpoint(matchups.fillna(0.0, features))
    out = None
    for name, make in models.items():

        def run(train: DataFrame, test: DataFrame, make=make, name=name) -> DataFrame:
            scored = make(features).fit(train).transform(test)
            return scored.select(*KEY, "Label", X.clip_prob(probability(scored)).alias(f"Prob_{name}"))

        column = reduce(DataFrame.unionByName, _forward(filled, min_prior, run))
        out = column if out is None else out.join(column.drop("Label"), KEY)
    return out


@dataclass(frozen=True)
class Route:
    """A model with rows of its own: which are eligible, and what it takes to be switched on.

    A route is on in a season if at least `coverage` of the season's rows are eligible and `least_rows`
    eligible rows lie before it.
    """

    name: str
    make: Callable[[list[str]], Pipeline]
    features: tuple[str, ...]
    eligible: Column | None = None
    coverage: float = 0.0
    least_rows: int = 0


def season_routes_oof(matchups: DataFrame, routes: list[Route], min_prior: int = 3) -> DataFrame:
    """Season-forward Prob_<route> for every row of the later seasons, null where the route is off or the row not eligible.

    One pass counts eligible rows by season, so no fold is counted by itself. Missing features are 0; a route whose
    eligible rows all have one label is off.
    """
    names = sorted({f for r in routes for f in r.features})
    eligible = {f"_e{i}": F.coalesce(r.eligible if r.eligible is not None else F.lit(True), F.lit(False)) for i, r in enumerate(routes)}
    rows = checkpoint(matchups.withColumns(eligible).fillna(0.0, names))
    counts = rows.groupBy("Season").agg(F.count("*").alias("n"), *(F.sum(F.col(e).cast("long")).alias(e) for e in eligible), *(F.sum((F.col(e) & (F.col("Label") == 1)).cast("long")).alias(f"{e}l") for e in eligible))
    per = {r["Season"]: r for r in counts.collect()}  # a row for each season
    seasons, parts = sorted(per), []
    for s in seasons[min_prior:]:
        test = rows.where(F.col("Season") == s)
        for i, r in enumerate(routes):
            e = f"_e{i}"
            before, ones = (sum(per[q][c] or 0 for q in seasons if q < s) for c in (e, f"{e}l"))
            on = per[s][e] >= max(1, r.coverage * per[s]["n"]) and before >= max(1, r.least_rows) and 0 < ones < before
            if not on:
                test = test.withColumn(f"Prob_{r.name}", F.lit(None).cast("double"))
                continue
            keep = test.columns
            scored = r.make(list(r.features)).fit(rows.where((F.col("Season") < s) & F.col(e))).transform(test)
            test = scored.select(*keep, F.when(F.col(e), X.clip_prob(probability(scored))).alias(f"Prob_{r.name}"))
        parts.append(test.select(*KEY, "Label", *(f"Prob_{r.name}" for r in routes)))
    return reduce(DataFrame.unionByName, parts, rows.limit(0).select(*KEY, "Label", *(F.lit(None).cast("double").alias(f"Prob_{r.name}") for r in routes)))


def calibrate(oof: DataFrame, column: str, method: str, min_prior: int = 1, least_rows: int = 300) -> DataFrame:
    """Season-forward Platt or isotonic calibration of a probability column; with fewer earlier rows it stays as it is."""
    rows = checkpoint(oof.select(*KEY, "Label", F.col(column).alias("_p"), X.logit(column).alias("_logit")))

    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        train = train.where("_p is not null")
        if train.count() < least_rows:
            return test.select(*KEY, "Label", "_p", X.clip_prob("_p").alias("Calibrated"))
        if method == "platt":
            assembler = VectorAssembler(inputCols=["_logit"], outputCol="_x")
            scored = Pipeline(stages=[assembler, LogisticRegression(featuresCol="_x", labelCol="Label", maxIter=50)]).fit(train).transform(test)
            return scored.select(*KEY, "Label", "_p", X.clip_prob(probability(scored)).alias("Calibrated"))
        assembler = VectorAssembler(inputCols=["_p"], outputCol="_x")
        scored = Pipeline(stages=[assembler, IsotonicRegression(featuresCol="_x", labelCol="Label")]).fit(train).transform(test)
        return scored.select(*KEY, "Label", "_p", X.clip_prob("prediction").alias("Calibrated"))

    return reduce(DataFrame.unionByName, _forward(rows, min_prior, run)).withColumnRenamed("_p", column)


def stack_meta(oof: DataFrame, columns: list[str], min_prior: int = 1) -> DataFrame:
    """Season-forward logistic regression on logits and the row's mean, deviation and range of all models; a missing model takes the row's mean."""
    inputs = {f"_l{i}": X.logit(f"_f{i}") for i in range(len(columns))} | {"_mean": X.row_mean(*columns), "_std": X.row_std(*(f"_f{i}" for i in range(len(columns)))), "_range": X.row_max(*columns) - X.row_min(*columns)}
    filled = oof.withColumns({f"_f{i}": F.coalesce(F.col(c), X.row_mean(*columns), F.lit(0.5)) for i, c in enumerate(columns)})
    rows = checkpoint(filled.withColumns(inputs).fillna({"_mean": 0.5, "_range": 0.0}))

    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        scored = linear(list(inputs)).fit(train).transform(test)
        return scored.select(*KEY, "Label", *columns, X.clip_prob(probability(scored)).alias("Prob_stack"))

    return reduce(DataFrame.unionByName, _forward(rows, min_prior, run))


def full_fit_and_score(train: DataFrame, new: DataFrame, features: list[str], make: Callable[..., Pipeline], weight: str | None = None) -> DataFrame:
    """A fit on all rows, scored on new pairs; a fit takes many passes over rows that are made once."""
    scored = make(features, weight).fit(checkpoint(train.fillna(0.0, features))).transform(new.fillna(0.0, features))
    return scored.select(*new.columns, X.clip_prob(probability(scored)).alias("Prob"))


def binned_margin_curve(rows: DataFrame, margin: str, bins: int = 24, least: int = 8) -> DataFrame:
    """Mean margin and label of up to `bins` quantile bins with enough rows: a curve for interpolate().

    Small tables get fewer bins, so that a bin can hold `least` rows.
    """
    bins = max(1, min(bins, rows.where(F.col(margin).isNotNull()).count() // (2 * least)))
    edges = exact_quantiles(rows, margin, [i / bins for i in range(1, bins)] or [1.0], "_e")
    placed = rows.crossJoin(F.broadcast(edges)).withColumn("Bin", F.size(F.filter("_e", lambda e: e < F.col(margin))))
    return placed.groupBy("Bin").agg(F.avg(margin).alias("Margin"), F.avg("Label").alias("Rate"), F.count("*").alias("n")).where(F.col("n") >= least)
