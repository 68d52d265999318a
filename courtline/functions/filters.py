"""Projections and predicates over semi-structured tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_view(df: DataFrame, keys: list[str], wanted: list[str]) -> DataFrame:
    """A named subset of features: absent columns and nulls are 0.0, all in one projection."""
    return df.select(*keys, *((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(c) for c in wanted))


def drop_feature_groups(df: DataFrame, names: Iterable[str] = (), prefixes: Iterable[str] = ()) -> DataFrame:
    names, prefixes = set(names), tuple(prefixes)
    return df.drop(*(c for c in df.columns if c in names or (prefixes and c.startswith(prefixes))))


def keyword_predicate(columns: Iterable[str], keywords: Iterable[str]) -> Column:
    """Whether the lower-cased text of the columns holds any keyword."""
    text = F.lower(F.concat_ws(" ", *columns))
    return reduce(or_, (text.contains(k.lower()) for k in keywords))


def evidence_filter(df: DataFrame, evidence: Column, period: str, live_from: int) -> DataFrame:
    """Rows with evidence; if no row of the table has any, the rows before the live period.

    Whether there is evidence is one number of one row, joined to every row.
    """
    flagged = df.withColumn("_ev", F.coalesce(evidence, F.lit(False)))
    any_row = flagged.agg(F.coalesce(F.bool_or("_ev"), F.lit(False)).alias("_any"))
    return flagged.crossJoin(F.broadcast(any_row)).where(F.when(F.col("_any"), F.col("_ev")).otherwise(F.col(period) < live_from)).drop("_ev", "_any")


def verified_snapshots(df: DataFrame, cutoffs: DataFrame, verified: str, time: str, cutoff: str, period: str = "Season") -> DataFrame:
    """Leak guard: verified rows taken at or before their period's cutoff; periods without cutoff keep nothing."""
    return df.where(F.col(verified) == 1).join(cutoffs, period).where(F.col(time) <= F.col(cutoff)).drop(cutoff)


def market_time_policy(df: DataFrame, cutoffs: DataFrame, policy: str, time: str, cutoff: str, period: str = "Season", grace_days: int = 7) -> DataFrame:
    """all: every row; until_cutoff: rows at most grace_days after the cutoff; flag: every row with 0/1 LateQuote."""
    if policy == "all":
        return df
    late = F.col(time) > F.col(cutoff) + F.make_dt_interval(days=F.lit(grace_days))
    joined = df.join(cutoffs, period, "left")
    if policy == "until_cutoff":
        return joined.where(~F.coalesce(late, F.lit(False))).drop(cutoff)
    if policy == "flag":
        return joined.withColumn("LateQuote", F.coalesce(late, F.lit(False)).cast("int")).drop(cutoff)
    raise ValueError(f"no such policy: {policy}")


def valid_probability(p: str) -> Column:
    return F.coalesce((F.col(p) > 0) & (F.col(p) < 1), F.lit(False))


def last_periods(df: DataFrame, k: int, period: str = "Season") -> DataFrame:
    """Rows of the last k periods; the list of periods is cut on the executors."""
    last = df.select(period).distinct().orderBy(F.desc(period)).limit(k)
    return df.join(last, period, "left_semi")


def rule_mask(columns: list[str], operators: list[str], thresholds: list[float]) -> Column:
    """All conditions hold; a null value fails."""
    one = lambda c, o, t: F.col(c) >= t if o == ">=" else F.col(c) <= t
    return F.coalesce(reduce(and_, (one(*x) for x in zip(columns, operators, thresholds, strict=True))), F.lit(False))
