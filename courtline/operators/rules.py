"""Bounded probability rules, rule mining and grid searches. Rules are column to column."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions.filters import rule_mask
from ..sources.files import checkpoint

#: Parameter sets of one grid search.
MOST_SETS = 20_000


def both_ways(p: Column, high: Column, low: Column, floor: Column | float) -> Column:
    """Raises p to the floor where `high` holds, lowers it to 1 - floor where `low` does; null conditions don't act."""
    f = floor if isinstance(floor, Column) else F.lit(floor)
    raised = F.when(F.coalesce(high, F.lit(False)), F.greatest(p, f)).otherwise(p)
    return F.when(F.coalesce(low, F.lit(False)), F.least(raised, F.lit(1.0) - f)).otherwise(raised)


def seed_floor(p: Column, top: int, dog: int, floor: float, gate: Column | None = None) -> Column:
    gate = F.lit(True) if gate is None else gate
    t1, t2 = F.col("T1_SeedNum"), F.col("T2_SeedNum")
    return X.clip_prob(both_ways(X.clip_prob(p), gate & (t1 <= top) & (t2 >= dog), gate & (t2 <= top) & (t1 >= dog), floor))


def market_floor(p: Column, threshold: float, floor: float, gap: int = 0, gate: Column | None = None) -> Column:
    gate = F.lit(True) if gate is None else gate
    if gap:
        gate = gate & (F.col("AbsSeedDiff") >= gap)
    m = F.col("MarketProb")
    return X.clip_prob(both_ways(X.clip_prob(p), gate & (m >= threshold), gate & (m <= 1 - threshold), floor))


def spread_floor(p: Column, threshold: float, floor: float) -> Column:
    return X.clip_prob(both_ways(X.clip_prob(p), F.col("LastSpread") <= -threshold, F.col("LastSpread") >= threshold, floor))


def adaptive_weight(base: Column | float, close_at: Column | int, close: Column | float, wide_at: Column | int, wide: Column | float) -> Column:
    """The market's weight by seed gap, within 0 and 0.70; an unknown gap counts as wide."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    gap = F.coalesce(F.col("AbsSeedDiff").cast("double"), F.lit(float("inf")))
    w = F.when(gap >= lit(wide_at), lit(wide)).when(gap <= lit(close_at), lit(close)).otherwise(lit(base))
    return F.greatest(F.lit(0.0), F.least(F.lit(0.70), w))


def market_blend(p: Column, weight: Column) -> Column:
    m = F.col("MarketProb")
    return X.clip_prob(F.when(m.isNotNull() & (weight > 0), (F.lit(1.0) - weight) * X.clip_prob(p) + weight * X.clip_prob(m)).otherwise(X.clip_prob(p)))


def asym_market_blend(p: Column, edge: float, gap: int, weight: float, floor: float | None = None) -> Column:
    """Where market and seeds agree on a clear favourite, moves p towards the market but never away from the favourite."""
    m = F.col("MarketProb")
    better = F.coalesce(F.col("T1_SeedNum") < F.col("T2_SeedNum"), F.lit(False))
    wide = F.coalesce(F.col("AbsSeedDiff") >= gap, F.lit(gap <= 0))
    high, low = wide & better & (m >= edge), wide & ~better & (m <= 1 - edge)
    c = X.clip_prob(p)
    blended = X.clip_prob((1 - weight) * c + weight * m)
    out = F.when(F.coalesce(high, F.lit(False)), F.greatest(c, blended)).when(F.coalesce(low, F.lit(False)), F.least(c, blended)).otherwise(c)
    return X.clip_prob(out if floor is None else both_ways(out, high, low, floor))


def extreme_push(p: Column, intensity: float, curve: tuple[tuple[float, float], ...] = ((0.85, 0.92), (0.90, 0.96), (0.95, 0.99), (0.975, 0.995))) -> Column:
    """Moves strong favourites towards the curve's value; the low side mirrors the high side."""
    c = X.clip_prob(p)
    if intensity <= 0:
        return c

    def target(q: Column) -> Column:
        out = F.lit(curve[-1][1])
        for (x0, y0), (x1, y1) in reversed(list(zip(curve, curve[1:], strict=False))):
            out = F.when(q < x1, (q - x0) * ((y1 - y0) / (x1 - x0)) + y0).otherwise(out)
        return out

    push = lambda q: q + (target(q) - q) * intensity
    return X.clip_prob(F.when(c >= curve[0][0], push(c)).when(c <= 1 - curve[0][0], F.lit(1.0) - push(F.lit(1.0) - c)).otherwise(c))


def tossup_control(p: Column, boost: float, turnover: Column, assist: Column) -> Column:
    edge = F.tanh(-F.coalesce(turnover, F.lit(0.0)) / 0.03 * 0.75 + F.coalesce(assist, F.lit(0.0)) * 0.25)
    return X.clip_prob(F.when(p.between(0.45, 0.55), p + edge * boost).otherwise(p))


def travel_shift(t1_miles: Column, t2_miles: Column, threshold: float = 400.0, per: float = 0.10, most: float = 0.35) -> Column:
    excess = lambda m: F.greatest(F.coalesce(m, F.lit(0.0)) - threshold, F.lit(0.0))
    return F.greatest(F.lit(-most), F.least(F.lit(most), (excess(t2_miles) - excess(t1_miles)) / threshold * per))


def spread_auto(p: Column, floor_at: float, floor: float, override_at: float, override: float) -> dict[str, Column]:
    """Floor, ceiling or override of a pair with a large spread, no weaker than the favourite's market probability."""
    s = F.coalesce(F.col("LastSpread"), F.lit(0.0))
    favourite = F.coalesce(F.when(s < 0, p).when(s > 0, F.lit(1.0) - p), F.lit(0.0))
    f, o = F.greatest(F.lit(floor), favourite), F.greatest(F.lit(override), favourite)
    hard, soft = F.abs(s) >= override_at, (F.abs(s) >= floor_at) & (F.abs(s) < override_at)
    return {"OverrideProb": F.when(hard & (s < 0), o).when(hard & (s > 0), F.lit(1.0) - o), "ProbFloor": F.when(soft & (s < 0), f), "ProbCeil": F.when(soft & (s > 0), F.lit(1.0) - f)}


def apply_postrules(p: Column) -> Column:
    """Shift, then floor, then ceiling, then override, from the columns of those names."""
    shifted = F.when(F.coalesce(F.col("LogitShift"), F.lit(0.0)) != 0, X.logit_shift(p, F.col("LogitShift"))).otherwise(X.clip_prob(p))
    floored = F.greatest(shifted, F.col("ProbFloor"))
    capped = F.least(floored, F.col("ProbCeil"))
    return X.clip_prob(F.coalesce(X.clip_prob("OverrideProb"), capped))


def grid_search(scored: DataFrame, grid: DataFrame, key: str, rule: Column, base: str = "RawProb", label: str = "Label", min_rows: int = 1) -> DataFrame:
    """Mean seasonal Brier score of every parameter set that changes enough rows, and the gain over the base.

    The grid is broadcast, and counted first; each scored row meets it once and partial sums leave the
    scan, a row for each parameter set and season.
    """
    if (sets := grid.count()) > MOST_SETS:
        raise ValueError(f"{sets} parameter sets; search at most {MOST_SETS} at once")
    tried = scored.crossJoin(F.broadcast(grid)).withColumn("_p", rule)
    loss = lambda c: F.pow(F.col(c) - F.col(label), 2)
    seasons = tried.groupBy(key, "Season").agg(F.avg(loss("_p")).alias("b"), F.avg(loss(base)).alias("b0"), F.sum((F.abs(F.col("_p") - F.col(base)) > 1e-12).cast("int")).alias("n"))
    return seasons.groupBy(key).agg(F.avg("b").alias("Brier"), (F.avg("b0") - F.avg("b")).alias("Gain"), F.sum("n").alias("Changed")).where(F.col("Changed") >= min_rows)


@dataclass(frozen=True)
class Rule:
    """A conjunction of threshold conditions."""

    columns: tuple[str, ...]
    operators: tuple[str, ...]
    thresholds: tuple[float, ...]

    @property
    def name(self) -> str:
        return "__".join(f"{c}_{o}_{t:g}" for c, o, t in zip(self.columns, self.operators, self.thresholds, strict=True))

    def mask(self) -> Column:
        return rule_mask(list(self.columns), list(self.operators), list(self.thresholds))


def candidate_rules(grids: dict[str, tuple[float, ...]], pairs: Iterable[str] = (), pair_thresholds: int = 3) -> list[Rule]:
    """Every one-condition rule of the grids, and two-condition rules of the first thresholds of the pair columns."""
    singles = [Rule((c,), (o,), (t,)) for c, ts in grids.items() for t in ts for o in (">=", "<=")]
    doubles = [Rule((a, b), ops, (x, y)) for a, b in combinations([c for c in pairs if c in grids], 2) for x in grids[a][:pair_thresholds] for y in grids[b][:pair_thresholds] for ops in ((">=", ">="), (">=", "<="))]
    return singles + doubles


def mine_rules(train: DataFrame, rules: list[Rule], min_support: float = 0.02, max_support: tuple[float, float] = (0.90, 0.80), min_edge: float = 0.06, most: int = 24, chunk: int = 100) -> DataFrame:
    """Rules by edge times root of support: all are counted in one pass over the rows, in chunks of aggregates.

    Returns rule, conditions, support, target_mean, edge, direction.
    """
    rows = []
    if len(rules) > chunk:  # read once for each chunk
        train = checkpoint(train.select("Label", *sorted({c for r in rules for c in r.columns if c in train.columns})))
    for i in range(0, len(rules), chunk):
        part = rules[i : i + chunk]
        counts = train.agg(F.count("*").alias("n"), F.avg("Label").alias("m"), *(c for k, r in enumerate(part) for c in (F.sum(r.mask().cast("long")).alias(f"s{k}"), F.avg(F.when(r.mask(), F.col("Label"))).alias(f"t{k}"))))
        rows.append(counts.select("n", "m", F.inline(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(len(r.columns)).alias("conditions"), F.col(f"s{k}").alias("s"), F.col(f"t{k}").alias("target_mean")) for k, r in enumerate(part))))))
    every = reduce(DataFrame.unionByName, rows)
    scored = every.select("rule", "conditions", (F.col("s") / F.col("n")).alias("support"), "target_mean", F.abs(F.col("target_mean") - F.col("m")).alias("edge"), F.when(F.col("target_mean") >= F.col("m"), 1).otherwise(-1).alias("direction"))
    ceiling = F.when(F.col("conditions") == 1, max_support[0]).otherwise(max_support[1])
    return scored.where((F.col("support") >= min_support) & (F.col("support") <= ceiling) & (F.col("edge") >= min_edge)).orderBy(F.desc(F.round(F.col("edge") * F.sqrt("support"), 9)), "rule").limit(most)


def rule_features(df: DataFrame, rules: list[tuple[Rule, int, float]]) -> DataFrame:
    """Signed flags of (rule, direction, edge), their counts, largest edges and nets, in one projection."""
    flags = {f"Rule_{i:02d}": r.mask().cast("int") * d for i, (r, d, _) in enumerate(rules)}
    total = lambda d: reduce(lambda a, b: a + b, (r.mask().cast("int") for r, e, _ in rules if e == d), F.lit(0))
    largest = lambda d: F.greatest(F.lit(0.0), F.lit(0.0), *(F.when(r.mask(), F.lit(edge)) for r, e, edge in rules if e == d))
    return df.withColumns(flags | {"RulePositiveCount": total(1), "RuleNegativeCount": total(-1), "RulePositiveEdgeMax": largest(1), "RuleNegativeEdgeMax": largest(-1), "RuleNetCount": total(1) - total(-1), "RuleNetEdge": largest(1) - largest(-1)})
