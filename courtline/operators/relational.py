"""The relational kit: joins, aggregates, windows and ordered selections used by every feature job.

Keys that are null never match and never form a group here, so callers need not filter them;
every order that decides something is total.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import checkpoint

#: Rows up to which a lookup table is broadcast, when its size was counted.
BROADCAST_ROWS = 200_000
#: Blocks of a period's rows at most where all its pairs are made.
BLOCKS = 32


def drop_missing_keys(df: DataFrame, keys: list[str], to: str = "bigint") -> DataFrame:
    """Rows whose keys are all numbers, with the keys as integers."""
    typed = df.withColumns({k: F.expr(f"try_cast(try_cast(`{k}` AS double) AS {to})") for k in keys})
    return typed.dropna(subset=keys)


# Joins


def join_left_chain(base: DataFrame, others: list[DataFrame], keys: list[str]) -> DataFrame:
    """Left joins on one key; every side is grouped by it already or is shuffled once."""
    return reduce(lambda a, b: a.join(b, keys, "left"), others, base)


def join_twice_prefixed(pairs: DataFrame, features: DataFrame, period: str = "Season", key: str = "TeamID", left: str = "T1", right: str = "T2") -> DataFrame:
    """Features of both sides with the sides' names as prefixes."""
    out = pairs
    for side in (left, right):
        named = features.select(F.col(period), F.col(key).alias(side), *(F.col(c).alias(f"{side}_{c}") for c in features.columns if c not in (period, key)))
        out = out.join(named, [period, side], "left")
    return out


def join_common_opponents(log: DataFrame) -> DataFrame:
    """Per (Season, T1 < T2): opponents both have met, with mean gaps of margin and win rate.

    The log is reduced to a row for each (Season, team, opponent) before it meets itself.
    """
    met = log.groupBy("Season", "TeamID", "OppID").agg(F.avg("Margin").alias("m"), F.avg("Win").alias("w"))
    a, b = met.alias("a"), met.alias("b")
    both = a.join(b, (F.col("a.Season") == F.col("b.Season")) & (F.col("a.OppID") == F.col("b.OppID")) & (F.col("a.TeamID") < F.col("b.TeamID")))
    both = both.where("a.OppID <> a.TeamID and a.OppID <> b.TeamID")
    return both.groupBy(F.col("a.Season").alias("Season"), F.col("a.TeamID").alias("T1"), F.col("b.TeamID").alias("T2")).agg(
        F.count("*").alias("CommonOppCount"), F.avg(F.col("a.m") - F.col("b.m")).alias("CommonOppMarginDiff"), F.avg(F.col("a.w") - F.col("b.w")).alias("CommonOppWinPctDiff")
    )


def join_asof_latest(df: DataFrame, keys: list[str], time: str, cutoff: Column | int, tie: list[str]) -> DataFrame:
    """The latest row of each key with time <= cutoff."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc(), *(F.col(t) for t in tie))
    return df.where(F.col(time) <= cutoff).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def join_pairs(ids: DataFrame, period: str = "Season", key: str = "TeamID") -> DataFrame:
    """All unordered pairs of a period's ids: T1 < T2."""
    return pair_rows(ids.select(period, key).distinct(), period, key)


def pair_rows(rows: DataFrame, period: str = "Season", key: str = "TeamID", known: DataFrame | None = None, block: int = 512, dealt: bool = False) -> DataFrame:
    """All pairs of a period's rows (one a key), T1 < T2, with the other columns as T1_<c> and T2_<c>; pairs are never shuffled.

    Rows are numbered by key and dealt into blocks of at least `block`, BLOCKS a period at most. Each left row meets each block of right rows at
    its own or a later place once, and is spread over them within the task, so a task holds one block and a row is shuffled at most BLOCKS + 1 times.
    known: Season, T1, T2 and values for some pairs (one row a pair), which come as the struct _known, null for the others.
    dealt: the blocks' places stay as _i and _j, for groupings that need no shuffle as all rows of a pair of keys are in one task; a key may
    then have several rows a period, and tasks are as many as keep each to some 4 million pairs.
    """
    others = [c for c in rows.columns if c not in (period, key)]
    side = lambda t: [F.col(key).alias(t), *(F.col(c).alias(f"{t}_{c}") for c in others)]
    w = Window.partitionBy(period)
    size = F.lit(block) if dealt else F.greatest(F.lit(block), F.ceil(F.max("_b").over(w) / BLOCKS))
    numbered = rows.dropna(subset=[period, key]).withColumn("_b", F.dense_rank().over(w.orderBy(key)))
    placed = checkpoint(numbered.withColumn("_b", F.floor((F.col("_b") - 1) / size).cast("int")).withColumn("_last", F.max("_b").over(w)))
    left = placed.select(period, F.col("_b").alias("_i"), F.explode(F.sequence("_b", "_last")).alias("_j"), *side("T1"))
    blocks = placed.groupBy(period, F.col("_b").alias("_j")).agg(F.collect_list(F.struct(*side("T2"))).alias("_right"))
    right = blocks.select(period, F.explode(F.sequence(F.lit(0), F.col("_j"))).alias("_i"), "_j", "_right")
    if known is not None:
        values = F.struct("T2", F.struct(*(c for c in known.columns if c not in (period, "T1", "T2"))).alias("v"))
        by_block = known.join(placed.select(period, F.col(key).alias("T2"), F.col("_b").alias("_j")), [period, "T2"])
        left = left.join(by_block.groupBy(period, "T1", "_j").agg(F.collect_list(values).alias("_some")), [period, "T1", "_j"], "left")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * rows.sparkSession.sparkContext.defaultParallelism)
    if dealt:
        met_blocks = placed.groupBy(period).agg(F.max("_last").cast("long").alias("n")).agg(F.coalesce(F.sum((F.col("n") + 1) * (F.col("n") + 2) / 2), F.lit(0.0))).first()[0]
        parts = max(parts, int(met_blocks * block * block / 4e6))
    at = [period, "_i", "_j"]
    met = left.repartition(parts, *at).join(right.repartition(parts, *at), at)  # dealt by number, as adaptive execution would merge these few rows into too few tasks
    spread = met.select(*(at if dealt else [period]), "T1", *(f"T1_{c}" for c in others), *(["_some"] if known is not None else []), F.explode("_right").alias("_r")).where("T1 < _r.T2")
    own = [F.get(F.filter("_some", lambda s: s["T2"] == F.col("_r.T2")), F.lit(0))["v"].alias("_known")] if known is not None else []
    return spread.select(*(at if dealt else [period]), "T1", "_r.T2", *(f"T1_{c}" for c in others), *(f"_r.T2_{c}" for c in others), *own)


def join_longest_prefix(names: DataFrame, name: str, aliases: DataFrame, alias: str) -> DataFrame:
    """For each name the longest alias that is a prefix of its tokens: an equi join on exploded prefixes."""
    tokens = F.split(name, " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda n: F.array_join(F.slice(tokens, 1, n), " "))
    spread = names.select(name).distinct().withColumn("_p", F.explode(prefixes))
    hit = spread.join(aliases, F.col("_p") == F.col(alias))
    w = Window.partitionBy(name).orderBy(F.length(alias).desc(), F.col(alias))
    return hit.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_p")


def flag_membership(df: DataFrame, keys: list[str], members: DataFrame, flag: str) -> DataFrame:
    """0/1 whether the key is among the members."""
    return df.join(members.select(*keys).distinct().withColumn(flag, F.lit(1)), keys, "left").withColumn(flag, F.coalesce(flag, F.lit(0)))


# Aggregates


def last_non_null(column: str, *order: Column) -> Column:
    """The value of the last row in this order that has one."""
    return F.max_by(F.when(F.col(column).isNotNull(), F.col(column)), F.when(F.col(column).isNotNull(), F.struct(*order)))


def weighted_mean(value: Column, weight: Column, floor: float = 1.0) -> Column:
    """Sum of w * x over sum of w, with weights of at least `floor`."""
    w = F.greatest(F.coalesce(weight, F.lit(floor)), F.lit(floor))
    return F.try_divide(F.sum(w * value), F.sum(F.when(value.isNotNull(), w)))


def sorted_concat(column: str, sep: str = "|") -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), sep)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal bins, left-closed, the last one closed; empty bins are kept."""
    width = (high - low) / bins
    inside = F.col(column).between(low, high)
    at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(inside).groupBy(at.alias("bin")).count()
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


# Windows


def zscore(column: str, period: str = "Season", floor: float = 0.1) -> Column:
    """(x - mean) / max(sd, floor) within the period; sd of one row is null and stays null."""
    w = Window.partitionBy(period)
    sd = F.stddev_samp(column).over(w)
    return (F.col(column) - F.avg(column).over(w)) / F.when(sd.isNotNull(), F.greatest(sd, F.lit(floor)))


def rank_pct_average(column: str, *keys: str) -> Column:
    """Average-rank percentile: ties share their mean rank, divided by the number of values."""
    ordered, every = Window.partitionBy(*keys).orderBy(F.col(column).asc_nulls_last()), Window.partitionBy(*keys)
    ties = Window.partitionBy(*keys, column)
    mean_rank = F.rank().over(ordered) + (F.count(column).over(ties) - 1) / 2
    return F.when(F.col(column).isNotNull(), mean_rank / F.count(column).over(every))


def recency(keys: list[str], day: str = "DayNum", tie: str = "GameID") -> Column:
    """1 for the latest row of the key."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(day).desc(), F.col(tie).desc()))


def last_n(df: DataFrame, n: int, keys: list[str], day: str = "DayNum", tie: str = "GameID") -> DataFrame:
    return df.withColumn("_rn", recency(keys, day, tie)).where(F.col("_rn") <= n)


def lookback_days(df: DataFrame, days: int, period: str = "Season", day: str = "DayNum") -> DataFrame:
    """Rows of the last `days` days of their period; the period's last day comes from one small aggregate."""
    last = df.groupBy(period).agg(F.max(day).alias("_last"))
    return df.join(F.broadcast(last), period).where(F.col(day) >= F.col("_last") - days).drop("_last")  # a row for each period


def prior_sum(column: str, keys: list[str], order: str) -> Column:
    """The running sum without the current row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(w), F.lit(0))


def streaks(df: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """Length of the run of consecutive periods with the same value, and whether the value changed."""
    w = Window.partitionBy(key).orderBy(period)
    same = (F.lag(value).over(w) == F.col(value)) & (F.lag(period).over(w) == F.col(period) - 1)
    marked = df.withColumn("_break", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("Changed", F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(0)))
    island = marked.withColumn("_island", F.sum("_break").over(w))
    return island.withColumn("Streak", F.row_number().over(Window.partitionBy(key, "_island").orderBy(period))).drop("_break", "_island")


def keep_last(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key, the last in a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def exact_quantiles(rows: DataFrame, column: str, probs: list[float], out: str = "q") -> DataFrame:
    """One row with an array of the column's exact quantiles, interpolated between neighbours; null values don't count.

    Values alone are dealt by range and numbered through counts of the partitions; the two neighbours of each quantile are looked
    up by number, so no task holds more than its range. Without a value all are null.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    values = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_v"))
    split = checkpoint(values.repartitionByRange(parts, "_v").sortWithinPartitions("_v").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = split.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))  # a row for each partition
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"))
    asked = total.select(F.inline(F.array(*(F.struct(F.lit(i).alias("_i"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("_r")) for i, p in enumerate(probs)))))
    low = F.floor("_r").cast("long")
    share = F.col("_r") - low
    ends = asked.select("_i", F.inline(F.array(F.struct(low.alias("_k"), (F.lit(1.0) - share).alias("_w")), F.struct((low + 1).alias("_k"), share.alias("_w"))))).where("_w > 0")  # two rows for each quantile
    numbered = split.join(F.broadcast(starts), part == F.col("_p")).select("_v", (F.col("_s") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("_k"))
    found = numbered.join(F.broadcast(ends), "_k").groupBy("_i").agg(F.sum(F.col("_v") * F.col("_w")).alias("_q"))
    pick = lambda i: F.max(F.when(F.col("_i") == i, F.col("_q")))
    return found.agg(F.array(*(pick(i) for i in range(len(probs)))).alias(out))


def counted_quantiles(values: DataFrame, column: str, count: str, probs: list[float], out: str = "q") -> DataFrame:
    """exact_quantiles of a column whose values come once each, with how often they occur; what is ordered are the different values."""
    parts = max(1, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    known = values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_v"), F.col(count).alias("_n"))
    split = checkpoint(known.repartitionByRange(parts, "_v").withColumn("_p", F.spark_partition_id()))
    sizes = split.groupBy("_p").agg(F.sum("_n").alias("_s"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("_s").over(before(Window.orderBy("_p"))), F.lit(0)).alias("_s"))  # a row for each partition
    inside = F.coalesce(F.sum("_n").over(before(Window.partitionBy("_p").orderBy("_v"))), F.lit(0))
    numbered = split.withColumn("_a", inside).join(F.broadcast(starts), "_p").select("_v", (F.col("_s") + F.col("_a")).alias("_from"), (F.col("_s") + F.col("_a") + F.col("_n")).alias("_to"))
    rank = F.col("_total") * 1.0 - 1.0
    total = sizes.agg(F.coalesce(F.sum("_s"), F.lit(0)).alias("_total"))
    asked = total.select(F.inline(F.array(*(F.struct(F.lit(i).alias("_i"), (rank * float(p)).alias("_r")) for i, p in enumerate(probs)))))
    low = F.floor("_r").cast("long")
    share = F.col("_r") - low
    ends = asked.select("_i", F.inline(F.array(F.struct(low.alias("_k"), (F.lit(1.0) - share).alias("_w")), F.struct((low + 1).alias("_k"), share.alias("_w"))))).where("_w > 0")
    found = numbered.join(F.broadcast(ends), (F.col("_k") >= F.col("_from")) & (F.col("_k") < F.col("_to"))).groupBy("_i").agg(F.sum(F.col("_v") * F.col("_w")).alias("_q"))  # two rows for each quantile
    pick = lambda i: F.max(F.when(F.col("_i") == i, F.col("_q")))
    return found.agg(F.array(*(pick(i) for i in range(len(probs)))).alias(out))
