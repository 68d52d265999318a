"""Filter interaction audit: what each filter removes, finds too late or removes alone, in every order of the filters.

A document's mask holds the filters that it fails. Under an order it goes at the first of them, so the
orders that remove it at step s by filter f are those that begin with s - 1 filters outside its mask and
then f. Orders are numbered by their Lehmer codes, which is lexicographic order, so each such beginning is
one interval of (k - s)! ranks. The documents of a mask are counted once; their number is added where an
interval begins and taken off where it ends, and a prefix sum along the ranks gives every order's count.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import checkpoint, documents, stash

SPACE = r"[\x20\x09-\x0D]+"
#: Tables of all orders and intervals are broadcast; 7 filters have 5,040 orders.
MOST_FILTERS = 7


def text_checks(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides, by letter."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def removal_intervals(k: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, end rank): where the orders of k filters remove a mask at a step."""
    if not 1 <= k <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters can be audited")
    out = []

    def extend(before: list[int], low: int) -> None:
        left = [f for f in range(k) if f not in before]
        width = factorial(len(left) - 1)
        for digit, f in enumerate(left):
            others, first = [g for g in left if g != f], low + digit * width
            for chosen in range(1 << len(others)):
                mask = 1 << f | sum(1 << g for i, g in enumerate(others) if chosen >> i & 1)
                out.append((mask, len(before) + 1, first, first + width))
            if others:
                extend([*before, f], first)

    extend([], 0)
    return out


def order_at(rank: int, k: int) -> list[int]:
    """The order of k filters that has this lexicographic rank."""
    left, out = list(range(k)), []
    for i in range(k - 1, -1, -1):
        digit, rank = divmod(rank, factorial(i))
        out.append(left.pop(digit))
    return out


def mask_counts(docs: DataFrame, labels: DataFrame, checks: dict[str, Column] | None = None) -> DataFrame:
    """Documents by part and mask: (part, mask, n, good, toxic).

    `checks` are conditions on docs, bits 0 and up in their order; the last bit, after them, marks a text
    that a smaller doc_id has, anywhere in the table. Texts are told apart by SHA-256. A null text is
    empty, a null source the part ''. Repeated rows all count, and none is a copy of another with its own
    doc_id; a null doc_id is no copy, makes none, and has no label. Of several labels for a document any
    1 counts. An empty table gives no rows. Only doc_id, text and source are read besides the checks.
    """
    text = F.coalesce("text", F.lit(""))
    checks = text_checks(text) if checks is None else checks
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(checks.values())), F.lit(0))
    copy = 1 << len(checks)
    small, discard = stash(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), bits.alias("bits"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")))
    known = small.where("doc_id is not null")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("quality <=> 1").cast("int")).alias("good"), F.max(F.expr("toxic <=> 1").cast("int")).alias("toxic"))
    masked = known.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left").select("part", F.when(F.col("first"), F.col("bits")).otherwise(F.col("bits") + copy).alias("mask"), "good", "toxic")
    loose = small.where("doc_id is null").select("part", F.col("bits").alias("mask"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    counts = checkpoint(
        masked.unionByName(loose).groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).cast("long").alias("toxic"))
    )  # at most 2**k rows for each part
    discard()
    return counts


def audit(counts: DataFrame, names: str) -> DataFrame:
    """One row for each part, order and step from (part, mask, n, good, toxic), zeros included.

    `names` gives the filters' letters in the order of the mask's bits. Of a step's filter it tells
    `removed` and `kept` documents, `redundant` ones (failing it, gone before), `unique_fails` (failing it
    alone, whatever the order), the labelled losses, and `shapley`, its removals over all orders.
    """
    spark, k = counts.sparkSession, len(names)
    ranks = factorial(k)
    spans = F.broadcast(spark.createDataFrame(removal_intervals(k), "mask int, step int, low int, high int"))
    steps = [(r, s + 1, f, "".join(names[g] for g in order)) for r in range(ranks) for order in [order_at(r, k)] for s, f in enumerate(order)]
    orders = F.broadcast(spark.createDataFrame(steps, "rank int, step int, filter int, filter_order string"))

    what = ("n", "good", "toxic")
    edge = lambda at, sign: F.struct(F.col(at).alias("rank"), *[(F.col(c) * sign).alias(c) for c in what])
    edges = counts.join(spans, "mask").select("part", "step", F.explode(F.array(edge("low", 1), edge("high", -1))).alias("e")).select("part", "step", "e.*").where(F.col("rank") < ranks)
    each = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step")).select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("rank"), *[F.lit(0).cast("long").alias(c) for c in what])
    along = Window.partitionBy("part", "step").orderBy("rank")
    sums = edges.unionByName(each).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in what])
    gone = sums.select("part", "step", "rank", *[F.sum(c).over(along).alias(c) for c in what]).join(orders, ["rank", "step"])

    bits = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: F.expr("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), f)) != 0)
    failing = counts.select("part", "n", F.size(bits).alias("held"), F.explode(bits).alias("filter")).groupBy("part", "filter").agg(F.sum("n").alias("fails"), F.sum(F.when(F.col("held") == 1, F.col("n")).otherwise(0)).alias("alone"))
    of_part = counts.groupBy("part").agg(F.sum("n").alias("all"))
    down = Window.partitionBy("part", "rank").orderBy("step")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return gone.join(of_part, "part").join(failing, ["part", "filter"], "left").select(
        "part",
        "filter_order",
        "step",
        (F.col("all") - F.sum("n").over(down)).alias("kept"),
        F.col("n").alias("removed"),
        (zero("fails") - F.col("n")).alias("redundant"),
        zero("alone").alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = mask_counts(documents(spark, sf_dir).select("doc_id", "text", "source"), documents(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
    return audit(counts, "ABCDE")


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS head FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, len(ws) < 50 AS A, 100 * len(list_distinct(ws)) < 65 * len(ws) AS B, 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) AS C,
         regexp_matches(t, '[#$%&*|]') AS D, doc_id IS NOT NULL AND doc_id > head AS E, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l USING (doc_id)),
c AS (
  SELECT part, concat(CASE WHEN A THEN 'A' ELSE '' END, CASE WHEN B THEN 'B' ELSE '' END, CASE WHEN C THEN 'C' ELSE '' END, CASE WHEN D THEN 'D' ELSE '' END, CASE WHEN E THEN 'E' ELSE '' END) AS fails,
         count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM f GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) t),
r AS (
  SELECT part, filter_order, step, letter,
         sum(CASE WHEN NOT contains(fails, letter) AND NOT gone THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN contains(fails, letter) AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN contains(fails, letter) AND gone THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN contains(fails, letter) AND NOT gone THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN contains(fails, letter) AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT c.*, s.*, before <> '' AND regexp_matches(fails, '[' || before || '0]') AS gone FROM c, s) t GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r
"""
