"""Helpers shared by the operators: lineage cuts, connected components, row numbers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session without that setting gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            path = tempfile.mkdtemp(prefix="courtline-checkpoint-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint."""
    folder(df.sparkSession)
    return df.checkpoint()


def stash(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """Writes df as Parquet into the checkpoint folder; returns the table and what deletes it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), lambda: remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this session wrote."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sieve(df: DataFrame, key: str, wanted: DataFrame, bits: int = 24) -> DataFrame:
    """Drops most rows of df whose key is not in `wanted`, before a join shuffles them.

    The wanted keys set bits of a map of 2**bits bits, which is broadcast as at most
    2**(bits - 6) words whatever the input's size. Other keys may pass, so the join still
    decides; with very many wanted keys everything passes. `wanted` is evaluated once more
    and should be cut from its lineage. Join inner with distinct keys afterwards: a semi join
    would be planned below the map.
    """
    at = f"(xxhash64(`{key}`) & {(1 << bits) - 1}L)"
    words = wanted.select(F.expr(f"{at} >> 6").alias("_word"), F.expr(f"shiftleft(1L, cast({at} & 63 as int))").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_mask"))
    marked = df.withColumn("_word", F.expr(f"{at} >> 6")).join(F.broadcast(words), "_word")
    return marked.where(F.expr(f"(shiftrightunsigned(_mask, cast({at} & 63 as int)) & 1L) = 1L")).drop("_word", "_mask")


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(links: DataFrame) -> DataFrame:
    """Distributed union-find: (node, component), the least node that links (u, v) reach.

    Alternates large-star and small-star rounds; each round is two joins on the node, and
    only a count and a sum of the links come to the driver. Nodes without links are absent.
    """
    edges = checkpoint(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        best = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(best, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = checkpoint(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            heads = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)
        seen = now


def numbered(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """Adds gapless row numbers from 0 in the given total order, and tells how many rows there are.

    Rows are dealt by range, so that no task holds more than its share; per-partition counts
    (one row for each partition) give the offsets.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    split = checkpoint(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = split.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row for each partition
    out = split.join(F.broadcast(starts), part == F.col("_p")).withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.drop("_at", "_p", "_start"), split.count()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluates `value` once for each row, however often `use` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)
