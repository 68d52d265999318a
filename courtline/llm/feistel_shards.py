"""Sharding by a Feistel permutation with cycle walking, in DataFrame functions only.

Every row has a global number. A keyed permutation of 0..n-1 gives its place in the shuffle;
shard and slot are the remainder and quotient of the place, so any of them can be computed
from the number alone, and shards differ by one row at most.

The permutation works on a grid of about sqrt(n) by sqrt(n): rounds add a hash of one
coordinate to the other. Places past the end of the table walk on through the permutation
until they fall inside; no walk can be longer than the number of places past the end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import documents, let, numbered

ROUNDS = 6


def _permute(x: Column, rows: int, columns: int, seed: int) -> Column:
    """One pass over the grid: a bijection of 0..rows*columns-1."""

    def step(acc: Column, i: Column) -> Column:
        turn = lambda value, other, size: F.pmod(value + F.pmod(F.xxhash64(F.lit(seed), i, other), F.lit(size)), F.lit(size))
        down = F.struct(turn(acc["l"], acc["r"], rows).alias("l"), acc["r"].alias("r"))
        across = F.struct(acc["l"].alias("l"), turn(acc["r"], acc["l"], columns).alias("r"))
        return F.when(i % 2 == 0, down).otherwise(across)

    start = F.struct(F.floor(x / columns).cast("long").alias("l"), (x % columns).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: acc["l"] * F.lit(columns) + acc["r"])


def feistel_place(number: Column, n: int, seed: int) -> Column:
    """The place of a row number in a shuffle of n rows, n below 2**53."""
    n = max(n, 1)
    rows = math.isqrt(n - 1) + 1
    columns = -(-n // rows)
    number = number.cast("long")
    walk = lambda y: F.aggregate(F.sequence(F.lit(1), F.lit(max(1, rows * columns - n))), y, lambda acc, _: F.when(acc < n, acc).otherwise(_permute(acc, rows, columns, seed)))
    return let(_permute(number, rows, columns, seed), lambda y: F.when(y < n, y).otherwise(walk(y)))


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 20_240_601, keep: tuple[str, ...] = ()) -> DataFrame:
    """Deals all rows into shards whose counts differ by one at most.

    Row numbers follow doc_id (null first), then checksum and size, so the result does not
    depend on how the table is stored; rows that are equal in all three are told apart by a hash
    of the columns in `keep`, or else interchangeable. An empty table gives no rows.
    A null text has no bytes. Returns doc_id, size, text_crc32, law, shard, slot, grown_shard
    and the columns in `keep`.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *keep)
    rows, n = numbered(base, [F.col("doc_id"), F.col("text_crc32"), F.col("size"), *([F.xxhash64(*keep)] if keep else [])], "_number")  # texts are no sort keys: samples of these go to the driver
    return rows.withColumn("_place", feistel_place(F.col("_number"), n, seed)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.floor(F.col("_place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *keep,
    )


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(documents(spark, sf_dir).select("doc_id", "text"))
