"""Benchmark decontamination by winnowing, in DataFrame functions only.

Both sides hash their 5-word grams and keep the least of every 6 neighbours. A shared span of
10 words has 6 grams in common, so both sides keep the least of them: no such span is missed.
Documents that share a fingerprint with the benchmark are extended: each of their windows is
compared with the benchmark's windows as a whole.

A null text has no words. Items of fewer than `width` words are one window of all their words;
documents offer all spans of those lengths, without winnowing. Rows that share a doc_id are
told apart by their text.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import checkpoint, documents, let

GRAM = 5
#: Rows up to which a side is broadcast, after counting them; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _word_hashes(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.transform(F.filter(F.split(lower, _BREAK), lambda w: w != ""), lambda w: F.xxhash64(w))


def _positions(hashes: Column, width: int, use, kind: str = "bigint") -> Column:
    """use(position) at each start of a `width`-word span; an empty array if there is none."""
    spans = F.transform(F.sequence(F.lit(0), F.size(hashes) - width), use)
    return F.when(F.size(hashes) >= width, spans).otherwise(F.array().cast(f"array<{kind}>"))


def _fingerprints(hashes: Column, width: int) -> Column:
    """The least gram hash of every window of `width` words, each once."""
    span = width - GRAM + 1
    grams = _positions(hashes, GRAM, lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(GRAM))))
    return F.array_distinct(let(grams, lambda g: _positions(g, span, lambda i: F.least(*(F.get(g, i + j) for j in range(span))))))


def _window(hashes: Column, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), F.slice(hashes, at + 1, width))


def _small(df: DataFrame) -> DataFrame:
    """df, cut from its lineage, and marked for broadcast if a count proves it small."""
    df = checkpoint(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Finds the words of documents inside any occurrence of a benchmark window.

    docs (doc_id, text, ...), benchmark (item_id, text). Returns doc_id, n_words, n_hit,
    n_items, items_sha256, contaminated and rid, the row's hash. An empty benchmark hits nothing.
    """
    items = checkpoint(benchmark.select(F.col("item_id").cast("string").alias("item"), _word_hashes(F.col("text")).alias("h")).where(F.size("h") > 0))
    short = sorted(r.n for r in items.where(F.size("h") < width).select(F.size("h").alias("n")).distinct().collect())  # fewer than `width` numbers
    keys = _fingerprints(F.col("h"), width)
    tails = [_tail(m) for m in short]
    marks = _small(items.where(F.size("h") >= width).select(F.explode(keys).alias("key")).union(items.where(F.size("h") < width).select(F.xxhash64(F.size("h"), "h"))).distinct())
    windows = checkpoint(
        items.select("item", F.explode(_positions(F.col("h"), width, lambda i: _window(F.col("h"), i, width))).alias("w"))
        .union(items.where(F.size("h") < width).select("item", F.xxhash64(F.size("h"), "h")))
        .distinct()
    )

    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"))
    hashed = texts.select("rid", _word_hashes(F.col("text")).alias("h"))
    found = hashed.select("rid", F.explode(F.concat(keys, *tails)).alias("key")).join(marks, "key", "left_semi")
    suspects = _small(found.select("rid").distinct())
    spans = F.concat(*(_spans(m) for m in [width, *short]))
    near = texts.join(suspects, "rid", "left_semi").dropDuplicates(["rid"]).select("rid", _word_hashes(F.col("text")).alias("h"))
    extended = checkpoint(near.select("rid", F.inline(spans)).join(windows.select("w").distinct(), "w", "left_semi"))
    cover = F.aggregate(
        F.array_sort(F.collect_set(F.struct("a", "b"))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["b"]).alias("end")),
    )["n"]
    hits = extended.groupBy("rid").agg(cover.alias("n_hit"))
    matched = extended.select("rid", "w").distinct().join(windows, "w").groupBy("rid").agg(F.collect_set("item").alias("items"))
    none = F.expr("cast(array() as array<string>)")
    return (
        texts.select("doc_id", "rid", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_WORD)).cast("long").alias("n_words"))
        .join(hits.join(matched, "rid"), "rid", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
            F.sha2(F.array_join(F.array_sort(F.coalesce("items", none)), ","), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
            "rid",
        )
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows and columns of docs that hold no window of the benchmark."""
    found = _small(decontaminate(docs, benchmark, width).where("contaminated").select(F.col("rid").alias("_rid")).distinct())
    packed = docs.select(F.xxhash64("doc_id", "text").alias("_rid"), F.struct(*docs.columns).alias("_doc"))
    return packed.join(found, "_rid", "left_anti").select("_doc.*")


def _tail(m: int) -> Column:
    return _positions(F.col("h"), m, lambda i: _window(F.col("h"), i, m))


def _spans(m: int) -> Column:
    return _positions(F.col("h"), m, lambda i: F.struct(i.alias("a"), (i + m).alias("b"), _window(F.col("h"), i, m).alias("w")), "struct<a:int,b:int,w:bigint>")


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark")).drop("rid")
