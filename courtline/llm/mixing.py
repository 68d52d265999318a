"""Mixing sources to target weights.

Sizes are summed for each source; targets share a budget by weight, no source above `most`
times its size. A source's repetition rate is its target over its size: every document is
emitted floor(rate) times, and once more if a seeded hash of it falls below the fraction. The
fraction counts words, not documents: the cut lies where the words of the documents below it come
nearest to what the source still needs, so that long documents don't carry a small source away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import checkpoint, documents, numbered

#: Sources up to which their table is broadcast, after counting them.
BROADCAST_SOURCES = 100_000
#: Bits of a draw that are settled at once, and series of draws that are tried.
DIGIT, TURNS = 12, 8


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from (source, size): the budget is `share` of all sizes.

    Sources by code point, null last, take the weights in turn. Sources that would pass
    `most` times their size stop there and the rest is shared anew, until none is above.
    Each turn brings four sums to the driver.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    table, count = numbered(per_source, [F.col("source").asc_nulls_last()], "_i")
    table = checkpoint(table.select("source", "source_size", (F.col("source_size") * most).alias("cap"), F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_i") % len(weights) + 1).cast("int")).alias("w")))
    total, weight = table.agg(F.sum("source_size"), F.sum("w")).first()
    level, stopped = (share * total / weight, 0) if weight else (0.0, 0)
    while weight:
        above = F.col("cap") <= F.lit(level) * F.col("w")
        now, held, free = table.agg(F.count(F.when(above, 1)), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("w")))).first()
        if now == stopped or not free:
            break
        stopped, level = now, (share * total - (held or 0.0)) / free
    return table.select("source", "source_size", F.least("cap", F.lit(level) * F.col("w")).alias("target"))


def _draw(seed: int, turn: Column, row: Column) -> Column:
    """A uniform draw of 3 * DIGIT bits for a row's hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), turn.cast("int"), row), 64 - 3 * DIGIT)


def _marked(table: DataFrame) -> DataFrame:
    """table, marked for broadcast if a count proves it small."""
    return F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table


def draw_cuts(keys: DataFrame, needs: DataFrame, seed: int) -> DataFrame:
    """source, _turn and _cut: of each source, documents whose draw is below _cut hold about `need` words.

    keys (source, size, row), needs (source, need). The sum of sizes below a draw is found digit
    by digit from sums for each value of a digit, so no source is ordered in one task. Of TURNS
    series of draws the one whose sum comes nearest is taken, the first of equals.
    """
    turns = keys.join(_marked(needs), "source").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(TURNS - 1)))).withColumn("draw", _draw(seed, F.col("turn"), F.col("row")))
    rows = turns.select("source", "turn", "need", "size", "draw")
    state = None
    for digit in (2, 1, 0):
        part = F.shiftright("draw", digit * DIGIT)
        if state is None:
            inside = rows.withColumn("below", F.lit(0).cast("long"))
        else:
            inside = rows.join(_marked(state), ["source", "turn"]).where(F.shiftright("draw", (digit + 1) * DIGIT) == F.col("prefix"))
        summed = inside.groupBy("source", "turn", "need", "below", part.alias("prefix")).agg(F.sum("size").alias("size"))
        order = Window.partitionBy("source", "turn").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)  # at most 2**DIGIT rows
        run = summed.withColumn("above", F.col("below") + F.sum("size").over(order))
        at = F.when(F.col("above") >= F.col("need"), F.col("prefix"))
        first = run.withColumn("at", F.coalesce(F.min(at).over(Window.partitionBy("source", "turn")), F.max("prefix").over(Window.partitionBy("source", "turn")))).where("prefix = at")
        state = checkpoint(first.select("source", "turn", F.col("need").alias("_need"), "prefix", (F.col("above") - F.col("size")).alias("below"), "above"))
    take_less = F.col("_need") - F.col("below") <= F.col("above") - F.col("_need")
    found = state.select("source", F.struct(F.when(take_less, F.col("_need") - F.col("below")).otherwise(F.abs(F.col("above") - F.col("_need"))).alias("off"), "turn", F.when(take_less, F.col("prefix")).otherwise(F.col("prefix") + 1).alias("cut")).alias("best"))
    return found.groupBy("source").agg(F.min("best").alias("best")).select("source", F.col("best.turn").alias("_turn"), F.col("best.cut").alias("_cut"))


def _mixed(docs: DataFrame, seed: int = 17, **params) -> DataFrame:
    """(_doc, _size, _source_size, _target, _copies): the rows packed, so that no column of theirs can clash."""
    packed = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_doc"))
    sized = packed.select("_doc", F.struct("source").alias("_name"), word_count(F.col("text")).alias("_size"), F.xxhash64("doc_id", "text").alias("_row"))  # a struct is never null, so a null source joins like any other
    keys = checkpoint(sized.select(F.col("_name").alias("source"), F.col("_size").alias("size"), F.col("_row").alias("row")))
    targets = checkpoint(source_targets(keys.select("source.source", "size"), **params))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = targets.select(F.struct("source").alias("source"), "source_size", "target", F.floor(rate).cast("int").alias("whole"), ((rate - F.floor(rate)) * F.col("source_size")).alias("need"))
    cuts = draw_cuts(keys, rated.select("source", "need"), seed)
    table = checkpoint(rated.join(cuts, "source", "left").select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "whole", "_turn", "_cut"))
    drawn = _draw(seed, F.col("_turn"), F.col("_row")) < F.col("_cut")
    copies = F.when(F.col("_source_size") > 0, F.col("whole") + F.when(drawn, 1).otherwise(0)).otherwise(0).cast("int")
    return sized.join(_marked(table), F.col("_name") == F.col("_source"), "left").select("_doc", "_size", "_source_size", "_target", copies.alias("_copies"))


def mix(docs: DataFrame, seed: int = 17, **params) -> DataFrame:
    """All rows and columns of docs (doc_id, text, source, ...) with _size, _source_size, _target and _copies (columns of these names are replaced).

    Every document is taken floor(rate) times and once more if its draw is below its source's
    cut. A null text has no words; a source without words is not taken. The draw depends on seed,
    doc_id and text alone, so reruns agree and repeated rows are taken alike. An empty table
    gives no rows.
    """
    new = ("_size", "_source_size", "_target", "_copies")
    return _mixed(docs, seed, **params).select(*(F.col("_doc")[c].alias(c) for c in docs.columns if c not in new), *new)


def emit(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: every row of docs as many times as it is taken."""
    mixed = _mixed(docs, **params).where("_copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"))
