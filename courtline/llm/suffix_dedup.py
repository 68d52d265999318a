"""Suffix-array dedup by a depth-limited radix sort.

Suffixes are ordered through their first `width` bytes only, by most-significant-digit
passes; suffixes that stay equal to the end are the repeated windows.

* Pass 1 deals the suffixes by a digit that every window chooses from its own bytes: the
  least hash of its 24-byte grams. Equal windows choose the same digit, and neighbours that
  share it travel as one row (a segment), so the corpus is never exploded to a row a byte.
* Buckets with one occurrence hold no repeat and are dropped. A segment that occurs twice as
  a whole settles all its suffixes.
* Segments left over in a bucket are ordered on by digits of 40 bytes, most significant
  first, dropping suffixes that stand alone after each pass (`_radix_groups`).
* If a bucket has more distinct segments than a task takes, the buckets with so many rows are
  not held by one task each: their suffixes are dealt out by the rest of the window as one
  digit and grouped by Spark (`_deal_out`).

Rows that share a doc_id are told apart by their text. A null text counts as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textcore as T
from .store import checkpoint, documents

GRAM = 24
DIGIT = 40
#: A bucket of no more distinct segments stays together in a task, larger ones are dealt out.
TASK_SEGMENTS = 20_000
#: Segments of several buckets that are collected before they are ordered.
HELD_SEGMENTS = 5_000


def _scan(width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in T.text_chunks(batches):
            s = T.segments(data.astype(np.uint64) + np.uint64(1), off, width, GRAM)
            yield pa.RecordBatch.from_arrays(
                [T.take_row(rows, "rid", s["row"]), pa.array((s["start"] - off[s["row"]]).astype(np.int32)), pa.array(s["n"].astype(np.int16 if width < 30_000 else np.int32)).cast(pa.int32()), pa.array(s["bucket"]), pa.array(s["seg"])],
                names=["rid", "start", "n", "bucket", "seg"],
            )

    return scan


def _contents(width: int):
    """The bytes of the segments that are listed for each row."""

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.utf8_parts(batch.column("text"))
            for i, parts in enumerate(batch.column("parts").to_pylist()):
                raw = data[off[i] : off[i + 1]].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p["bucket"] for p in parts], pa.int64()), pa.array([p["seg"] for p in parts], pa.int64()), pa.array([p["copies"] for p in parts], pa.int64()), pa.array([p["hot"] for p in parts], pa.bool_()), pa.array([raw[p["start"] : p["start"] + p["n"] + width - 1] for p in parts], pa.binary())],
                    names=["bucket", "seg", "copies", "hot", "content"],
                )

    return contents


def _radix_groups(bucket: np.ndarray, sums: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Which suffixes (by their start in the hashed bytes) share all `width` bytes with another of their bucket.

    One pass for each digit: the group so far and the next digit make the new group; a suffix
    that is alone in its group is done.
    """
    live, group = np.arange(len(start)), bucket.view(np.uint64)
    for depth in range(0, width, DIGIT):
        at = start[live] + depth
        digit = T.span_hash(sums, at, at + min(DIGIT, width - depth))
        _, group, count = np.unique(T.mix(group * np.uint64(31) ^ digit), return_inverse=True, return_counts=True)
        keep = count[group] > 1
        live, group = live[keep], group[keep].astype(np.uint64)
        if not len(live):
            break
    repeated = np.zeros(len(start), bool)
    repeated[live] = True
    return repeated


def _suffixes(content: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums of the joined segments; the segment, the place in it and the start of every suffix."""
    data, off = np.frombuffer(b"".join(content), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in content])))
    sums = T.prefix_sums(data.astype(np.uint64) + np.uint64(1))
    n = np.diff(off) - width + 1
    owner = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return sums, owner, inner, off[owner] + inner


def _refine(width: int):
    """Orders the suffixes of segments that share a bucket; rows come sorted by bucket."""

    def solve(part: pa.Table) -> pa.RecordBatch:
        sums, owner, inner, start = _suffixes(part.column("content").to_pylist(), width)
        bucket = part.column("bucket").to_numpy()
        repeated = _radix_groups(bucket[owner], sums, start, width) & (part.column("copies").to_numpy() == 1)[owner]
        edge = np.flatnonzero(repeated & ~np.concatenate(([False], repeated[:-1] & (owner[1:] == owner[:-1]))))
        stop = np.flatnonzero(repeated & ~np.concatenate((repeated[1:] & (owner[1:] == owner[:-1]), [False]))) + 1
        spans: dict[int, list] = {}
        for a, b in zip(edge.tolist(), stop.tolist(), strict=True):
            spans.setdefault(int(owner[a]), []).append({"at": int(inner[a]), "len": b - a + width - 1})
        rows = sorted(spans)
        return pa.RecordBatch.from_arrays([pa.array(bucket[rows]), pa.array(part.column("seg").to_numpy()[rows]), pa.array([spans[r] for r in rows], _SPANS)], names=["bucket", "seg", "spans"])

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < HELD_SEGMENTS:
                continue
            table = pa.Table.from_batches(held)
            bucket = table.column("bucket").to_numpy()
            last = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
            if last:
                yield solve(table.slice(0, last).combine_chunks())
            held = table.slice(last).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    return refine


def _windows(width: int):
    """Every suffix of the segments with the digit that is the rest of its window."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                sums, owner, inner, start = _suffixes(part.column("content").to_pylist(), width)
                bucket, seg, copies = (part.column(c).to_numpy()[owner] for c in ("bucket", "seg", "copies"))
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(seg), pa.array(copies), pa.array(inner.astype(np.int32)), pa.array(T.span_hash(sums, start, start + width).view(np.int64))], names=["bucket", "seg", "copies", "at", "digit"])

    return windows


def _deal_out(spread: DataFrame, width: int) -> DataFrame:
    """(bucket, seg, spans) of the segments whose bucket is too large for a task.

    Digits that occur twice are counted before the shuffle and written, so that adaptive
    execution can split a frequent one when the suffixes meet them.
    """
    rows = spread.mapInArrow(_windows(width), "bucket long, seg long, copies long, at int, digit long")
    again = checkpoint(rows.groupBy("bucket", "digit").agg(F.count("*").alias("rows")).where("rows > 1").select("bucket", "digit"))
    place = F.row_number().over(Window.partitionBy("bucket", "seg").orderBy("at"))
    runs = rows.where("copies = 1").join(again, ["bucket", "digit"]).withColumn("run", F.col("at") - place)
    spans = runs.groupBy("bucket", "seg", "run").agg(F.min("at").alias("at"), (F.count("*") + width - 1).cast("int").alias("len"))
    return spans.groupBy("bucket", "seg").agg(F.collect_list(F.struct("at", "len")).alias("spans"))


_SPANS = pa.list_(pa.struct([("at", pa.int32()), ("len", pa.int32())]))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, removed, runs, digest, kept_text = [], [], [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist(), strict=True):
            raw = (text or "").encode()
            kept = raw
            k = r = 0
            if spans:
                out = T.covered(np.array([s["start"] for s in spans]), np.array([s["len"] for s in spans]), len(raw))
                k, r = int(out.sum()), int(out[0]) + int((out[1:] & ~out[:-1]).sum())
                kept = np.frombuffer(raw, np.uint8)[~out].tobytes()
            n.append(len(raw)), removed.append(k), runs.append(r), digest.append(hashlib.sha256(kept).hexdigest()), kept_text.append(kept)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def suffix_dedup(docs: DataFrame, width: int = 200, task_segments: int = TASK_SEGMENTS) -> DataFrame:
    """Removes every byte covered by a `width`-byte string that also starts anywhere else.

    Takes (doc_id, text, ...), returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and
    kept (the bytes that stay; a cut may split a UTF-8 character). Null or short texts stay as they are.
    """
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"))
    segs = texts.select("rid", "text").mapInArrow(_scan(width), "rid long, start int, n int, bucket long, seg long")
    counted = segs.groupBy("bucket").agg(F.count("*").alias("rows"), (F.min("seg") != F.max("seg")).alias("mixed")).where("rows > 1")
    shared = checkpoint(counted.select("bucket", "mixed", (F.col("mixed") & (F.col("rows") > task_segments)).alias("hot")))
    live = checkpoint(segs.join(shared, "bucket"))
    kinds = live.where("mixed").groupBy("bucket", "seg").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "start", "n")).alias("first"), F.first("hot").alias("hot"))
    parts = kinds.select(F.col("first.rid").alias("rid"), F.struct("bucket", "seg", "copies", "hot", F.col("first.start").alias("start"), F.col("first.n").alias("n")).alias("p")).groupBy("rid").agg(F.collect_list("p").alias("parts"))
    spread = texts.join(parts, "rid").select("doc_id", "text", "parts").mapInArrow(_contents(width), "bucket long, seg long, copies long, hot boolean, content binary")
    # many rows may be copies of few segments, which a task takes easily
    distinct = live.where("hot").select("bucket", "seg").distinct().groupBy("bucket").agg(F.count("*").alias("segments"))
    some_hot = not distinct.where(F.col("segments") > task_segments).isEmpty()
    if some_hot:
        spread = checkpoint(spread)
    partial = (spread.where("not hot") if some_hot else spread).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_refine(width), "bucket long, seg long, spans array<struct<at:int,len:int>>")
    if some_hot:
        partial = partial.unionByName(_deal_out(spread.where("hot"), width))
    twice = kinds.where("copies > 1").select("bucket", "seg", F.lit(None).cast("array<struct<at:int,len:int>>").alias("spans"))
    whole = F.array(F.struct(F.col("start").alias("start"), (F.col("n") + width - 1).alias("len")))
    shifted = F.transform("spans", lambda s: F.struct((F.col("start") + s["at"]).alias("start"), s["len"].alias("len")))
    hit = live.where("mixed").join(twice.unionByName(partial), ["bucket", "seg"]).select("rid", F.coalesce(shifted, whole).alias("spans")).unionByName(live.where("not mixed").select("rid", whole.alias("spans")))
    removed = hit.select("rid", F.explode("spans").alias("s")).groupBy("rid").agg(F.collect_list("s").alias("removed"))
    return texts.join(removed, "rid", "left").select("doc_id", "text", "removed").mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir).select("doc_id", "text")).drop("kept")
