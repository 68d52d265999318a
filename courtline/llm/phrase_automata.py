"""Substring dedup with repeated-phrase automata.

1. Every document's windows of `width` words are grouped into segments that share an anchor
   (the least hash of their 8-word grams). Anchors found in one document only are dropped.
2. The distinct segments of the other anchors are dealt out by anchor. Within a shard the
   windows that more than one document holds are confirmed and joined to passages, each with
   the smallest doc_id that holds it.
3. Each shard compiles its passages into an Aho-Corasick automaton over word ids and streams
   all its segments through it; every occurrence marks its windows with the smallest doc_id.
   An anchor of more rows than a shard takes is spread over several: its windows are confirmed
   by grouping in Spark first, and each shard compiles the passages of its own segments.
4. A document drops the words of the windows whose smallest doc_id is below its own.

A null text has no words; rows with a null doc_id count as the largest. Rows that share a
doc_id belong to one document for the question who was first, and keep a row each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textcore as T
from .store import checkpoint, documents

GRAM = 8
#: Segments for one automaton; an anchor of no more rows stays together, larger ones are spread.
SHARD_SEGMENTS = 10_000
LAST = (1 << 63) - 1
_RUNS = pa.list_(pa.struct([("at", pa.int32()), ("len", pa.int32()), ("first_doc", pa.int64())]))
_RUNS_SQL = "array<struct<at:int,len:int,first_doc:bigint>>"


def _scan(width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in T.text_chunks(batches):
            starts, ends, word_off = T.words_of(data, off)
            s = T.segments(T.word_hashes(data, starts, ends), word_off, width, GRAM)
            yield pa.RecordBatch.from_arrays(
                [T.take_row(rows, "did", s["row"]), T.take_row(rows, "tid", s["row"]), T.take_row(rows, "size", s["row"]), pa.array((s["start"] - word_off[s["row"]]).astype(np.int32)), pa.array(s["n"].astype(np.int32)), pa.array(s["bucket"]), pa.array(s["seg"])],
                names=["did", "tid", "size", "start", "n", "bucket", "seg"],
            )

    return scan


def _contents(width: int):
    """The words of the segments that are listed for each row."""

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.utf8_parts(batch.column("text"))
            for i, parts in enumerate(batch.column("parts").to_pylist()):
                raw = data[off[i] : off[i + 1]]
                starts, ends, _ = T.words_of(raw, np.array([0, len(raw)]))
                raw = raw.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([p[k] for p in parts], pa.int64()) for k in ("bucket", "seg", "first_doc", "last_doc", "shards")), pa.array([raw[starts[p["start"]] : ends[p["start"] + p["n"] + width - 2]] for p in parts], pa.binary())],
                    names=["bucket", "seg", "first_doc", "last_doc", "shards", "content"],
                )

    return contents


def _runs(first: np.ndarray, owner: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of wanted windows with one owner and one first document."""
    same = (owner[1:] == owner[:-1]) & (first[1:] == first[:-1]) & wanted[1:] & wanted[:-1]
    return np.flatnonzero(wanted & ~np.concatenate(([False], same))), np.flatnonzero(wanted & ~np.concatenate((same, [False]))) + 1


def _windows_of(content: list[bytes], width: int):
    """Of joined segments: word hashes, word ids, word offsets; windows of each; segment, first word and hash of every window."""
    data, off = np.frombuffer(b"".join(content), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in content])))
    starts, ends, word_off = T.words_of(data, off)
    hashes = T.word_hashes(data, starts, ends)
    _, ids = np.unique(hashes, return_inverse=True)
    n = np.diff(word_off) - width + 1
    owner = np.repeat(np.arange(len(n)), n)
    at = word_off[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return hashes, ids, word_off, n, owner, at, T.span_hash(T.prefix_sums(hashes), at, at + width)


def _windows(width: int):
    """Every window of the segments with its hash."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                _, _, word_off, _, owner, at, window = _windows_of(part.column("content").to_pylist(), width)
                columns = [pa.array(part.column(c).to_numpy()[owner]) for c in ("bucket", "seg", "first_doc", "last_doc")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array((at - word_off[owner]).astype(np.int32)), pa.array(window.view(np.int64))], names=["bucket", "seg", "first_doc", "last_doc", "at", "window"])

    return windows


def _confirmed(spread: DataFrame, width: int) -> DataFrame:
    """(bucket, seg, known) of the segments with windows in more than one document; known holds runs of them with the smallest doc_id.

    Windows are pre-aggregated before the shuffle and written, so that adaptive execution can
    split a frequent one when the segments meet them.
    """
    rows = spread.mapInArrow(_windows(width), "bucket long, seg long, first_doc long, last_doc long, at int, window long")
    firsts = checkpoint(rows.groupBy("bucket", "window").agg(F.min("first_doc").alias("least"), F.max("last_doc").alias("most")).where("least < most").drop("most"))
    place = F.row_number().over(Window.partitionBy("bucket", "seg", "least").orderBy("at"))
    runs = rows.select("bucket", "seg", "at", "window").join(firsts, ["bucket", "window"]).withColumn("run", F.col("at") - place)
    spans = runs.groupBy("bucket", "seg", "least", "run").agg(F.min("at").alias("at"), (F.count("*") + width - 1).cast("int").alias("len"))
    return spans.groupBy("bucket", "seg").agg(F.collect_list(F.struct("at", "len", F.col("least").alias("first_doc"))).alias("known"))


def _locate(width: int):
    """Confirms a shard's passages, compiles them and streams the shard's segments through."""

    def solve(part: pa.Table) -> pa.RecordBatch:
        hashes, ids, word_off, n, owner, at, window = _windows_of(part.column("content").to_pylist(), width)
        bucket, first_doc, last_doc = (part.column(k).to_numpy() for k in ("bucket", "first_doc", "last_doc"))
        _, group = np.unique(T.mix(bucket.view(np.uint64)[owner] * np.uint64(31) ^ window), return_inverse=True)
        least, most = np.full(group.max() + 1, LAST), np.full(group.max() + 1, -LAST)
        np.minimum.at(least, group, first_doc[owner])
        np.maximum.at(most, group, last_doc[owner])
        first, wanted = least[group], least[group] < most[group]
        for k, lo, runs in zip(range(len(n)), (np.cumsum(n) - n).tolist(), part.column("known").to_pylist(), strict=True):
            if runs is not None:  # a spread anchor: other shards hold its windows too
                wanted[lo : lo + n[k]] = False
                for r in runs:
                    a, b = lo + r["at"], lo + r["at"] + r["len"] - width + 1
                    first[a:b], wanted[a:b] = r["first_doc"], True
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        words = ids.tolist()
        for a, b in zip(*(x.tolist() for x in _runs(first, owner, wanted)), strict=True):
            passage = tuple(words[at[a] : at[b - 1] + width])
            known = automaton.get(passage, None)
            automaton.add_word(passage, (len(passage), min(int(first[a]), known[1] if known else LAST)))
        out: list[list] = []
        if len(automaton):
            automaton.make_automaton()
            for k in range(len(n)):
                lo, hi = int(word_off[k]), int(word_off[k + 1])
                marks = np.full(int(n[k]), LAST)
                for end, (size, doc) in automaton.iter(tuple(words[lo:hi])):
                    a, b = end - size + 1, end - width + 2
                    np.minimum(marks[a:b], doc, out=marks[a:b])
                a, b = _runs(marks, np.zeros(len(marks), int), marks < last_doc[k])
                out.append([{"at": int(x), "len": int(y - x) + width - 1, "first_doc": int(marks[x])} for x, y in zip(a, b, strict=True)])
        else:
            out = [[] for _ in range(len(n))]
        rows = [k for k, runs in enumerate(out) if runs]
        return pa.RecordBatch.from_arrays([pa.array(bucket[rows]), pa.array(part.column("seg").to_numpy()[rows]), pa.array([out[k] for k in rows], _RUNS)], names=["bucket", "seg", "runs"])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < SHARD_SEGMENTS:
                continue
            table = pa.Table.from_batches(held)
            shard = table.column("shard").to_numpy()
            last = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
            if last:
                yield solve(table.slice(0, last).combine_chunks())
            held = table.slice(last).to_batches()
        if sum(b.num_rows for b in held):
            yield solve(pa.Table.from_batches(held))

    return locate


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = T.utf8_parts(batch.column("text"))
        n, removed, digest, kept = [], [], [], []
        for i, spans in enumerate(batch.column("removed").to_pylist()):
            raw = data[off[i] : off[i + 1]]
            starts, ends, _ = T.words_of(raw, np.array([0, len(raw)]))
            out = T.covered(np.array([s["start"] for s in spans]), np.array([s["len"] for s in spans]), len(starts)) if spans else np.zeros(len(starts), bool)
            text = raw.tobytes()
            text = b" ".join(text.split()) if not out.any() else b" ".join(text[a:b] for a, b in zip(starts[~out].tolist(), ends[~out].tolist(), strict=True))
            n.append(len(starts)), removed.append(int(out.sum())), digest.append(hashlib.sha256(text).hexdigest()), kept.append(text.decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def phrase_dedup(docs: DataFrame, width: int = 50) -> DataFrame:
    """Removes words covered by a `width`-word window that also starts in a document with a smaller doc_id.

    Takes (doc_id, text, ...), returns doc_id, n_words, n_removed, kept_sha256 and kept (the
    words that stay, joined by one space).
    """
    texts = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), F.xxhash64("doc_id", "text").alias("tid"), F.coalesce(F.octet_length("text"), F.lit(-1)).alias("size"))
    segs = texts.select("did", "tid", "size", "text").mapInArrow(_scan(width), "did long, tid long, size int, start int, n int, bucket long, seg long")
    counted = segs.groupBy("bucket").agg(F.min("did").alias("a"), F.max("did").alias("b"), F.count("*").alias("rows")).where("a < b")
    shared = checkpoint(counted.select("bucket", F.ceil(F.col("rows") / SHARD_SEGMENTS).alias("shards")))
    live = checkpoint(segs.join(shared, "bucket"))
    kinds = live.groupBy("bucket", "seg").agg(F.min(F.struct("did", "tid", "size", "start", "n")).alias("first"), F.max("did").alias("last_doc"), F.first("shards").alias("shards"))
    part = F.struct("bucket", "seg", F.col("first.did").alias("first_doc"), "last_doc", "shards", F.col("first.start").alias("start"), F.col("first.n").alias("n"))
    parts = kinds.select(F.col("first.did").alias("did"), F.col("first.tid").alias("tid"), F.col("first.size").alias("size"), part.alias("p")).groupBy("did", "tid", "size").agg(F.collect_list("p").alias("parts"))
    spread = texts.join(parts, ["did", "tid", "size"]).select("doc_id", "text", "parts").mapInArrow(_contents(width), "bucket long, seg long, first_doc long, last_doc long, shards long, content binary")
    if shared.where("shards > 1").isEmpty():
        dealt = spread.select("*", F.col("bucket").alias("shard"), F.lit(None).cast(_RUNS_SQL).alias("known"))
    else:
        spread = checkpoint(spread)
        alone = spread.where("shards = 1").select("*", F.col("bucket").alias("shard"), F.lit(None).cast(_RUNS_SQL).alias("known"))
        hot = spread.where("shards > 1")
        dealt = alone.unionByName(hot.join(_confirmed(hot, width), ["bucket", "seg"]).withColumn("shard", F.xxhash64("bucket", F.pmod("seg", "shards"))))
    found = dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(_locate(width), f"bucket long, seg long, runs {_RUNS_SQL}")
    hit = live.join(found, ["bucket", "seg"]).select("did", "tid", "size", "start", F.explode(F.filter("runs", lambda r: r["first_doc"] < F.col("did"))).alias("r"))
    removed = hit.select("did", "tid", "size", F.struct((F.col("start") + F.col("r.at")).alias("start"), F.col("r.len").alias("len")).alias("s")).groupBy("did", "tid", "size").agg(F.collect_list("s").alias("removed"))
    return texts.join(removed, ["did", "tid", "size"], "left").select("doc_id", "text", "removed").mapInArrow(_finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op3_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup(documents(spark, sf_dir).select("doc_id", "text")).drop("kept")
