"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

The product of the incidence matrix with its transpose holds every pair's overlap. Only the
parts of it that can pass are formed:

* Every column (n-gram) is counted over all documents, in blocks of packed hashes. Columns are put
  in one global order, frequent ones last, the most frequent at the end. A document enters only its
  first n - ceil(t * n) + 1 columns; two documents over the threshold share one of those, and
  at their first shared column the sizes and positions must still allow the needed overlap. So
  what many documents share, be it a passage or the original of many loose copies, makes pairs
  only of documents that have little else.
* Columns are dealt into blocks by their hash. A block pairs each document with the one document
  of the column that has least before it and discards pairs by size and position at that column.
  The counts of shared columns are not used: prefix filtering and whole-set verification decide.
* Surviving pairs are verified with whole sets. Columns whose documents already are in one
  component need no more; the documents of the others are multiplied in blocks of bounded
  size, across components only, and verified likewise, after a bound from the smallest
  quarter of their hashes has dropped most pairs.

So a group of k near copies costs about k pairs, not k * k, and no link between different
components is left out. The threshold is in percent, the comparison exact in whole numbers.

Rows that share a doc_id are one node with the links of all its texts; rows with a null doc_id
are linked with nothing and get a null component. Null or blank texts have no shingles. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as T
from .store import checkpoint, components, documents, sieve, stash

#: A column counts as frequent if this many documents hold it; of more than MOST_FREQUENT such
#: columns, those with most documents count. Their list is broadcast, at most 12 bytes each. It
#: only orders columns, so no pair depends on it.
MIN_FREQUENT = 12
MOST_FREQUENT = 2_000_000
#: Text bytes for one block of the columns when they are counted.
COUNT_BYTES = 4 << 20
#: Documents of one column that are multiplied in a task at once.
BLOCK = 2000
#: Pairs that a task holds to drop repeats.
PAIRS_HELD = 500_000
PAIR, ENTRY = 0, 1
#: Columns are told apart by so many leading bits while they are counted and ordered.
ORDER_BITS = 52
_REST = np.uint64(64 - ORDER_BITS)
#: Bytes that a column's remaining bits take within its block.
_PACKED = 5


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-word shingle hashes of every row, lower-cased in A-Z."""
    data = T.TO_LOWER[data]
    starts, ends, word_off = T.words_of(data, off)
    sums = T.prefix_sums(T.word_hashes(data, starts, ends))
    grams = T.run_hash(sums, n)
    short = T.span_hash(sums, word_off[:-1], word_off[1:])
    lo, hi = word_off[:-1].tolist(), word_off[1:].tolist()
    return [_distinct(grams[a : b - n + 1]) if b - a >= n else short[i : i + (b > a)] for i, (a, b) in enumerate(zip(lo, hi, strict=True))]


def _distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values; np.unique hashes here, which takes many times longer."""
    a = np.sort(a)
    return a[np.concatenate(([True], a[1:] != a[:-1]))] if len(a) else a


def _column_blocks(n: int, bits: int):
    """Every document's columns, packed by block: the leading `bits` bits, then _PACKED bytes a column."""
    lead, drop = np.uint64(64 - bits), np.uint64(64 - bits - 8 * _PACKED)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            grams = np.sort(np.concatenate(held))
            block = (grams >> lead).astype(np.int64)
            cut = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]))
            raw = np.ascontiguousarray((grams >> drop).view(np.uint8).reshape(-1, 8)[:, :_PACKED]).ravel()
            return pa.RecordBatch.from_arrays([pa.array(block[cut[:-1]]), pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut * _PACKED), pa.py_buffer(raw)]).cast(pa.binary())], names=["block", "columns"])

        for _, data, off in T.text_chunks(batches):
            held += [s for s in shingle_sets(data, off, n) if len(s)]
            if sum(map(len, held)) > PAIRS_HELD * 4:
                yield flush()
                held = []
        if held:
            yield flush()

    return pack


def _frequent(least: int, bits: int):
    """(column, n) of the columns that `least` documents hold; rows come sorted by block."""

    def solve(block: int, packed: list[bytes]) -> pa.RecordBatch:
        raw = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, _PACKED)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :_PACKED] = raw
        columns = np.sort(wide.view(np.uint64).ravel())
        first = np.flatnonzero(np.concatenate(([True], columns[1:] != columns[:-1])))
        count = np.diff(np.concatenate((first, [len(columns)])))
        many = count >= least
        whole = ((np.uint64(block) << np.uint64(8 * _PACKED)) | columns[first[many]]) >> np.uint64(bits + 8 * _PACKED - ORDER_BITS)
        return pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array(count[many])], names=["column", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            for b, columns in zip(batch.column("block").to_pylist(), batch.column("columns").to_pylist(), strict=True):
                if b != block and held:
                    yield solve(block, held)
                    held = []
                block = b
                held.append(columns)
        if held:
            yield solve(block, held)

    return count


def _column_order(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent columns, sorted, and the rank of each by its number of documents.

    The number of blocks grows with the text, so that a block's columns fit a task.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(ORDER_BITS - 8 * _PACKED, (size // COUNT_BYTES).bit_length()), 64 - 8 * _PACKED)
    packed = texts.select("text").mapInArrow(_column_blocks(n, bits), "block long, columns binary")
    counted = packed.repartition("block").sortWithinPartitions("block").mapInArrow(_frequent(MIN_FREQUENT, bits), "column long, n long")
    listed = counted.orderBy(F.desc("n"), "column").limit(MOST_FREQUENT).toArrow()  # bounded, and only orders columns
    column, count = listed.column("column").to_numpy().view(np.uint64), listed.column("n").to_numpy()
    by_column = np.argsort(column)
    rank = np.empty(len(column), np.int32)
    rank[np.lexsort((column, count))] = np.arange(len(column), dtype=np.int32)
    return column[by_column], rank[by_column]


def _prefixes(n: int, percent: int, sent: Broadcast):
    """The columns that each document enters: gram, doc_id, size of its set, position in the global order."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = sent.value
        for rows, data, off in T.text_chunks(batches):
            grams, sizes, places = [], [], []
            for s in shingle_sets(data, off, n):
                sizes.append(len(s))
                k = len(s) + (-percent * len(s) // 100) + 1 if len(s) else 0
                if len(frequent) and k:
                    column = s >> _REST
                    place = np.minimum(np.searchsorted(frequent, column), len(frequent) - 1)
                    common = frequent[place] == column
                    if common.any():
                        rare = s[~common]
                        s = rare if len(rare) >= k else np.concatenate((rare, s[common][np.argsort(rank[place[common]], kind="stable")]))
                grams.append(s[:k])
                places.append(k)
            count = np.array(places)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(grams).view(np.int64)),
                    T.take_row(rows, "doc_id", np.repeat(np.arange(len(count)), count)),
                    pa.array(np.repeat(np.array(sizes, np.int32), count)),
                    pa.array((np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)),
                ],
                names=["gram", "doc_id", "size", "pos"],
            )

    return enter


def _may_link(n1, p1, n2, p2, percent: int):
    """Whether sets of these sizes, whose first shared columns have these positions, can reach the threshold."""
    most = np.minimum(n1 - p1, n2 - p2)
    return (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & ((100 + percent) * most >= percent * (n1 + n2))


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(k)).to_numpy().astype(np.int64) for k in names]


def _star_product(percent: int):
    """Pairs of each document with the first one of its columns; rows come sorted by column and position.

    Gives PAIR rows (u, v) and, for the second product, the ENTRY rows (gram, doc_id,
    size, pos) of columns with more than two documents.
    """

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = second = None  # of a column that may go on: (gram, doc_id, size, pos); rows of it so far
        seen = 0
        found: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack(_columns(batch, "gram", "doc_id", "size", "pos"), 1)
            if head is not None and head[0] == rows[0, 0]:  # its first rows come along once more
                carried = min(seen, 2)
                rows = np.concatenate(([head, second][:carried], rows))
            else:
                carried = seen = 0
            gram, doc, size, pos = rows.T
            start = np.concatenate(([True], gram[1:] != gram[:-1]))
            top = np.maximum.accumulate(np.where(start, np.arange(len(gram)), 0))
            rank = np.arange(len(gram)) - top
            new = np.arange(len(gram)) >= carried
            pair = new & (rank > 0) & (doc != doc[top]) & _may_link(size, pos, size[top], pos[top], percent)
            if pair.any():
                u, v = doc[pair], doc[top][pair]
                found.append(np.stack((np.maximum(u, v), np.minimum(u, v)), 1))
            long = np.zeros(len(gram), bool)
            third = np.flatnonzero(rank == 2)
            long[third - 1] = long[third - 2] = True
            long |= rank >= 2
            if seen > 2:  # they are out already
                long[:carried] = False
            if long.any():
                yield _star_rows(ENTRY, *rows[long].T)
            if sum(map(len, found)) > PAIRS_HELD:
                found = [_pairs(found)]
                if len(found[0]) > PAIRS_HELD // 2:
                    yield _star_rows(PAIR, *found[0].T)
                    found = []
            last = top[-1]
            before = seen if last == 0 else 0
            seen = len(gram) - last - (carried if last == 0 else 0) + before
            head = rows[last]
            second = rows[last + 1] if len(gram) > last + 1 else None
        if found:
            yield _star_rows(PAIR, *_pairs(found).T)

    return multiply


def _pairs(found: list[np.ndarray]) -> np.ndarray:
    """Distinct pairs."""
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate(([True], (rows[1:] != rows[:-1]).any(1)))] if len(rows) else rows


def _star_rows(kind: int, a, b, c=None, d=None) -> pa.RecordBatch:
    zero = np.zeros(len(a), np.int32)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *(pa.array(x, pa.int64()) for x in (a, b)), *(pa.array(zero if x is None else x.astype(np.int32)) for x in (c, d))], names=["kind", "a", "b", "c", "d"])


def _rows(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _block_product(percent: int):
    """Pairs across components in blocks of one column; rows come sorted by column and block pair."""

    def product(doc, size, pos, part, comp):
        out = []
        cross = part.min() != part.max()
        for a in range(0, len(doc), 256):
            i = slice(a, a + 256)
            ok = (comp[i, None] != comp[None]) & _may_link(size[i, None], pos[i, None], size[None], pos[None], percent) & (doc[i, None] > doc[None])
            if cross:
                ok &= part[i, None] != part[None]
            x, y = np.nonzero(ok)
            out.append(np.stack((doc[x + a], doc[y]), 1))
        pairs = _pairs(out)
        return _rows(pairs[:, 0], pairs[:, 1])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = _columns(batch, "gram", "b1", "b2", "doc_id", "size", "pos", "part", "component")
            cut = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
            for k, piece in enumerate(zip(*(np.split(c, cut) for c in cols), strict=True)):
                if held and (k or any(held[-1][j][-1] != piece[j][0] for j in range(3))):
                    yield product(*(np.concatenate(x) for x in list(zip(*held, strict=True))[3:]))
                    held = []
                held.append(list(piece))
        if held:
            yield product(*(np.concatenate(x) for x in list(zip(*held, strict=True))[3:]))

    return multiply


def _sets(n: int):
    """Each row's set, 8 bytes a shingle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in T.text_chunks(batches):
            yield pa.RecordBatch.from_arrays([T.take_row(rows, "doc_id", np.arange(rows.num_rows)), pa.array([s.tobytes() for s in shingle_sets(data, off, n)], pa.binary())], names=["doc_id", "grams"])

    return pack


def _sets_of(texts: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """(doc_id, grams, n) of the documents in the pairs."""
    ids = checkpoint(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct())
    packed = sieve(texts, "doc_id", ids).join(ids, "doc_id").mapInArrow(_sets(n), "doc_id long, grams binary")
    return packed.withColumn("n", (F.octet_length("grams") / 8).cast("int"))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate((a, b))
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _reaches(n1: int, n2: int, shared: int, percent: int) -> bool:
    return 100 * shared >= percent * (n1 + n2 - shared)


def _whole(a: np.ndarray, n1: int, b: np.ndarray, n2: int, percent: int) -> bool:
    """Whether whole sets reach the threshold."""
    return 100 * min(n1, n2) >= percent * max(n1, n2) and _reaches(n1, n2, _common(a, b), percent)


def _heads(a: np.ndarray, n1: int, b: np.ndarray, n2: int, percent: int) -> bool:
    """Whether sets can reach the threshold, by their smallest hashes.

    Up to the smaller of both last hashes the overlap is known; beyond it, it is at most what
    is left of either set.
    """
    end = min(a[-1] if len(a) < n1 else T._NONE, b[-1] if len(b) < n2 else T._NONE)
    a, b = a[: np.searchsorted(a, end, "right")], b[: np.searchsorted(b, end, "right")]
    return _reaches(n1, n2, _common(a, b) + min(n1 - len(a), n2 - len(b)), percent)


def _verify(percent: int, test):
    """Tests pairs block by block; rows come sorted by block, a block's sets before its pairs."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sets = None, {}
        for batch in batches:
            keep = []
            names = ("g", "b", "u", "v", "n", "grams")
            for g, b, u, v, n, grams in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in names), strict=True):
                if block != (g, b):
                    block, sets = (g, b), {}
                if grams is not None:
                    sets.setdefault(u, []).append((np.frombuffer(grams, np.uint64), n))  # rows that share a doc_id are one node
                elif any(test(*x, *y, percent) for x in sets.get(u, ()) for y in sets.get(v, ())):
                    keep.append((u, v))
            links = np.array(keep, np.int64).reshape(-1, 2)
            yield _rows(links[:, 0], links[:, 1])

    return verify


def _links(pairs: DataFrame, sets: DataFrame, percent: int, test) -> DataFrame:
    """The pairs (u, v) whose sets (doc_id, n, grams) pass the test.

    Pairs are put together by v, those of a v with many pairs in blocks of about BLOCK, so v's
    set travels once for each block, not once for each pair.
    """
    parts = pairs.groupBy("v").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    keyed = checkpoint(pairs.join(parts, "v").select(F.col("v").alias("g"), F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("b"), "u", "v"))
    wanted = keyed.select("g", "b", F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    rows = wanted.join(sets, "doc_id").select("g", "b", F.lit(0).alias("kind"), F.col("doc_id").alias("u"), F.col("doc_id").alias("v"), "n", "grams")
    rows = rows.unionByName(keyed.withColumns({"kind": F.lit(1), "n": F.lit(0), "grams": F.lit(None).cast("binary")}))
    return rows.repartition("g", "b").sortWithinPartitions("g", "b", "kind").mapInArrow(_verify(percent, test), "u long, v long")


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, component_id) of the documents that are linked with others; docs (doc_id, text, ...)."""
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = texts.sparkSession.sparkContext.broadcast(_column_order(texts, n))
    entered = texts.mapInArrow(_prefixes(n, percent, order), "gram long, doc_id long, size int, pos int").repartition("gram")
    products, discard = stash(entered.sortWithinPartitions("gram", "pos", "doc_id").mapInArrow(_star_product(percent), "kind int, a long, b long, c int, d int"))
    pairs = checkpoint(products.where(F.col("kind") == PAIR).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    entries = products.where(F.col("kind") == ENTRY)
    try:
        links = checkpoint(_links(pairs, _sets_of(texts, pairs, n), percent, _whole))
        comps = components(links)
        across = checkpoint(_across(entries, comps, percent).join(pairs, ["u", "v"], "left_anti"))
    finally:
        discard()
    if not across.isEmpty():
        sets, discard = stash(_sets_of(texts, across, n))
        try:
            heads = sets.withColumn("grams", F.expr("substring(grams, 1, 8 * ((n + 3) div 4))"))
            near = checkpoint(_links(across, heads, percent, _heads))
            more = checkpoint(_links(near, sets, percent, _whole))
        finally:
            discard()
        if not more.isEmpty():
            comps = components(links.unionByName(more))
    return comps.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))


def _across(entries: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (u, v) across components that share a column and may link by size and position."""
    placed = (
        entries.select(F.col("a").alias("gram"), F.col("b").alias("doc_id"), F.col("c").alias("size"), F.col("d").alias("pos"))
        .join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .withColumn("component", F.coalesce("component", "doc_id"))
    )
    open_columns = placed.groupBy("gram").agg(F.count("*").alias("m"), (F.min("component") != F.max("component")).alias("open")).where("open").select("gram", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(open_columns, "gram").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = dealt.select("gram", F.least("part", "other").alias("b1"), F.greatest("part", "other").alias("b2"), "doc_id", "size", "pos", "part", "component").repartition("gram", "b1", "b2").sortWithinPartitions("gram", "b1", "b2")
    return blocks.mapInArrow(_block_product(percent), "u long, v long").distinct()


def _count_shingles(n: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in T.text_chunks(batches):
            yield pa.RecordBatch.from_arrays([T.take_row(rows, "doc_id", np.arange(rows.num_rows)), pa.array([len(s) for s in shingle_sets(data, off, n)], pa.int64())], names=["doc_id", "n_shingles"])

    return count


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: the smallest doc_id that links reach, itself included."""
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count_shingles(n), "doc_id long, n_shingles long")
    return sizes.join(ngram_components(docs, n, percent), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs without those that are linked, directly or not, with a smaller doc_id."""
    extra = ngram_components(docs, n, percent).where("doc_id <> component_id").select("doc_id")
    return docs.join(extra, "doc_id", "left_anti").select(*docs.columns)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir).select("doc_id", "text"))
