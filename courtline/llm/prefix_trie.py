"""Conversation prefix trie: every shared beginning of conversations, with the totals of its subtree.

Turns are numbered over the whole table by range, so a conversation of any length is spread over tasks. A
prefix is known by a chain of SHA-256 over its turns, made in blocks of BLOCK turns: within a block from the
block's beginning, then over the blocks' ends. Conversations with the same chain share a node, and a node's
name is (its smallest member, its depth).

Subtree totals come from parallel tree contraction. Rake: every leaf hands its total to its parent and goes.
Compress: of the nodes with one child left, those whose coin is heads while their parent's is tails go; the
child moves up and remembers what it passed. Each is one grouping of messages by receiver and one join on the
node, and chains lose about half of their nodes in a round. Nodes that compression took are then
expanded: each one's total is that of its child plus what was noted, and pointers are doubled
until they end at a raked node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import checkpoint, documents, numbered, stash

#: Turns whose digests one task chains at a time.
BLOCK = 1024
#: Turns taken from the conversation that others begin with, at most (the remainder of a checksum).
SHARED = 6
_EMPTY = b""


def _turns(talks: DataFrame) -> DataFrame:
    """(conv_id, number, digest, size): numbered over the table in the order of conversation and turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(" "), role, text).cast("binary"), 256))
    rows = talks.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), F.substring(role, 1, 64).alias("_role"), F.substring(text, 1, 64).alias("_text"), digest.alias("digest"), F.length(text).cast("long").alias("size"))
    return numbered(rows, [F.col("conv_id"), F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_text"), F.col("digest")], "number")[0].drop("_turn", "_role", "_text")


def rebuilt(talks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of every rebuilt conversation, and the conversations that have none.

    Conversation c is the first h turns of conversation c - c % 100, then its own after its first h, where h is
    crc32(c) % 6. Returns (conv_id, depth, digest, size, last) and (conv_id).
    """
    turns = _turns(talks)
    spans = turns.groupBy("conv_id").agg(F.min("number").alias("start"), F.count("*").alias("n"))
    spans = spans.select("*", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    of_base = spans.select(F.col("conv_id").alias("base"), F.least(F.col("n"), F.lit(SHARED - 1)).alias("base_n"))
    talk = checkpoint(spans.join(of_base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))).cast("long")).withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    at = F.col("number") - F.col("start") + 1
    own = turns.join(talk, "conv_id").where(at > F.col("h")).select("conv_id", (at - F.col("h") + F.col("taken")).alias("depth"), "digest", "size", "total")
    heads = turns.where("conv_id % 100 = 0").join(spans.where("conv_id = base").select("conv_id", "start"), "conv_id").where(at < SHARED).select(F.col("conv_id").alias("base"), at.alias("depth"), "digest", "size")
    begun = heads.join(talk, "base").where("depth <= taken").select("conv_id", "depth", "digest", "size", "total")
    rows = own.unionByName(begun)
    return rows.withColumn("last", F.col("depth") == F.col("total")).drop("total"), talk.where("total = 0").select("conv_id")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _emit(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each turn's digest over its block so far, and the one before it (null for the block's first)."""

    def run() -> Iterator[tuple]:
        for _, rows in groupby(_rows(batches), key=lambda r: (r[0], r[1])):
            before = None
            for conv, block, depth, digest, size, last in rows:
                state = hashlib.sha256((before or _EMPTY) + digest).digest()
                yield conv, block, depth, state, before, size, last
                before = state

    return _emit(run(), pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("depth", pa.int64()), ("here", pa.binary()), ("before", pa.binary()), ("size", pa.int64()), ("last", pa.bool_())]))


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefix that each block but the first begins with, from the ends of full blocks in order."""

    def run() -> Iterator[tuple]:
        for _, rows in groupby(_rows(batches), key=lambda r: r[0]):
            state = _EMPTY
            for conv, block, end in rows:
                state = hashlib.sha256(state + end).digest()
                yield conv, block + 1, state

    return _emit(run(), pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("carry", pa.binary())]))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of a node's conversations as text, which is fed one by one."""

    def run() -> Iterator[tuple]:
        for (depth, key), rows in groupby(_rows(batches), key=lambda r: (r[0], r[1])):
            total, comma = hashlib.sha256(), b""
            for _, _, conv in rows:
                total.update(comma + b"%d" % conv)
                comma = b","
            yield depth, key, total.hexdigest()

    return _emit(run(), pa.schema([("depth", pa.int64()), ("key", pa.binary()), ("ends_sha256", pa.string())]))


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, key, parent_key, size, last): what every turn's prefix, and the one before it, are known by."""
    cut = turns.select("conv_id", F.floor((F.col("depth") - 1) / block).cast("long").alias("block"), "depth", "digest", "size", "last")
    rows, discard = stash(cut.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "depth").mapInArrow(_chained, "conv_id long, block long, depth long, here binary, before binary, size long, last boolean"))
    ends = rows.where(F.col("depth") % block == 0).select("conv_id", "block", F.col("here").alias("end"))
    carries = ends.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_carried, "conv_id long, block long, carry binary")
    known = lambda carry, c: F.unhex(F.sha2(F.concat(carry, F.col(c)), 256))
    none = F.lit(_EMPTY)
    early = rows.where("block = 0").select("conv_id", "depth", known(none, "here").alias("key"), F.coalesce(known(none, "before"), none).alias("parent_key"), "size", "last")
    late = rows.where("block > 0").join(carries, ["conv_id", "block"]).select("conv_id", "depth", known(F.col("carry"), "here").alias("key"), F.coalesce(known(F.col("carry"), "before"), F.col("carry")).alias("parent_key"), "size", "last")
    out = checkpoint(early.unionByName(late))
    discard()
    return out


def trie(steps: DataFrame, turnless: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (conv_id, depth, parent_conv_id, n_convs, n_children, size, key, child_xor) and (depth, key, ends_sha256)."""
    root = F.lit(_EMPTY)
    begins = steps.where("depth = 1").select("conv_id", F.lit(False).alias("last")).unionByName(turnless.withColumn("last", F.lit(True)))
    places = steps.unionByName(begins.select("conv_id", F.lit(0).cast("long").alias("depth"), root.alias("key"), F.lit(None).cast("binary").alias("parent_key"), F.lit(0).cast("long").alias("size"), "last"))
    nodes = checkpoint(places.groupBy("depth", "key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"), F.min("parent_key").alias("parent_key")))
    above = (F.col("depth") - 1).alias("depth")
    kids = nodes.where("depth > 0").select(above, F.col("parent_key").alias("key"), "conv_id").groupBy("depth", "key").agg(F.count("*").alias("n_children"), F.bit_xor("conv_id").alias("child_xor"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(kids, ["depth", "key"], "left").join(parents, ["depth", "parent_key"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    ends = places.where("last").select("depth", "key", "conv_id").repartition("depth", "key").sortWithinPartitions("depth", "key", "conv_id").mapInArrow(_listed, "depth long, key binary, ends_sha256 string")
    return checkpoint(found.select("conv_id", "depth", "parent_conv_id", "n_convs", zero("n_children"), "size", "key", zero("child_xor"))), ends


def _rake(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Takes all leaves off: their totals, and the tree without them."""
    leaf = F.col("n").eqNullSafe(0) & F.col("p").isNotNull()
    leaves = tree.where(leaf)
    given = leaves.groupBy(F.col("p").alias("v"), F.col("pd").alias("vd")).agg(F.count("*").alias("gone"), F.bit_xor("v").alias("gv"), F.bit_xor("vd").alias("gd"), F.sum(F.col("leaves") + F.col("w_leaves")).alias("gl"), F.sum(F.col("saved") + F.col("w_saved")).alias("gs"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    left = tree.where(~leaf).join(given, ["v", "vd"], "left").select("v", "vd", "p", "pd", (F.col("n") - zero("gone")).alias("n"), F.col("cv").bitwiseXOR(zero("gv")).alias("cv"), F.col("cd").bitwiseXOR(zero("gd")).alias("cd"), (F.col("leaves") + zero("gl")).alias("leaves"), (F.col("saved") + zero("gs")).alias("saved"), "w_leaves", "w_saved")
    return leaves.select("v", "vd", "leaves", "saved"), left


def _coin(v: str, d: str, turn: int, bits: int) -> Column:
    """Heads for every other node of a chain: a bit of the depth, or of a hash every other time round."""
    side = F.shiftright(F.col(d), turn % bits) if turn // bits % 2 == 0 else F.xxhash64(F.col(v), F.col(d), F.lit(turn))
    return side.bitwiseAND(F.lit(1)) == 1


def _compress(tree: DataFrame, turn: int, bits: int) -> DataFrame:
    """Takes nodes with one child out of their chains; their child notes them in (u, ud, u_leaves, u_saved).

    No two neighbours go: a node goes if its coin is heads and its parent's tails. The child's name is
    the exclusive or of the children's names, so nothing need be looked up.
    """
    goes = (F.col("n") == 1) & F.col("p").isNotNull() & _coin("v", "vd", turn, bits) & ~_coin("p", "pd", turn, bits)
    note = lambda v, vd, **more: F.struct(F.col(v).alias("v"), F.col(vd).alias("vd"), *[more.get(c, F.lit(None).cast("long")).alias(c) for c in ("u", "ud", "up", "upd", "ul", "us", "wl", "ws", "xv", "xd")])
    c = F.col
    down = note("cv", "cd", u=c("v"), ud=c("vd"), up=c("p"), upd=c("pd"), ul=c("leaves"), us=c("saved"), wl=c("w_leaves"), ws=c("w_saved"))
    up = note("p", "pd", xv=c("v").bitwiseXOR(c("cv")), xd=c("vd").bitwiseXOR(c("cd")))
    notes = tree.where(goes).select(F.explode(F.array(down, up)).alias("m")).select("m.*").groupBy("v", "vd").agg(*[F.max(x).alias(x) for x in ("u", "ud", "up", "upd", "ul", "us", "wl", "ws")], F.bit_xor("xv").alias("xv"), F.bit_xor("xd").alias("xd"))  # one note from above at most
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    moved = tree.where(~F.coalesce(goes, F.lit(False))).join(notes, ["v", "vd"], "left")
    return moved.select(
        "v", "vd", F.coalesce("up", "p").alias("p"), F.coalesce("upd", "pd").alias("pd"), "n", c("cv").bitwiseXOR(zero("xv")).alias("cv"), c("cd").bitwiseXOR(zero("xd")).alias("cd"), "leaves", "saved",
        (c("w_leaves") + zero("ul") + zero("wl")).alias("w_leaves"), (c("w_saved") + zero("us") + zero("ws")).alias("w_saved"),
        "u", "ud", (c("w_leaves") + c("ul")).alias("u_leaves"), (c("w_saved") + c("us")).alias("u_saved"),
    )


def _expand(taken: DataFrame) -> DataFrame:
    """Follows (v, vd, cv, cd, leaves, saved) down until no child is one that compression took."""
    while True:
        below = taken.select(F.col("v").alias("cv"), F.col("vd").alias("cd"), F.col("cv").alias("bv"), F.col("cd").alias("bd"), F.col("leaves").alias("bl"), F.col("saved").alias("bs"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        joined = taken.join(below, ["cv", "cd"], "left").select("v", "vd", F.coalesce("bv", "cv").alias("cv"), F.coalesce("bd", "cd").alias("cd"), (F.col("leaves") + zero("bl")).alias("leaves"), (F.col("saved") + zero("bs")).alias("saved"), F.col("bv").isNotNull().alias("went"))
        taken = checkpoint(joined)
        if taken.where("went").isEmpty():
            return taken.drop("went")


def subtree_totals(tree: DataFrame) -> DataFrame:
    """Sums over every node's subtree by contraction: (v, vd, leaves, saved).

    `tree` has a node (v, vd) with vd its depth, its parent (p, pd; null for the root), the number n of its
    children, the exclusive or of their names (cv, cd), and what the node adds itself: leaves, saved.
    """
    deepest = tree.agg(F.max("vd")).first()[0]
    if deepest is None:
        return tree.select("v", "vd", "leaves", "saved")
    bits = max(1, int(deepest).bit_length())
    zero = F.lit(0).cast("long")
    tree = tree.select("v", "vd", "p", "pd", "n", "cv", "cd", "leaves", "saved", zero.alias("w_leaves"), zero.alias("w_saved"))
    done, taken, turn = [], [], 0
    while True:
        raked, left = _rake(tree)
        done.append(raked)
        tree = checkpoint(left)
        if tree.where("p is not null").isEmpty():
            break
        tree = checkpoint(_compress(tree, turn, bits))
        taken.append(tree.where("u is not null").select(F.col("u").alias("v"), F.col("ud").alias("vd"), F.col("v").alias("cv"), F.col("vd").alias("cd"), F.col("u_leaves").alias("leaves"), F.col("u_saved").alias("saved")))
        turn += 1
    out = tree.select("v", "vd", "leaves", "saved")
    for part in done:
        out = out.unionByName(part)
    if not taken:
        return out
    chained = taken[0]
    for part in taken[1:]:
        chained = chained.unionByName(part)
    ends = out.select(F.col("v").alias("cv"), F.col("vd").alias("cd"), F.col("leaves").alias("el"), F.col("saved").alias("es"))
    return out.unionByName(_expand(chained).join(ends, ["cv", "cd"]).select("v", "vd", (F.col("leaves") + F.col("el")).alias("leaves"), (F.col("saved") + F.col("es")).alias("saved")))


def conversation_trie(talks: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each distinct beginning of rebuilt conversations, the root included.

    A null role or text is empty. Turns of one number come in the order of role, then text, by their first 64
    characters and then by SHA-256; repeated rows are turns of their own. Rows without conv_id belong to no
    conversation and are left out. A conversation that has no turns left ends at the root; an empty table
    has no root. Only conv_id, turn, role and text are read. The list of conversations that end at a node is
    hashed as one stream, by its definition; everything else of a common node is summed before the shuffle.
    """
    turns, turnless = rebuilt(talks)
    nodes, ends = trie(prefixes(turns, block), turnless)
    several = F.col("n_children") % 2 == 1
    own = nodes.select(
        F.col("conv_id").alias("v"), F.col("depth").alias("vd"), F.col("parent_conv_id").alias("p"), F.when(F.col("depth") > 0, F.col("depth") - 1).alias("pd"), F.col("n_children").alias("n"), F.col("child_xor").alias("cv"), F.when(several, F.col("depth") + 1).otherwise(0).alias("cd"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
    )
    totals = subtree_totals(own).select(F.col("v").alias("conv_id"), F.col("vd").alias("depth"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    out = nodes.join(ends, ["depth", "key"], "left").join(totals, ["conv_id", "depth"])
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(_EMPTY).hexdigest())).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
