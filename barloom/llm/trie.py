"""Prefix trie of conversations, counted in flat arrays behind minimal perfect hashes.

A node is a distinct sequence of first turns. Its digest is the exclusive or of
one 128-bit hash per (position, turn), so a running aggregate gives all prefixes
of a conversation, also of one that is cut into blocks. Digests are verified:
within one node all last turns (SHA-256) and all parents must agree, which by
induction makes the whole prefixes equal.

Rows (one per conversation and depth) are dealt to shards by (conversation, block
of depths). Each shard enumerates its distinct digests, gives them slots by a
minimal perfect hash that is checked against the stored digests, scatters what its
rows carry into flat arrays, and adds the arrays up along parent slots from the
deepest level to the top. A node's own weight sits on one row only, that of its
smallest member, so the shards' sums of one digest add up to the subtree's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from barloom.llm.common import staged

#: Depths of one conversation that stay together; rows of a shard, about; ids of a block of endings.
BLOCK, SHARD_ROWS, END_IDS = 1024, 200_000, 4096

#: A digest of no turns at all.
ROOT = 0


def positions(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """df with _at, each row's place from 0 within its key; no task holds a key that has many rows.

    Rows are dealt by ranges of (key, order); places within a range are counted
    there, and the few keys that cross a border take over the counts of the ranges before.
    """
    rows = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_own", T.LongType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            keys = batch.column(key).to_pylist()
            own = np.empty(len(keys), np.int64)
            for i, k in enumerate(keys):
                seen = seen + 1 if k == last else 0
                own[i], last = seen, k
            parts = pa.array(np.full(len(keys), part, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts, pa.array(own)], schema.names)

    rows = staged(rows.mapInArrow(counted, schema), "places")
    ends = rows.groupBy(key, "_part").agg((F.max("_own") + 1).alias("_n"))
    before = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    crossing = ends.withColumn("_before", F.sum("_n").over(before)).filter("_before IS NOT NULL").select(key, "_part", "_before")
    # at most one key crosses each border: fewer rows than partitions
    return rows.join(F.broadcast(crossing), [key, "_part"], "left").withColumn("_at", F.col("_own") + F.coalesce("_before", F.lit(0))).drop("_part", "_own", "_before")


def forked(turns: DataFrame, heads: Callable[[Column], Column], base: Callable[[Column], Column], most: int) -> tuple[DataFrame, DataFrame]:
    """Every conversation with its first turns replaced by those of another: sizes (conv_id, n_turns), and rows (conv_id, depth, turn columns, n_turns).

    turns has conv_id, _at (from 0) and more columns. Conversation c takes the first
    heads(c) (at most ``most``) turns of base(c), or all if it has fewer, or none if
    it doesn't exist, then its own from heads(c) on. Depth counts from 1; a
    conversation without any turns left has a row in sizes only.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("_n"))
    known = sizes.select(F.col("conv_id").alias("_base"), F.col("_n").alias("_base_n"))
    every = sizes.withColumns({"_h": heads(F.col("conv_id")), "_base": base(F.col("conv_id"))}).join(known, "_base", "left")
    every = every.withColumn("_head", F.least("_h", F.coalesce("_base_n", F.lit(0))).cast("long"))
    every = every.withColumn("n_turns", F.col("_head") + F.greatest(F.col("_n") - F.col("_h"), F.lit(0)))
    every = staged(every.select("conv_id", "_base", "_h", "_head", "n_turns"), "forks")
    rest = [c for c in turns.columns if c not in ("conv_id", "_at")]
    own = turns.join(every.drop("_base"), "conv_id").filter("_at >= _h")
    own = own.select("conv_id", (F.col("_head") + F.col("_at") - F.col("_h") + 1).alias("depth"), *rest, "n_turns")
    first = turns.filter(F.col("_at") < most).withColumnRenamed("conv_id", "_base")
    taken = first.join(every, "_base").filter("_at < _head").select("conv_id", (F.col("_at") + 1).alias("depth"), *rest, "n_turns")
    return every.select("conv_id", "n_turns"), own.unionByName(taken)


def _lanes(*of: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *of) for seed in (11, 29)]


def prefixes(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds lo, hi (the digest of the turns up to depth) and up_lo, up_hi (those before) to (conv_id, depth, turn, n_turns).

    Conversations of more turns than a block has are cut, and the blocks' digests are put together after.
    """
    a, b = _lanes(F.col("depth"), F.col("turn"))
    rows = rows.withColumns({"_lo": a, "_hi": b, "block": F.floor((F.col("depth") - 1) / block)})
    upto = W.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"lo": F.bit_xor("_lo").over(upto), "hi": F.bit_xor("_hi").over(upto)})
    long = rows.filter(F.col("n_turns") > block)
    totals = long.groupBy("conv_id", "block").agg(F.bit_xor("_lo").alias("_tlo"), F.bit_xor("_hi").alias("_thi"))
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("conv_id", "block", F.bit_xor("_tlo").over(before).alias("_blo"), F.bit_xor("_thi").over(before).alias("_bhi"))
    long = long.join(totals, ["conv_id", "block"])
    long = long.withColumns({c: F.col(c).bitwiseXOR(F.coalesce(o, F.lit(0))) for c, o in (("lo", "_blo"), ("hi", "_bhi"))}).drop("_blo", "_bhi")
    rows = rows.filter(F.col("n_turns") <= block).unionByName(long)
    return rows.withColumns({"up_lo": F.col("lo").bitwiseXOR(F.col("_lo")), "up_hi": F.col("hi").bitwiseXOR(F.col("_hi"))}).drop("_lo", "_hi")


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys: levels of bit arrays, each taking the keys that are alone in it.

    After Limasset et al., "Fast and scalable minimal perfect hashing for massive key sets", SEA 2017.
    """

    def __init__(self, lo: np.ndarray, hi: np.ndarray, load: float = 2.0) -> None:
        self.levels: list[tuple[np.ndarray, int]] = []
        left, base = np.arange(len(lo)), 0
        while len(left):
            size = max(64, int(load * len(left)))
            at = self._place(lo[left], hi[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            ranks = np.where(alone, np.cumsum(alone) - 1 + base, -1)
            self.levels.append((ranks, size))
            base += int(alone.sum())
            left = left[~alone[at]]
        self.size = base
        slots = self._slots(lo, hi)
        self.lo, self.hi = np.empty(base, np.int64), np.empty(base, np.int64)
        self.lo[slots], self.hi[slots] = lo, hi

    @staticmethod
    def _place(lo: np.ndarray, hi: np.ndarray, level: int, size: int) -> np.ndarray:
        x = lo.view(np.uint64) + (hi.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(2 * level + 1)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    def _slots(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        found, left = np.full(len(lo), -1), np.arange(len(lo))
        for level, (ranks, size) in enumerate(self.levels):
            at = ranks[self._place(lo[left], hi[left], level, size)]
            found[left] = at
            left = left[at < 0]
            if not len(left):
                break
        return found

    def slots(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The keys' slots, -1 for what is no key: the slot's stored key decides."""
        if not self.size:
            return np.full(len(lo), -1)
        found = self._slots(lo, hi)
        right = (found >= 0) & (self.lo[found] == lo) & (self.hi[found] == hi)
        return np.where(right, found, -1)


def _distinct(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Places of the first of each key."""
    order = np.lexsort((hi, lo))
    a, b = lo[order], hi[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order[new]


_SUMS = "lo long, hi long, leaves long, saved long"


def _subtrees(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Sums over the subtrees of a shard's nodes: slots, scatter, then parents from the deepest level up."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    rows = pa.Table.from_batches(found)
    lo, hi, up_lo, up_hi, depth, leaves, saved = (rows.column(c).to_numpy() for c in ("lo", "hi", "up_lo", "up_hi", "depth", "leaves", "saved"))
    first = _distinct(lo, hi)
    table = PerfectHash(lo[first], hi[first])
    slot = table.slots(lo, hi)
    if (slot < 0).any():
        raise RuntimeError("a digest has no slot of its own")
    sums = np.zeros((2, table.size), np.int64)
    np.add.at(sums[0], slot, leaves)
    np.add.at(sums[1], slot, saved)
    parent, level = np.full(table.size, -1), np.zeros(table.size, np.int64)
    level[slot[first]] = depth[first]
    # the first depth of a block has its parent in another, to which its sums are carried as rows
    inside = (depth[first] == 1) | ((depth[first] > 1) & ((depth[first] - 1) % block > 0))
    parent[slot[first]] = np.where(inside, table.slots(up_lo[first], up_hi[first]), -1)
    order = np.argsort(-level, kind="stable")
    cuts = np.flatnonzero(np.diff(level[order])) + 1
    for nodes in np.split(order, cuts):
        nodes = nodes[parent[nodes] >= 0]
        for s in sums:
            np.add.at(s, parent[nodes], s[nodes])
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (table.lo, table.hi, sums[0], sums[1])], ["lo", "hi", "leaves", "saved"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node, in order, as comma-joined texts of at most END_IDS ids."""
    key, first, ids = None, None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, first, ",".join(ids))], ["lo", "hi", "first", "ids"])

    for batch in batches:
        for lo, hi, c in zip(*(batch.column(n).to_pylist() for n in ("lo", "hi", "conv_id")), strict=True):
            if key is not None and (key != (lo, hi) or len(ids) >= END_IDS):
                yield out()
                key, ids = None, []
            if key is None:
                key, first = (lo, hi), c
            ids.append(str(c))
    if key is not None:
        yield out()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's blocks of ids, which come in order; only the hash's state is held."""
    key, state = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], ["lo", "hi", "ends"])

    for batch in batches:
        for lo, hi, ids in zip(*(batch.column(n).to_pylist() for n in ("lo", "hi", "ids")), strict=True):
            if key == (lo, hi):
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                yield out()
            key, state = (lo, hi), hashlib.sha256(ids.encode())
    if key is not None:
        yield out()


def _endings(rows: DataFrame) -> DataFrame:
    """(lo, hi, ends): SHA-256 of the ascending ids (conv_id) of each digest, of any number."""
    schema = T._parse_datatype_string("lo long, hi long, first long, ids string")
    rows = rows.repartitionByRange("lo", "hi", "conv_id").sortWithinPartitions("lo", "hi", "conv_id")
    packed = staged(rows.mapInArrow(_packed, schema), "endings")
    return packed.repartition("lo", "hi").sortWithinPartitions("lo", "hi", "first").mapInArrow(_hashed, "lo long, hi long, ends string")


def _same(column: str) -> Column:
    """The one value of a column in a group; an error if there are several."""
    differ = F.min(column) != F.max(column)
    return F.when(differ, F.raise_error(F.lit(f"two nodes share a digest: {column}"))).otherwise(F.min(column))


def trie(rows: DataFrame, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of conversations given as (conv_id, depth, turn, bytes, n_turns), depths from 1, and sizes (conv_id, n_turns).

    turn identifies role and text, bytes is the text's length. Per node: conv_id
    (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens (over its subtree, (n_convs - 1) * bytes of
    the last text) and ends_sha256. The root is there unless there is no
    conversation at all. conv_id must not be null, (conv_id, depth) not repeat.
    """
    zero = F.lit(ROOT).cast("long")
    top = sizes.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("turn"), zero.alias("bytes"), "n_turns", F.lit(0).cast("long").alias("block"), *[zero.alias(c) for c in ("lo", "hi", "up_lo", "up_hi")])
    rows = staged(prefixes(rows, block).select(*top.columns).unionByName(top), "trie-rows")

    nodes = rows.groupBy("lo", "hi").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), *[_same(c).alias(c) for c in ("depth", "turn", "bytes", "up_lo", "up_hi")])
    nodes = staged(nodes.drop("turn"), "trie-nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("up_lo").alias("lo"), F.col("up_hi").alias("hi")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["lo", "hi"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    weights = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))

    held = rows.select("conv_id", "depth", "n_turns", "block", "lo", "hi", "up_lo", "up_hi").join(weights, ["conv_id", "depth"], "left").fillna(0, ["leaves", "saved"])
    held = staged(held, "trie-weights")
    # what later blocks of a conversation carry enters at the last depth of the block
    long = held.filter(F.col("n_turns") > block)
    sums = long.groupBy("conv_id", "block").agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"), F.max("depth").alias("depth"))
    later = W.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select("conv_id", "depth", F.sum("_leaves").over(later).alias("_leaves"), F.sum("_saved").over(later).alias("_saved"))
    long = long.join(carried, ["conv_id", "depth"], "left")
    long = long.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in ("leaves", "saved")}).select(held.columns)
    held = held.filter(F.col("n_turns") <= block).unionByName(long)
    shards = max(1, -(-held.count() // SHARD_ROWS), int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = held.select("conv_id", "block", "lo", "hi", "up_lo", "up_hi", "depth", "leaves", "saved").repartition(shards, "conv_id", "block")
    subtrees = held.mapInArrow(lambda batches: _subtrees(batches, block), _SUMS).groupBy("lo", "hi").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    nodes = staged(nodes.join(subtrees, ["lo", "hi"]).join(_endings(rows.filter("depth = n_turns")), ["lo", "hi"], "left"), "trie-full")
    parents = nodes.select(F.col("lo").alias("up_lo"), F.col("hi").alias("up_hi"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.filter("depth > 0").join(parents, ["up_lo", "up_hi"])
    every = below.unionByName(nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    nothing = hashlib.sha256(b"").hexdigest()
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(nothing)).alias("ends_sha256"))


def ordered_turns(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, _at, turn, bytes): the turns of each conversation in order, null turns first.

    Null roles and texts are empty. Turns of one number go by role, then by the
    SHA-256 of role and text; repeated rows are turns of their own. Rows without a
    conversation id belong to no conversation and are left out. An empty table has no turns.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turn = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("_turn"), role.alias("_role"), turn.alias("turn"), F.octet_length(text).cast("long").alias("bytes"))
    return positions(rows, "conv_id", [F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("turn")]).select("conv_id", "_at", "turn", "bytes")
