"""Near copies by SimHash, each link verified by shingle similarity, and a lossless join for what fingerprints miss.

Two texts link when the Jaccard similarity of their shingle sets is at least
``least``. First come the pairs that SimHash finds: texts whose 64-bit fingerprints
over the same shingles differ in at most ``radius`` bits (simhash.links). Similar
texts can differ in more bits, so a set-similarity join seeks the others, among
sets that the fingerprints have not connected. With all sets in one order of
shingles, two similar sets share a shingle among the first n - ceil(least * n) + 1
of each; only those are shuffled. The order puts shingles that are frequent in a
sample last, then goes by hash; the links don't depend on it. Equal sets are one
node from the start, and every link, by fingerprints or not, is verified on the
whole sets. Pairs of a bucket are tried in two rounds: each set with the bucket's
least one, then those that are not connected by then. There, a set only meets the
classes of sizes that its place in the bucket allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from barloom.llm import simhash
from barloom.llm.common import maybe_broadcast, staged
from barloom.llm.components import components
from barloom.llm.simhash import _LOWER, keep_least

_ROWS = 256
#: One row in so many is sampled for the order, and so many shingles may come last.
_SAMPLE, _LAST = 16, 100_000
#: Ratio of the sizes at the ends of a class.
_CLASS = 1.05


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of so many words; a shorter text is one run, one without words has none."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    n = max(1, len(words) - shingle + 1) if words else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle])) for i in range(n)), np.uint64, n)).view(np.int64)


def _firsts(s: np.ndarray, least: float, last: np.ndarray) -> np.ndarray:
    """The shingles of which a similar set must share one, in the order of all."""
    if not len(s):
        return s
    n = len(s) - int(np.ceil(least * len(s) - 1e-9)) + 1
    if not len(last):
        return s[:n]
    known = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
    return np.concatenate([s[~known], s[known]])[:n]


def _sets(df: DataFrame, schema: T.StructType, shingle: int, rows_of) -> DataFrame:
    """mapInArrow over (kept columns..., text): rows_of gives the columns of a part from its sets and their keys."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                sets = [shingle_set(t, shingle) for t in part.column("text").to_pylist()]
                keys = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(rows_of(part, sets, keys), schema.names)

    return df.mapInArrow(batches, schema)


def _long(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


_LONGS = T.ArrayType(T.LongType())


def _with_text_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))


def _frequent(docs: DataFrame, shingle: int) -> np.ndarray:
    """Shingles that a sample of the texts has often: at most _LAST of them. They come last in the order; links don't depend on it."""
    sample = docs.filter(F.pmod("text_key", F.lit(_SAMPLE)) == 0).select("text")
    every = _sets(sample, T.StructType(_long("hash")), shingle, lambda part, sets, keys: [pa.array(np.concatenate(sets))])
    counts = every.groupBy("hash").count().filter("count >= 4").orderBy(F.col("count").desc(), "hash").limit(_LAST)
    return np.sort(np.array([r["hash"] for r in counts.collect()], np.int64))


def _marks(docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """(id, text_key, node, size, fingerprint, firsts) per row: the key and size of its set, the text's SimHash, and the shingles of _firsts."""
    last = _frequent(docs, shingle)
    schema = T.StructType([docs.schema["id"], *_long("text_key", "node", "size", "fingerprint"), T.StructField("firsts", _LONGS)])

    def rows_of(part: pa.RecordBatch, sets: list[np.ndarray], keys: np.ndarray) -> list[pa.Array]:
        firsts = pa.array([_firsts(s, least, last) for s in sets], pa.list_(pa.int64()))
        marks = np.array([simhash.simhash(t, shingle) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
        return [part.column("id"), part.column("text_key"), pa.array(keys), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks), firsts]

    return staged(_sets(docs, schema, shingle, rows_of), "sets")


def _nodes(marks: DataFrame) -> DataFrame:
    """(node, size, firsts, text_key, _id): one row per distinct set, with the row whose text stands for it."""
    of = F.min(F.struct("text_key", "id")).alias("of")
    nodes = marks.groupBy("node").agg(of, F.first("size").alias("size"), F.first("firsts").alias("firsts"))
    return staged(nodes.select("node", "size", "firsts", "of.text_key", F.col("of.id").alias("_id")), "set-nodes")


def _buckets(nodes: DataFrame) -> DataFrame:
    """(hash, node, size, place) of the shingles in nodes' firsts that another node has too.

    One shuffle: in the order of nodes, a row has company if it has a neighbour.
    """
    rows = nodes.select("node", "size", F.posexplode("firsts").alias("place", "hash"))
    order = W.partitionBy("hash").orderBy("node")
    company = F.lag("node").over(order).isNotNull() | F.lead("node").over(order).isNotNull()
    return rows.withColumn("company", company).filter("company").select("hash", "node", "size", "place")


def _sets_of(docs: DataFrame, nodes: DataFrame, asked: DataFrame, shingle: int, whole: bool) -> DataFrame:
    """(node, set, doubled) of the asked nodes, from one text of each: whole hashes, or their low 32 bits, of which so many are doubled."""
    wanted = staged(nodes.select("node", "text_key", "_id").join(asked.hint("merge"), "node").select("text_key", "_id"), "wanted-sets")
    one = maybe_broadcast(wanted, wanted.count(), 32)
    texts = docs.join(one, (docs["text_key"] == one["text_key"]) & docs["id"].eqNullSafe(one["_id"]), "left_semi")
    kind, width = (_LONGS, np.int64) if whole else (T.ArrayType(T.IntegerType()), np.int32)
    schema = T.StructType([*_long("node"), T.StructField("set", kind), *_long("doubled")])

    def rows_of(part: pa.RecordBatch, sets: list[np.ndarray], keys: np.ndarray) -> list[pa.Array]:
        cut = [s.astype(width) for s in sets]
        doubled = [len(s) - len(np.unique(s)) for s in cut]
        return [pa.array(keys), pa.array(cut, pa.list_(pa.from_numpy_dtype(width))), pa.array(doubled, pa.int64())]

    return _sets(texts.select("text"), schema, shingle, rows_of).dropDuplicates(["node"])


def _compared(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, whole: bool) -> DataFrame:
    """Each pair with sizes x and y of its sets, how many values they share, and the lesser count of doubled ones."""
    both = pairs
    for end, name in (("a", "x"), ("b", "y")):
        sets = _sets_of(docs, nodes, pairs.select(F.col(end).alias("node")).distinct(), shingle, whole)
        both = both.join(sets.select(F.col("node").alias(end), F.col("set").alias(name), F.col("doubled").alias(name + "_doubled")).hint("merge"), end)
    return both.select("a", "b", F.size("x").alias("x"), F.size("y").alias("y"), F.size(F.array_intersect("x", "y")).alias("shared"), F.least("x_doubled", "y_doubled").alias("doubled"))


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) of set keys whose sets have the similarity.

    The sets are compared by the low 32 bits of their hashes first. Sets of n and m
    shingles share n m / 2**32 of these by chance; where that, with a wide margin,
    or doubled values could decide, the pair is compared again by whole hashes.
    """
    similar = lambda shared: shared * (1 + least) >= least * (F.col("x") + F.col("y")) - 1e-9
    chance = F.col("x").cast("double") * F.col("y") / float(1 << 32)
    margin = 2 + 10 * F.sqrt(chance) + 4 * chance
    seen = _compared(docs, nodes, pairs, shingle, False).filter(similar(F.col("shared") + F.col("doubled")))
    seen = staged(seen.select("a", "b", similar(F.col("shared") - margin).alias("sure")).distinct(), "compared")
    again = _compared(docs, nodes, seen.filter("NOT sure").select("a", "b"), shingle, True).filter(similar(F.col("shared")))
    return seen.filter("sure").select("a", "b").unionByName(again.select("a", "b")).distinct()


def _enough(x: str, y: str, least: float) -> Column:
    """Whether two sets of these sizes that share nothing before these places can be similar."""
    sizes = F.col(f"{x}.size") + F.col(f"{y}.size")
    rest = F.least(F.col(f"{x}.size") - F.col(f"{x}.place"), F.col(f"{y}.size") - F.col(f"{y}.place"))
    return rest * (1 + least) >= least * sizes - 1e-9


def _class_of(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / float(np.log(_CLASS)))


def _meetings(rows: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b), a > b, of rows (hash, node, size, place, root) of one bucket that _enough lets pass and that differ in root.

    Of two sets that share nothing before their places, the one at a place has
    size - place shingles left, so only partners of at most ``most`` shingles can be
    similar. The larger set of a pair seeks the smaller by classes of sizes from
    least * size up to that; the smaller is met only if its own place allows a
    partner of its size or more.
    """
    mixed = rows.groupBy("hash").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("hash")
    rows = rows.join(mixed.hint("merge"), "hash", "left_semi")
    most = (F.col("size") - F.col("place")) * ((1 + least) / least) - F.col("size") + 1e-6
    classes = F.sequence(_class_of(F.col("size") * (least - 1e-9)), _class_of(F.least(F.col("size").cast("double"), most)))
    x = rows.filter(most >= F.col("size") * least - 1e-6).withColumn("class", F.explode(classes)).alias("x")
    y = rows.filter(most >= F.col("size")).withColumn("class", _class_of(F.col("size"))).hint("merge").alias("y")
    larger = (F.col("x.size") > F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.node") > F.col("y.node")))
    same = (F.col("x.hash") == F.col("y.hash")) & (F.col("x.class") == F.col("y.class"))
    met = x.join(y, same & larger & (F.col("x.root") != F.col("y.root")) & _enough("x", "y", least))
    return met.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()


def alike(marks: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b), a > b, of set keys that SimHash links: all sets with one fingerprint as a star, and stars of fingerprints within the radius."""
    own = marks.select("node", "fingerprint").distinct()
    heads = staged(own.groupBy("fingerprint").agg(F.min("node").alias("head")), "fingerprint-heads")
    pairs = own.join(heads.hint("merge"), "fingerprint").select(F.col("node").alias("x"), F.col("head").alias("y"))
    near = staged(simhash.links(heads.select("fingerprint"), radius), "fingerprint-links")
    for end, name in (("a", "x"), ("b", "y")):
        near = near.join(heads.select(F.col("fingerprint").alias(end), F.col("head").alias(name)).hint("merge"), end)
    pairs = pairs.unionByName(near.select("x", "y")).filter("x <> y")
    return pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that these components (node, root) don't connect."""
    n = roots.count()
    for end in ("a", "b"):
        of = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        pairs = pairs.join(maybe_broadcast(of, n, 16), end, "left")
    return pairs.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def links(docs: DataFrame, nodes: DataFrame, marks: DataFrame, shingle: int, least: float, radius: int) -> DataFrame:
    """Edges (a, b), a > b, between keys of shingle sets; their closure is that of all pairs with the similarity."""
    known = staged(verified(docs, nodes, staged(alike(marks, radius), "simhash-pairs"), shingle, least), "simhash-links")
    rows = staged(_buckets(nodes), "shingle-buckets")
    heads = rows.groupBy("hash").agg(F.min(F.struct("node", "size", "place")).alias("head"))
    stars = rows.select("hash", F.struct("node", "size", "place").alias("own")).join(heads.hint("merge"), "hash")
    stars = stars.filter((F.col("own.node") > F.col("head.node")) & _enough("own", "head", least) & (F.least("own.size", "head.size") >= least * F.greatest("own.size", "head.size") - 1e-9))
    stars = stars.select(F.col("own.node").alias("a"), F.col("head.node").alias("b")).distinct()
    stars = staged(_apart(stars, components(known)), "star-pairs")
    first = known.unionByName(staged(verified(docs, nodes, stars, shingle, least), "star-links"))

    roots = components(first)
    rooted = rows.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = staged(rooted, "rooted-buckets")
    return first.unionByName(verified(docs, nodes, staged(_meetings(rooted, least), "other-pairs"), shingle, least))


def keep_one_per_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, radius: int = 4) -> DataFrame:
    """df without the near copies: of each component of links only the row with the smallest id stays.

    Equal sets always link, those of texts without words too. Of repeated rows with
    one id, one stays. Rows with null ids take part and all stay.
    """
    docs = _with_text_key(df, id_col, text_col)
    marks = _marks(docs, shingle, least)
    roots = components(staged(links(docs, _nodes(marks), marks, shingle, least, radius), "links"))
    nodes = marks.groupBy("node").agg(F.min("id").alias("_least")).join(roots, "node", "left")
    nodes = staged(nodes.withColumn("root", F.coalesce("root", "node")), "set-roots")
    named = nodes.join(nodes.groupBy("root").agg(F.min("_least").alias("component_id")), "root").select("node", "component_id")
    return keep_least(df, marks.join(named, "node").select(F.col("id").alias(id_col), "component_id"), id_col)
