"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints link when they differ in at most ``radius`` bits (4 by
default). Every fingerprint emits all variants within half the radius; two
fingerprints link exactly when they share a variant, and, by the triangle
inequality, all members of one variant's bucket link to each other. So a bucket
needs no pairs: each member is tied to the bucket's smallest fingerprint, and a
bucket can hold no more fingerprints than a ball of half the radius has points.

A radius-2 ball over 64 bits has 2,081 points, too many rows to shuffle for
fingerprints that have no partner at all. These are set aside without loss
first, by ball hashing of projections: the fingerprint is cut into three parts,
and of two fingerprints that differ in at most 4 bits, some two of the parts
together differ in at most 2 (the three pairs of parts share at most 8 differing
bits). So a ball of radius 1 on each pair of parts, 3 x 44 variants, meets for all
that have a partner. A pair of parts has 43 bits, so few meet by chance: about
44 n / 2**43 for each variant of n fingerprints. What a filter's key brings together
is linked there where that is cheap, so that a cluster of near copies needs few balls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from barloom.llm.common import UPPER, maybe_broadcast, staged
from barloom.llm.components import components

_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
#: Shingles whose bits are counted at once, so that a long text needs little memory.
_AT_ONCE = 1 << 15


def simhash(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of a text; 0 for null and for texts without words."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) < shingle:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[:n], ends[shingle - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _AT_ONCE):
        spans = zip(starts[at : at + _AT_ONCE].tolist(), ends[at : at + _AT_ONCE].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """One row per input row: the id and ``fingerprint`` (the 64 bits as a signed long)."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = np.array([simhash(t, shingle, seed) for t in frame[text_col]], dtype=np.uint64)
            yield pd.DataFrame({id_col: frame[id_col], "fingerprint": found.view(np.int64)})

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("fingerprint", T.LongType())])
    return df.select(id_col, text_col).mapInPandas(batches, schema)


def _ball(df: DataFrame, bits: int, value: str, variant: str, radius: int) -> DataFrame:
    """All variants of ``value`` with at most ``radius`` of the low ``bits`` bits flipped.

    Flipped positions come in rising order; position ``bits`` stands for no flip.
    """
    out = df.withColumn(variant, F.col(value)).withColumn("_at", F.lit(-1))
    for _ in range(radius):
        after = F.when(F.col("_at") >= bits, F.array(F.lit(bits))).otherwise(F.sequence(F.col("_at") + 1, F.lit(bits)))
        out = out.withColumn("_at", F.explode(after))
        flip = F.when(F.col("_at") < bits, F.expr("shiftleft(1L, _at)")).otherwise(F.lit(0).cast("long"))
        out = out.withColumn(variant, F.col(variant).bitwiseXOR(flip))
    return out.drop("_at")


def _sharing(keys: DataFrame, by: list[str], tag: str) -> DataFrame:
    """The rows of distinct (key, fingerprint) whose key also another fingerprint has. Counts per key only, so no bucket is gathered."""
    shared = keys.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1").select(*by)
    shared = staged(shared, tag)
    return keys.join(maybe_broadcast(shared, shared.count(), 8 * len(by) + 8), by, "left_semi")


#: Bits of the first two of the three parts (the last has what remains), and of the widest pair of parts.
_PART, _PAIR = 21, 43
#: Fingerprints of one key that are compared pair by pair: far fewer pairs than a ball has points.
_FEW = 64


def _pairs_of_parts() -> Column:
    """The three projections of a fingerprint, each on two of its parts."""
    whole = F.col("fingerprint")
    low, high = whole.bitwiseAND(F.lit((1 << _PART) - 1)), F.shiftrightunsigned(whole, 2 * _PART)
    return F.array(whole.bitwiseAND(F.lit((1 << 2 * _PART) - 1)), F.shiftrightunsigned(whole, _PART), F.shiftleft(high, _PART).bitwiseOR(low))


def _near_pairs(distinct: DataFrame, radius: int) -> DataFrame:
    """(key, fingerprint) of the variants of a pair of parts that another fingerprint has too."""
    # A round-robin deal: the staged table is small, and its 3 x 44 rows for each row are not.
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sides = spread.select("fingerprint", F.posexplode(_pairs_of_parts()).alias("_side", "_pair"))
    keys = _ball(sides, _PAIR, "_pair", "_variant", -(-(2 * radius // 3) // 2))
    keys = keys.select(F.expr(f"_variant + shiftleft(cast(_side as long), {_PAIR})").alias("key"), "fingerprint")
    return staged(_sharing(keys, ["key"], "pairs"), "near-pairs")


def _stars(pairs: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) within the radius between the least fingerprint of a key and the others of it."""
    heads = pairs.groupBy("key").agg(F.min("fingerprint").alias("b"))
    edges = pairs.join(heads.hint("merge"), "key").filter("fingerprint > b").select(F.col("fingerprint").alias("a"), "b").distinct()
    return edges.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def _apart(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, fingerprint, root, n) of the keys whose n fingerprints these edges don't all connect."""
    rooted = pairs.join(components(edges).hint("merge"), pairs["fingerprint"] == F.col("node"), "left")
    rooted = rooted.select("key", "fingerprint", F.coalesce("root", "fingerprint").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low < high")
    return staged(rooted.join(mixed.select("key", "n").hint("merge"), "key"), "apart")


def links(distinct: DataFrame, radius: int = 4, few: int = _FEW) -> DataFrame:
    """Edges (a, b), a > b, whose transitive closure is that of all links within the radius.

    Two that are linked share a key of the filter. Links between a key's least
    fingerprint and the others come first; where these connect all of a key, nothing
    is left to find. Of the other keys, those of at most ``few`` fingerprints are
    compared pair by pair, and the fingerprints of larger ones emit their balls.
    """
    if radius % 4:
        raise ValueError("radius must be a multiple of 4")
    pairs = _near_pairs(distinct, radius)
    first = staged(_stars(pairs, radius), "star-links")
    apart = _apart(pairs, first)
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius
    x, y = (apart.filter(F.col("n") <= few).hint("merge").alias(i) for i in "xy")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.fingerprint") > F.col("y.fingerprint")) & (F.col("x.root") != F.col("y.root")) & near("x.fingerprint", "y.fingerprint"))
    met = met.select(F.col("x.fingerprint").alias("a"), F.col("y.fingerprint").alias("b"))

    possible = staged(apart.filter(F.col("n") > few).select("fingerprint").distinct(), "possible")
    spread = possible.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = _ball(spread, 64, "fingerprint", "variant", radius // 2)
    least = F.min("fingerprint").over(W.Window.partitionBy("variant"))
    edges = rows.withColumn("b", least).filter("fingerprint > b").select(F.col("fingerprint").alias("a"), "b")
    return first.unionByName(met).unionByName(edges.filter(near("a", "b"))).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """Per input row: id, fingerprint (signed long) and component_id.

    component_id is the smallest id reachable over links, the row's own included;
    rows of equal fingerprints always share it. Null and word-less texts have
    fingerprint 0 and link like any other. Rows whose id is null take part but
    never name a component; one made of them alone has a null component_id.
    Repeated rows are returned as often as they occur. Extra columns are ignored.
    """
    marks = staged(fingerprints(df, id_col, text_col, shingle, seed), "fingerprints")
    nodes = marks.groupBy("fingerprint").agg(F.min(id_col).alias("_least"))
    nodes = staged(nodes, "nodes")
    roots = components(staged(links(nodes.select("fingerprint"), radius), "links"))
    joined = nodes.join(roots, nodes.fingerprint == roots.node, "left")
    joined = joined.select("fingerprint", "_least", F.coalesce("root", "fingerprint").alias("root"))
    named = joined.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = joined.join(named, "root").select("fingerprint", "component_id")
    return marks.join(named, "fingerprint").select(id_col, "fingerprint", "component_id")


def keep_one_per_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """df without the near copies: of each component only the row with the smallest id stays.

    Of repeated rows with one id, one stays. Rows with null ids all stay. Texts are
    shuffled only where the ids to drop are too many to broadcast.
    """
    return keep_least(df, near_duplicates(df, id_col, text_col, shingle, radius), id_col)


def keep_least(df: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """df without the rows whose component (found: id, component_id) has a smaller id; see keep_one_per_group."""
    found = found.filter(F.col(id_col).isNotNull())
    found = staged(found.groupBy(id_col).agg(F.min("component_id").alias("least"), F.count("*").alias("n")), "groups")
    gone = staged(found.filter(F.col(id_col) > F.col("least")).select(F.col(id_col).alias("_id")), "gone")
    again = found.filter((F.col(id_col) <= F.col("least")) & (F.col("n") > 1)).select(F.col(id_col).alias("_id"))
    again = staged(again, "again")
    n_gone, n_again = gone.count(), again.count()
    kept = df.join(maybe_broadcast(gone, n_gone, 16), df[id_col] == gone["_id"], "left_anti")
    if not n_again:
        return kept
    once, repeated = (kept.join(maybe_broadcast(again, n_again, 16), kept[id_col] == again["_id"], how) for how in ("left_anti", "left_semi"))
    return once.unionByName(repeated.dropDuplicates([id_col]))
