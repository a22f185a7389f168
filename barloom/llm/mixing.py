"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document draws an exponential key, scaled by its quality weight; a source's
documents are taken in the order of their keys. A source whose target exceeds its
size is first taken whole, as many times as it fits; only the rest is a prefix of
that order. The prefix sum is taken in two levels: keys fall into buckets, bucket
sums give the offset of each bucket, and only the one bucket per source in which
the budget ends is sorted row by row. So no task holds a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.llm.common import maybe_broadcast, staged, word_count

#: What a source's plan is called beside the columns of a table.
_P = "_plan_"
#: Runs of these marks lower the default quality weight of a text.
MARKS = r"[#$%&*|!<>{}\\^~@_+=]+"


def text_quality(text: str = "text") -> Column:
    """Share of words among words and runs of marks, at least 0.05; 1 for an empty or null text."""
    marks = F.coalesce(F.regexp_count(F.col(text), F.lit(MARKS)), F.lit(0))
    words = word_count(text)
    return F.when(words + marks > 0, F.greatest(words / (words + marks), F.lit(0.05))).otherwise(F.lit(1.0))


def _keyed(df: DataFrame, id_col: str, text_col: str, source_col: str, quality: Column, seed: int) -> DataFrame:
    """_row (all of df's columns), _doc, _size, _source and _key, so that no name of df's can clash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.xxhash64(text_col), F.lit(seed)), 11)
    uniform = (bits + F.lit(0.5)) * F.lit(2.0**-53)
    key = (-F.ln(uniform) / quality).alias("_key")
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(id_col).alias("_doc"), word_count(text_col).alias("_size"), F.col(source_col).alias("_source"), key)


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most_epochs: int = 3) -> DataFrame:
    """One row per source (_source, source_size, n): weight, target, epochs and rest are added.

    Weights repeat over the sources in code point order, null last. The targets
    share the size of all sources by weight; a target stops at most_epochs times
    its source's size and the excess goes to the others by weight, until none is
    above. That is the level L with target = min(cap, L * weight): taken in the
    order of cap / weight, L is the first level that its own source can hold.
    """
    every = W.partitionBy(F.lit(0))
    at = F.row_number().over(every.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(at, F.lit(len(weights))).cast("int") + 1)
    out = sizes.withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(float(most_epochs))})
    out = out.withColumns({"ratio": F.col("cap") / F.col("weight"), "all_size": F.sum("source_size").over(every)})
    order = every.orderBy("ratio", F.col("_source").asc_nulls_last())
    filled = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    out = out.withColumn("_level", (F.col("all_size") - filled) / open_weight)
    level = F.min(F.when(F.col("_level") <= F.col("ratio"), F.struct("ratio", "_level"))).over(every)["_level"]
    out = out.withColumn("target", F.when(F.col("ratio") <= level, F.col("cap")).otherwise(F.coalesce(level, F.lit(0.0)) * F.col("weight")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    return out.select("_source", "source_size", "n", "target", "epochs", "rest")


def _bucket(rows_per_bucket: int) -> Column:
    """Buckets rise with the key; a source has about as many as its rows need."""
    count = F.ceil(F.col(_P + "n") / F.lit(float(rows_per_bucket)))
    return F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * count).cast("long")


def _plan(rows: DataFrame, id_col: str, weights: Sequence[float], most_epochs: int, rows_per_bucket: int) -> tuple[DataFrame, DataFrame]:
    """Per source: targets and the bucket in which its budget ends; and the rows picked in these buckets."""
    sizes = rows.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("n"))
    targets = staged(source_targets(sizes, weights, most_epochs), "targets")
    keyed = _with_plan(rows, targets, rows_per_bucket)
    sums = keyed.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum"), F.first(_P + "rest").alias("rest"))
    before = F.sum("_sum").over(W.partitionBy("_source").orderBy("_bucket")) - F.col("_sum")
    cuts = sums.withColumn("cut_offset", before).filter("cut_offset <= rest AND rest < cut_offset + _sum")
    cuts = cuts.select(F.col("_source").alias("_of"), F.col("_bucket").alias("cut"), "cut_offset")
    plan = staged(targets.join(cuts, targets["_source"].eqNullSafe(cuts["_of"]), "left").drop("_of"), "plan")
    edge = _with_plan(rows, plan, rows_per_bucket).filter(F.col("_bucket") == F.col(_P + "cut"))
    upto = F.sum("_size").over(W.partitionBy("_source").orderBy("_key", id_col))
    alike = F.sum("_size").over(W.partitionBy("_source", "_key", id_col))
    edge = edge.withColumn("_middle", F.col(_P + "cut_offset") + upto - alike / 2)
    return plan, staged(edge.filter(F.col("_middle") <= F.col(_P + "rest")).select(F.col(id_col).alias("_id"), F.col("_key").alias("_edge")).distinct(), "edge")


def _with_plan(rows: DataFrame, plan: DataFrame, rows_per_bucket: int) -> DataFrame:
    named = plan.select(F.col("_source").alias("_of"), *[F.col(c).alias(_P + c) for c in plan.columns if c != "_source"])
    small = maybe_broadcast(named, named.count(), 200)
    return rows.join(small, rows["_source"].eqNullSafe(small["_of"])).drop("_of").withColumn("_bucket", _bucket(rows_per_bucket))


def _copies(rows: DataFrame, plan: DataFrame, edge: DataFrame, id_col: str, rows_per_bucket: int) -> DataFrame:
    edge = maybe_broadcast(edge, edge.count(), 64)
    out = _with_plan(rows, plan, rows_per_bucket)
    out = out.join(edge, out[id_col].eqNullSafe(edge["_id"]) & (out["_key"] == edge["_edge"]), "left")
    picked = F.coalesce(F.col("_bucket") < F.col(_P + "cut"), F.lit(False)) | F.col("_edge").isNotNull()
    picked = picked & (F.col(_P + "rest") > 0)  # else texts without words, which any budget holds, had one copy too many
    return out.withColumn("_copies", F.col(_P + "epochs") + picked.cast("long"))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    most_epochs: int = 3,
    quality: Column | None = None,
    seed: int = 17,
    rows_per_bucket: int = 4096,
) -> DataFrame:
    """How much of each row the mix takes: id, source, size, source_size, target, copies, taken.

    One row per input row. size counts words, a null or empty text has 0 and takes
    0; a null source is a source of its own. A row is picked where the middle of
    its words lies within the budget, so a source misses its target by half a
    document at most. Repeated rows (same id and text) are picked all or none. An
    empty table gives an empty result. quality (default 1) must be positive; extra
    columns are ignored. The same input gives the same result in any partitioning.
    """
    rows = _keyed(df, id_col, text_col, source_col, F.lit(1.0) if quality is None else quality, seed)
    rows = staged(rows.select("_doc", "_source", "_size", "_key"), "sizes")
    plan, edge = _plan(rows, "_doc", weights, most_epochs, rows_per_bucket)
    out = _copies(rows, plan, edge, "_doc", rows_per_bucket)
    plan_columns = [F.col(_P + c).alias(c) for c in ("source_size", "target")]
    taken = (F.col("_size") * F.col("_copies")).alias("taken")
    return out.select(F.col("_doc").alias(id_col), F.col("_source").alias("source"), F.col("_size").alias("size"), *plan_columns, F.col("_copies").alias("copies"), taken)


def mixture(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    most_epochs: int = 3,
    quality: Column | None = None,
    seed: int = 17,
    rows_per_bucket: int = 4096,
) -> DataFrame:
    """The mix itself: each row of df as many times as mix() takes it, with df's columns. Texts are not shuffled.

    Rows with null ids, texts or sources, ties and repeated rows are taken as mix()
    takes them; a source without any words gives no rows; an empty table none.
    """
    keyed = _keyed(df, id_col, text_col, source_col, F.lit(1.0) if quality is None else quality, seed)
    rows = staged(keyed.select("_doc", "_source", "_size", "_key"), "sizes")
    plan, edge = _plan(rows, "_doc", weights, most_epochs, rows_per_bucket)
    out = _copies(keyed, plan, edge, "_doc", rows_per_bucket)
    out = out.filter("_copies > 0").withColumn("_copy", F.explode(F.expr("sequence(1L, _copies)")))
    return out.select("_row.*")
