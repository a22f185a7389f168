"""Windows, running values and medians of one long series as many tasks.

A window over a key is one task per key, so one series of any length is one task.
Here a series is cut into blocks of rows. Windows of bounded reach get blocks with
the rows before and after that they need (``haloed``); running values are taken
within blocks and carried from block to block by a scan over one row per block
(``scanned``); a median is selected by counts per bucket of values (``median``), so
no state holds a whole group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows of a block; days of the spans in which places are counted first.
BLOCK, SPAN = 4096, 366


def joined(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """left with right's other columns where all of ``on`` agree, nulls with nulls."""
    if not on:
        raise ValueError("a join needs columns")
    renamed = right.withColumnsRenamed({c: f"_{c}_right" for c in on})
    return left.join(renamed, [left[c].eqNullSafe(renamed[f"_{c}_right"]) for c in on], how).drop(*(f"_{c}_right" for c in on))


def placed(df: DataFrame, key: Sequence[str], time: str = "date", span: int = SPAN) -> DataFrame:
    """df with _place, each row's place from 0 in the order of time within its key, and _span.

    Rows are counted per key and span of days, and the counts of earlier spans are
    added: the widest window holds one span. Of rows with one time the order is
    arbitrary; a null time comes first.
    """
    days = F.coalesce(F.unix_date(F.col(time).cast("date")), F.lit(-(2**31)))
    rows = df.withColumn("_span", F.floor(days / span))
    key = [*key, "_span"]
    counts = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*(key[:-1] or [F.lit(0)])).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(W.partitionBy(*key).orderBy(time)) - 1
    return joined(rows.withColumn("_own", own), counts, key).withColumn("_place", F.col("_own") + F.col("_before")).drop("_own", "_before")


def haloed(df: DataFrame, key: Sequence[str], time: str = "date", before: int = 0, after: int = 0, rows: int = BLOCK) -> DataFrame:
    """df with _block and _inside: each row in its own block (_inside) and, as a halo, in those whose windows reach it.

    A window over (key, _block) that reaches at most ``before`` rows back and
    ``after`` rows ahead is right on the rows that are _inside; the rest are to be
    dropped after it. A row is in three blocks at most.
    """
    if rows < max(before, after, 1):
        raise ValueError(f"a block of {rows} rows is shorter than the windows' reach")
    out = placed(df, key, time).drop("_span").withColumn("_home", F.floor(F.col("_place") / rows))
    at = F.col("_place") % rows
    homes = [F.col("_home"), F.when(at >= rows - before, F.col("_home") + 1), F.when((at < after) & (F.col("_home") > 0), F.col("_home") - 1)]
    out = out.withColumn("_block", F.explode(F.array_compact(F.array(*homes))))
    return out.withColumn("_inside", F.col("_block") == F.col("_home")).drop("_home", "_place")


def inside(df: DataFrame) -> DataFrame:
    """The rows that are in their own block, without haloed's columns."""
    return df.filter("_inside").drop("_block", "_inside")


_Carry = tuple[Callable[[Column], Column], Callable[[Column], Column], Callable[[Column, Column], Column]]
#: Running values by kind: within a block, over the blocks before, and both together.
_KINDS: dict[str, _Carry] = {
    "sum": (F.sum, F.sum, lambda own, carried: F.coalesce(own + carried, own, carried)),
    "max": (F.max, F.max, F.greatest),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda c: F.last(c, ignorenulls=True), F.coalesce),
}


def scanned(df: DataFrame, key: Sequence[str], running: dict[str, tuple[str, Column]], time: str = "date", span: int = SPAN) -> DataFrame:
    """df with running values over each key in the order of time, up to and with each row.

    running: new column -> (kind, value), kinds sum (nulls add nothing), max and
    last (the last value that is not null); NULL before the first value. The widest windows hold a span of days,
    or one row for each span of a series.
    """
    out = df.withColumn("_span", F.floor(F.unix_date(F.col(time).cast("date")) / span))
    out = out.withColumns({f"_value_{name}": value for name, (_, value) in running.items()})
    spans = [*key, "_span"]
    own = W.partitionBy(*spans).orderBy(time).rowsBetween(W.unboundedPreceding, 0)
    totals = [F.max_by(f"_value_{n}", F.when(F.col(f"_value_{n}").isNotNull(), F.col(time))).alias(f"_total_{n}") if kind == "last" else _KINDS[kind][0](F.col(f"_value_{n}")).alias(f"_total_{n}") for n, (kind, _) in running.items()]
    before = W.partitionBy(*(key or [F.lit(0)])).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    carried = out.groupBy(*spans).agg(*totals)
    carried = carried.select(*spans, *[_KINDS[kind][1](F.col(f"_total_{n}")).over(before).alias(f"_carried_{n}") for n, (kind, _) in running.items()])
    out = out.withColumns({f"_own_{n}": _KINDS[kind][0](F.col(f"_value_{n}")).over(own) for n, (kind, _) in running.items()})
    # one carried row per span: never many for one key of the join
    lookup = carried.withColumnRenamed("_span", "_at_span")
    lookup = lookup.withColumnsRenamed({k: f"_at_{k}" for k in key})
    out = out.join(lookup, [out["_span"] == lookup["_at_span"], *(out[k].eqNullSafe(lookup[f"_at_{k}"]) for k in key)], "left").drop("_at_span", *(f"_at_{k}" for k in key))
    out = out.withColumns({n: _KINDS[kind][2](F.col(f"_own_{n}"), F.col(f"_carried_{n}")) for n, (kind, _) in running.items()})
    return out.drop("_span", *(f"_{part}_{n}" for n in running for part in ("value", "own", "carried")))


def median(df: DataFrame, key: Sequence[str], value: str, name: str, buckets: int = 4096, rounds: int = 2) -> DataFrame:
    """key and name: the exact median of value per key (the mean of the middle two of an even number), NULL without values.

    Each round cuts the range that holds a middle value into equal buckets, counts
    them, and keeps the one in which it lies; then equal values are counted once and
    the few distinct ones that are left are gone through in order. Values must be
    finite. An aggregate's state is a count, whatever the size of the group.
    """
    rows = df.select(*key, F.col(value).cast("double").alias("_v")).groupBy(*key, "_v").agg(F.count("_v").alias("_c")).filter("_v IS NOT NULL")
    ends = rows.groupBy(*key).agg(F.sum("_c").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    middle = F.explode(F.array_distinct(F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)))).alias("_want")
    asked = ends.select(*key, "_lo", "_hi", middle).withColumn("_rank", F.col("_want"))
    # halves, so that the width of a range stays finite
    width = F.col("_hi") / 2 - F.col("_lo") / 2
    place = F.when(width > 0, F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / width * buckets), F.lit(buckets - 1))).otherwise(F.lit(0))
    within = [*key, "_want"]
    for _ in range(rounds):
        held = joined(rows, asked, key).filter("_v BETWEEN _lo AND _hi").withColumn("_b", place)
        counts = held.groupBy(*within, "_b", "_rank").agg(F.sum("_c").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        before = F.sum("_n").over(W.partitionBy(*within).orderBy("_b")) - F.col("_n")
        counts = counts.withColumn("_before", before).filter("_before <= _rank AND _rank < _before + _n")
        asked = counts.select(*within, F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), (F.col("_rank") - F.col("_before")).alias("_rank"))
    last = joined(rows, asked, key).filter("_v BETWEEN _lo AND _hi")
    before = F.sum("_c").over(W.partitionBy(*within).orderBy("_v")) - F.col("_c")
    found = last.withColumn("_before", before).filter("_before <= _rank AND _rank < _before + _c")
    return found.groupBy(*key).agg(F.avg("_v").alias(name))
