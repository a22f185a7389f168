"""Line dedup by a deletion-neighbourhood join, with words as the unit of an edit.

A line goes if an earlier line (by document id, then line number) has the same
words, or words within one insertion, deletion or substitution. Every line emits
the hash of each variant with one word left out, and of itself. Lines that share a
variant left out at the same place differ by a substitution; a line whose own hash
is another's variant differs by a deletion. So each bucket needs only its earliest
line, never its pairs; candidates are verified on their words at the end.

Variants are as many as there are words, so lines that cannot have a partner are
set aside first, without loss: of two lines one edit apart, either the first or the
last m words are the same if the shorter line has 2m words or more, so a line whose
keys of that kind no other line shares has no partner.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import maybe_broadcast, staged, unused

#: Odd multiplier of the rolling hash over words, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_ROWS = 256
#: Words of the shortest line that goes where it repeats, and of the shortest that goes for one word edit.
MIN_WORDS, WORDS_PER_EDIT = 1, 10
KEY = ("k1", "k2")
_KEY_FIELDS = [T.StructField(k, T.LongType()) for k in KEY]


def line_key(words: list[bytes]) -> bytes:
    return hashlib.md5(b" ".join(words), usedforsecurity=False).digest()


def half_keys(words: list[bytes]) -> list[int]:
    """Keys of the first and last 2c words, where c is a quarter of the word count.

    Lines of n - 1 and n words have the same c, except where 4 divides n: there
    the longer line has the keys of c - 1 too.
    """
    n, keys = len(words), []
    for c in (n // 4, n // 4 - 1)[: 1 + (n % 4 == 0)]:
        keys.append(xxhash.xxh64_intdigest(b" ".join(words[: 2 * c]), 2 * c))
        keys.append(xxhash.xxh64_intdigest(b" ".join(words[n - 2 * c :]), 2 * c + 1))
    return keys


def _key_columns(keys: list[bytes]) -> list[pa.Array]:
    """The 128-bit keys as two columns of longs, which Spark aggregates and joins without objects."""
    both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def variants(words: list[bytes]) -> np.ndarray:
    """Hashes of the line with word 0, 1, ... left out, and last that of the whole line."""
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words) - 1, _BASE, np.uint64)]))
    upto = np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers)])
    without = upto[:-1] + (upto[-1] - upto[1:]) * _INVERSE
    return np.concatenate([without, upto[-1:]])


def within_one_edit(a: str, b: str) -> bool:
    """Whether two lines differ by at most one inserted, deleted or substituted word."""
    x, y = a.split(" "), b.split(" ")
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    at = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), len(x))
    return x[at + (len(x) == len(y)) :] == y[at + 1 :]


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split(b"\n")


def lines(df: DataFrame, id_col: str, text_col: str, min_words: int, words_per_edit: int) -> DataFrame:
    """(doc, line, k1, k2, halves) of all lines of min_words or more; halves is empty below words_per_edit words."""
    schema = T.StructType([T.StructField("doc", df.schema[id_col].dataType), T.StructField("line", T.IntegerType()), *_KEY_FIELDS, T.StructField("halves", T.ArrayType(T.LongType()))])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                rows, numbers, keys, halves = [], [], [], []
                for row, text in enumerate(part.column("text").to_pylist()):
                    for number, line in enumerate(_split(text)):
                        words = line.split()
                        if len(words) >= min_words:
                            rows.append(row)
                            numbers.append(number)
                            keys.append(line_key(words))
                            halves.append(np.array(half_keys(words), np.uint64).view(np.int64) if len(words) >= words_per_edit else ())
                docs = part.column("doc").take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays([docs, pa.array(numbers, pa.int32()), *_key_columns(keys), pa.array(halves, pa.list_(pa.int64()))], schema.names)

    return df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(batches, schema)


def _texts(df: DataFrame, text_col: str, words_per_edit: int) -> DataFrame:
    """(k1, k2, words) of all lines that can have variants, repeated lines as often as they occur."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for at in range(0, batch.num_rows, _ROWS):
                split = (line.split() for text in batch.column("text").slice(at, _ROWS).to_pylist() for line in _split(text))
                long = [words for words in split if len(words) >= words_per_edit]
                yield pa.RecordBatch.from_arrays([*_key_columns([line_key(w) for w in long]), pa.array([b" ".join(w).decode() for w in long], pa.string())], [*KEY, "words"])

    return df.select(F.col(text_col).alias("text")).mapInArrow(batches, "k1 long, k2 long, words string")


def _variant_rows(candidates: DataFrame) -> DataFrame:
    """(variant, place, k1, k2, first) of each candidate; place -1 is the whole line."""
    schema = T.StructType([T.StructField("variant", T.LongType()), T.StructField("place", T.IntegerType()), *(candidates.schema[n] for n in (*KEY, "first"))])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                made = [variants([w.encode() for w in words.split(" ")]) for words in part.column("words").to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(made)), [len(m) for m in made]))
                places = np.concatenate([np.append(np.arange(len(m) - 1, dtype=np.int32), np.int32(-1)) for m in made])
                values = np.concatenate(made).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(places, pa.int32()), *(part.column(n).take(rows) for n in (*KEY, "first"))], schema.names)

    return candidates.mapInArrow(batches, schema)


def _shared(rows: DataFrame, by: str, tag: str) -> DataFrame:
    """Values of column by that lines of different keys have. Counts per value only."""
    ends = [f(k).alias(f"{n}_{k}") for k in KEY for n, f in (("lo", F.min), ("hi", F.max))]
    found = staged(rows.groupBy(by).agg(*ends).filter("lo_k1 < hi_k1 OR lo_k2 < hi_k2").select(by), tag)
    return maybe_broadcast(found, found.count(), 16)


def _earlier(rows: DataFrame) -> DataFrame:
    """(k1, k2, o1, o2): for each line, per bucket, the earliest line of the bucket if that comes before it."""
    other = lambda s: [F.col(f"{s}.k1").alias("o1"), F.col(f"{s}.k2").alias("o2")]
    order = F.struct("first", *KEY)
    out_rows, whole = rows.filter("place >= 0"), rows.filter("place < 0").select("variant", order.alias("whole"))
    best = F.min(order).alias("best")
    same = out_rows.groupBy("variant", "place").agg(best, F.count("*").alias("n")).filter("n > 1").drop("n")
    substituted = out_rows.join(same, ["variant", "place"]).filter("best.first < first").select(*KEY, *other("best"))
    shorter = out_rows.join(whole, "variant").filter("whole.first < first").select(*KEY, *other("whole"))
    longer = whole.join(out_rows.groupBy("variant").agg(best), "variant").filter("best.first < whole.first")
    longer = longer.select("whole.k1", "whole.k2", *other("best"))
    return substituted.unionByName(shorter).unionByName(longer).distinct()


def _one_edit(a: str, b: str) -> Column:
    @F.pandas_udf("boolean")
    def check(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([within_one_edit(p, q) for p, q in zip(x, y, strict=True)], dtype=bool)

    return check(a, b)


def near_repeats(df: DataFrame, text_col: str, found: DataFrame, distinct: DataFrame, words_per_edit: int) -> DataFrame:
    """Keys of the distinct lines (k1, k2, first) that are one edit from an earlier line; found is from lines()."""
    halves = found.filter(F.size("halves") > 0).select(*KEY, F.explode("halves").alias("half"))
    wanted = halves.join(_shared(halves, "half", "half-lines"), "half", "left_semi").select(*KEY).distinct()
    wanted = staged(wanted.join(distinct.select(*KEY, "first"), list(KEY)), "wanted")
    texts = _texts(df, text_col, words_per_edit).join(maybe_broadcast(wanted, wanted.count(), 64), list(KEY))
    candidates = staged(texts.groupBy(*KEY).agg(F.first("words").alias("words"), F.first("first").alias("first")), "candidates")
    spread = candidates.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY)
    rows = staged(_variant_rows(spread.select(*KEY, "words", "first")), "variants")
    rows = staged(rows.join(_shared(rows, "variant", "shared-variants"), "variant", "left_semi"), "buckets")
    others = candidates.select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("words").alias("other_words"))
    pairs = _earlier(rows).join(candidates.select(*KEY, "words"), list(KEY)).join(others, ["o1", "o2"])
    return pairs.filter(_one_edit("words", "other_words")).select(*KEY).distinct()


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, words_per_edit: int = WORDS_PER_EDIT) -> DataFrame:
    """(doc, dropped): the line numbers, from 0, that each document loses; documents that lose none are absent."""
    found = staged(lines(df, id_col, text_col, min_words, words_per_edit), "lines")
    distinct = staged(found.groupBy(*KEY).agg(F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("n")), "distinct")
    near = near_repeats(df, text_col, found, distinct, words_per_edit).withColumn("near", F.lit(True))
    decided = staged(distinct.join(near, list(KEY), "left").filter("n > 1 OR near").drop("n"), "decided")
    occurs = found.select("doc", "line", *KEY).join(maybe_broadcast(decided, decided.count(), 64), list(KEY))
    gone = occurs.filter(F.col("near").isNotNull() | ~F.struct("doc", "line").eqNullSafe(F.col("first")))
    return gone.groupBy("doc").agg(F.collect_set("line").alias("dropped"))


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, words_per_edit: int = WORDS_PER_EDIT, n_chars_col: str = "n_chars", counts: tuple[str, str] | None = ("n_lines", "n_dropped")
) -> DataFrame:
    """df with repeated lines taken out of its texts, and the columns of counts (how many lines, how many dropped) added.

    Lines are separated by newlines, words by ASCII white space. Lines under
    min_words words always stay; lines of words_per_edit or more also go when an
    earlier line is one word edit away, whether that line stays or not. The first
    of equal lines stays. Every row stays, if need be with an empty text; null
    texts stay null; null ids come first in the order; rows with equal ids count
    as one document. n_chars_col, where df has it, follows the new text. Columns
    of df with the names of counts are replaced; with counts None, df's columns
    are all that is returned. An empty table gives an empty result.
    """
    doc, drop_col = unused(df, "doc", "dropped")
    dropped = repeated_lines(df, id_col, text_col, min_words, words_per_edit).withColumnsRenamed({"doc": doc, "dropped": drop_col})
    joined = df.join(dropped, df[id_col].eqNullSafe(dropped[doc]), "left").drop(doc, *(counts or ()))
    names = [f.name for f in joined.schema.fields if f.name != drop_col]
    schema = T.StructType([*(joined.schema[n] for n in names), *(T.StructField(n, T.LongType()) for n in counts or ())])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                texts, totals, gone = [], [], []
                for text, drop in zip(part.column(text_col).to_pylist(), part.column(drop_col).to_pylist(), strict=True):
                    split = [] if text is None else text.split("\n")
                    drop = set(drop or ())
                    texts.append("\n".join(x for i, x in enumerate(split) if i not in drop) if drop and text is not None else text)
                    totals.append(len(split))
                    gone.append(len([i for i in drop if i < len(split)]))
                columns = {n: part.column(n) for n in names} | {text_col: pa.array(texts, pa.string())}
                if n_chars_col in columns:
                    columns[n_chars_col] = pa.array([None if t is None else len(t) for t in texts], columns[n_chars_col].type)
                added = [pa.array(totals, pa.int64()), pa.array(gone, pa.int64())] if counts else []
                yield pa.RecordBatch.from_arrays([*columns.values(), *added], schema.names)

    return joined.mapInArrow(batches, schema)
