"""Repeated byte strings by sorting sampled suffixes, named by triples, recursively.

Removed is every byte of a string of ``length`` bytes that starts anywhere else
too. A plain suffix array of all bytes would shuffle each byte's suffix many times,
so three things come before, all without loss:

1. Of texts that occur several times whole, nothing has to be compared.
2. Any two equal strings have the same anchor (the least hash of 16 bytes among
   their first ones), and from it on the same core. Only the surroundings of cores
   that occur twice are kept, as pieces. Cores are looked up in a bit table of fixed
   size; what it passes by mistake costs time only.
3. The sample: suffixes at cuts, places whose hash of 8 bytes is below all of those
   that follow within PHRASE. It takes the place of fixed residues: equal strings
   have the same cuts, whatever their positions. (Periodic text has none.)

Between cuts lie phrases, each taken with the bytes that make the next cut one, so
that none is a proper prefix of another and their order is that of the suffixes. Triples of
phrases are sorted and get their place as name, then triples of names, until names
cover as many bytes as matter: a sorted array of the sampled suffixes. Neighbours
in it are compared: a phrase whose suffix agrees with a neighbour's on all windows
that begin in it is repeated whole. The remaining suffixes, windows that begin
between cuts near the ends of repeated stretches, join those of their order by what
lies before their next cut: they are compared as whole windows, but blocks of them
first. The bytes that all windows of a block share must occur twice if any of them
does; if all bytes of a block occur twice, so do all its windows. Only windows of
blocks that neither settles, at the edges of repeated stretches, are rows.
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

from barloom.llm.common import staged

#: Bits of the tables that tasks get (of cores and of texts): 8 MB each, at any size of the corpus.
BITS = 1 << 26
#: Starts among which an anchor is the least; mean bytes between cuts; phrases up to this length are compared whole.
ANCHOR, PHRASE, WHOLE = 192, 64, 192
#: Phrases that names cover before the few suffixes are sorted whole that need more; rungs of the ladder of prefixes.
COVERED, RUNGS = 27, 8
#: Windows that begin so many bytes before the same cut are compared as one block first.
BLOCK = 8
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number."""
    out = np.empty(max(0, len(data) - 7), np.uint64)
    for i in range(min(8, len(out))):
        n = (len(data) - i) // 8
        out[i::8] = data[i : i + 8 * n].view(np.uint64)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C2
    return x ^ (x >> np.uint64(29))


def _sliding(x: np.ndarray, n: int, of: np.ufunc) -> np.ndarray:
    """of over each n neighbours."""
    step = 1
    while 2 * step <= n:
        x, step = of(x[:-step], x[step:]), 2 * step
    return of(x[: len(x) - (n - step)], x[n - step :]) if n > step else x


def anchors(data: np.ndarray, length: int, among: int) -> np.ndarray:
    """Places of which each string of ``length`` bytes has one among its first ``among``, by its own bytes alone."""
    if len(data) < length:
        return np.zeros(0, np.int64)
    x = _eights(data)
    h = _mixed(x[:-8] * _C1 ^ _mixed(x[8:]))[: len(data) - length + among]
    least = _sliding(h, among, np.minimum)
    edge = np.zeros(among - 1, np.uint64)
    return np.flatnonzero(h == _sliding(np.concatenate([edge, least, edge]), among, np.maximum))


def _cores(text: bytes, length: int, among: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of a text and the hashes of the bytes from them on that all their strings share."""
    at = anchors(np.frombuffer(text, np.uint8), length, among)
    view, n = memoryview(text), length - among + 1
    return at, np.fromiter((xxhash.xxh3_64_intdigest(view[i : i + n]) for i in at.tolist()), np.uint64, len(at))


def bit_table(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bits at the values of a long column modulo ``bits``, as numbers of 64 bits; at most bits / 64 rows reach the driver."""
    at = F.pmod(column, F.lit(bits))
    words = df.select(F.floor(at / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod({column}, {bits}L) % 64 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    return out


def in_table(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.astype(np.int64) % (64 * len(table))
    return (table[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) > 0


def _longs(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array(a.view(np.int64) if a.dtype == np.uint64 else a) for a in arrays]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for a, b, text in zip(part.column("k1").to_pylist(), part.column("k2").to_pylist(), part.column("text").to_pylist(), strict=True):
                yield a, b, text


def _pieces(docs: DataFrame, length: int, bits: int) -> DataFrame:
    """(pid, k1, k2, start, bytes): the parts of distinct texts that hold all their strings which repeat, and little else."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, text in _texts(batches):
            at, cores = _cores(text, length, ANCHOR)
            place = _mixed((at.astype(np.uint64) + np.uint64(1)) * _C1 + np.uint64(a & (2**64 - 1))) ^ np.uint64(b & (2**64 - 1))
            if len(at):
                yield pa.RecordBatch.from_arrays(_longs(cores, place), ["core", "place"])

    places = docs.mapInArrow(marks, "core long, place long").groupBy("core").agg(F.min("place").alias("a"), F.max("place").alias("b"))
    table = docs.sparkSession.sparkContext.broadcast(bit_table(places.filter("a <> b"), "core", bits))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, text in _texts(batches):
            at, cores = _cores(text, length, ANCHOR)
            at = at[in_table(table.value, cores.view(np.int64))]
            if not len(at):
                continue
            lo, hi = np.maximum(at - ANCHOR + 1, 0), np.minimum(at + length, len(text))
            new = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
            lo, hi = lo[new], hi[np.append(new[1:] - 1, len(hi) - 1)]
            parts = pa.array([text[i:j] for i, j in zip(lo, hi, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*_longs(np.full(len(lo), a), np.full(len(lo), b), lo), parts], ["k1", "k2", "start", "bytes"])

    found = docs.mapInArrow(cut, "k1 long, k2 long, start long, bytes binary").dropDuplicates(["k1", "k2", "start"])
    return staged(found.withColumn("pid", F.monotonically_increasing_id()), "pieces")


_ROWS = "pid long, t int, at int, gap int, p1 long, p2 long, phrase binary, whole long, core long, ladder long"
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]


def _phrases(pieces: DataFrame, length: int) -> DataFrame:
    """A row per cut of each piece, the piece's start being one: place, bytes up to the next cut, phrase, and two hashes.

    whole: the bytes of all windows that begin before the next cut; core: those that
    all windows share which begin at most WHOLE before this cut. Null beyond the piece.
    ladder: a byte of the hash of each of RUNGS prefixes, the shortest first and lowest.
    """
    rungs = [length - WHOLE + i * WHOLE // RUNGS for i in range(RUNGS)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pid, text in zip(batch.column("pid").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                x = _mixed(_eights(np.frombuffer(text, np.uint8)) * _C1)
                least = _sliding(x[2:], PHRASE - 1, np.minimum) if len(x) > PHRASE else x[:0]
                at = np.append(0, np.flatnonzero(x[1 : len(least) + 1] < least) + 1)
                to = np.append(at[1:], len(text))
                view, n, core = memoryview(text), len(text), length - WHOLE
                phrases, whole, cores, ladders = [], [], [], []
                for i, j in zip(at.tolist(), to.tolist(), strict=True):
                    phrases.append(text[i : j + PHRASE + 7])
                    fits = j - i <= WHOLE and j < n and j + length - 1 <= n
                    whole.append(xxhash.xxh3_64_intdigest(view[i : j + length - 1]) - 2**63 if fits else None)
                    cores.append(xxhash.xxh3_64_intdigest(view[i : i + core]) - 2**63 if i + core <= n else None)
                    ladders.append(b"".join(xxhash.xxh3_64_digest(view[i : i + r])[:1] for r in rungs))
                keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(p) for p in phrases), "<i8").reshape(-1, 2)
                numbers = [pa.array(np.full(len(at), pid)), *(pa.array(a.astype(np.int32)) for a in (np.arange(len(at)), at, to - at))]
                yield pa.RecordBatch.from_arrays([*numbers, pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(phrases, pa.binary()), pa.array(whole, pa.int64()), pa.array(cores, pa.int64()), pa.array(np.frombuffer(b"".join(ladders), "<i8"))], _NAMES)

    return staged(pieces.select("pid", "bytes").mapInArrow(cut, _ROWS), "phrases")


def _ordered(df: DataFrame, keys: list[str], name: str, tag: str) -> DataFrame:
    """df, of distinct keys, with numbers from 1 in their order (not without gaps); written, so they stay."""
    return staged(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id() + 1), tag)


def suffix_order(rows: DataFrame, depth: int) -> DataFrame:
    """(pid, t, name, rest): the sampled suffixes of rows (pid, t, p1, p2, phrase, gap) in order by ``depth`` bytes at least.

    Names of phrases first, then of triples: three names of the last round, each
    where the one before ends. A name's number is its place in order. Suffixes whose
    names still cover fewer bytes (of very short phrases) are sorted once more by all
    their names; rest is that order, 0 for the others.
    """
    names = _ordered(rows.groupBy("p1", "p2").agg(F.min("phrase").alias("phrase")), ["phrase"], "name", "names").drop("phrase")
    named = staged(rows.select("pid", "t", "p1", "p2", F.col("gap").cast("long").alias("cover")).join(names.hint("merge"), ["p1", "p2"]).select("pid", "t", "name", "cover"), "named")
    w, step = W.partitionBy("pid").orderBy("t"), 1
    while step < COVERED:
        later = {f"n{i}": F.coalesce(F.lead("name", i * step).over(w), F.lit(0)) for i in (1, 2)}
        # beyond the end of a piece nothing can differ
        cover = sum((F.coalesce(F.lead("cover", i * step).over(w), F.lit(depth)) for i in (1, 2)), F.col("cover"))
        triples = staged(named.withColumns(later).withColumn("cover", F.least(cover, F.lit(depth))).withColumnRenamed("name", "n0"), "triples")
        keys = ["n0", "n1", "n2"]
        names = _ordered(triples.select(*keys).distinct(), keys, "name", "names")
        named = staged(triples.join(names.hint("merge"), keys).select("pid", "t", "name", "cover"), "named")
        step *= 3
    # a phrase has a byte at least, and all suffixes of one name cover as much
    every = F.array(*[F.coalesce(F.lead("name", i * step).over(w), F.lit(0)) for i in range(-(-depth // step))])
    short = staged(named.withColumn("names", every).filter(F.col("cover") < depth).drop("cover"), "short")
    order = _ordered(short.select("names").distinct(), ["names"], "rest", "names")
    short = short.join(order.hint("merge"), "names").select("pid", "t", "name", "rest")
    return named.filter(F.col("cover") >= depth).select("pid", "t", "name", F.lit(0).cast("long").alias("rest")).unionByName(short)


def _compared(ranked: DataFrame) -> DataFrame:
    """Per (name, rest) of ranked (and whole, ladder, pid, t): repeated and leads (whole is a neighbour's, and none before has it), rungs (equal ones of a neighbour), one."""
    each = ranked.groupBy("name", "rest").agg(F.count("*").alias("n"), F.min("whole").alias("whole"), F.min("ladder").alias("ladder"), F.min(F.struct("pid", "t")).alias("one"))
    each = staged(each.withColumn("part", F.shiftright("name", 33)), "ranks")
    # names come from a range-partitioned sort: one window per range, and the ranges' ends (a row each) aside
    own = F.struct("whole", "ladder")
    ends = each.groupBy("part").agg(*[f(own, F.struct("name", "rest")).alias(n) for n, f in (("first", F.min_by), ("last", F.max_by))])
    order = W.partitionBy(F.lit(0)).orderBy("part")
    ends = ends.select("part", F.lag("last").over(order).alias("_last"), F.lead("first").over(order).alias("_first"))
    w = W.partitionBy("part").orderBy("name", "rest")
    rows = each.withColumns({"_before": F.lag(own).over(w), "_after": F.lead(own).over(w)}).join(F.broadcast(ends), "part")
    rows = rows.withColumns({"_before": F.coalesce("_before", "_last"), "_after": F.coalesce("_after", "_first")})
    same = lambda side: F.coalesce(F.col(f"{side}.whole") == F.col("whole"), F.lit(False))
    repeated = F.col("whole").isNotNull() & ((F.col("n") > 1) | same("_before") | same("_after"))

    def equal(side: str) -> Column:
        differ, found = F.col("ladder").bitwiseXOR(F.col(f"{side}.ladder")), F.lit(RUNGS)
        for i in reversed(range(RUNGS)):
            found = F.when(F.shiftrightunsigned(differ, 8 * i).bitwiseAND(F.lit(255)) != 0, F.lit(i)).otherwise(found)
        return F.when(differ.isNull(), 0).otherwise(found)

    rungs = F.when(F.col("n") > 1, RUNGS).otherwise(F.greatest(equal("_before"), equal("_after")))
    return rows.select("name", "rest", repeated.alias("repeated"), (repeated & ~same("_before")).alias("leads"), rungs.alias("rungs"), "one")


def _settled(pieces: DataFrame, tried: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(pid, lo, hi) of windows that repeat as whole blocks, and (pid, lo, hi, ask) of those that are still to be compared.

    tried: spans (lo, hi) of windows by pid, each before its cut (null: none that its
    windows hold) and either asking or only answering. Equal windows that begin at
    most WHOLE bytes before their cut are as far from it, and so in the same block
    of it; the others stay as they are.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pid, text, spans in zip(*(batch.column(c).to_pylist() for c in ("pid", "bytes", "spans")), strict=True):
                view, top, rows = memoryview(text), len(text) - length + 1, []
                for x in spans:
                    lo, hi, end, ask = x["lo"], min(x["hi"], top), x["cut"], x["ask"]
                    far = hi if end is None else min(hi, end - WHOLE)
                    if far > lo:
                        rows.append((lo, far, ask, None, None, None))
                    lo = max(lo, far)
                    while lo < hi:
                        first = end - (-(-(end - lo) // BLOCK)) * BLOCK
                        to = min(hi, first + BLOCK)
                        core = xxhash.xxh3_64_intdigest(view[first + BLOCK - 1 : first + length]) - 2**63
                        # only blocks that lie in one gap count as a place
                        two = np.frombuffer(xxhash.xxh3_128_digest(view[lo : to - 1 + length]), "<i8").tolist() if to - lo == BLOCK else (None, None)
                        rows.append((lo, to, ask, core, *two))
                        lo = to
                if rows:
                    columns = zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.bool_(), *[pa.int64()] * 3), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([pid] * len(rows), pa.int64()), *(pa.array(v, t) for v, t in columns)], ["pid", "lo", "hi", "ask", "core", "s1", "s2"])

    spans = tried.groupBy("pid").agg(F.collect_list(F.struct("lo", "hi", "cut", "ask")).alias("spans"))
    blocks = staged(pieces.select("pid", "bytes").join(spans.hint("merge"), "pid").mapInArrow(cut, "pid long, lo int, hi int, ask boolean, core long, s1 long, s2 long"), "blocks")
    full, twice = blocks.filter("s1 IS NOT NULL"), F.col("one").isNotNull()
    places = full.groupBy("s1", "s2").agg(F.count("*").alias("n"), F.min(F.struct("pid", "lo")).alias("one")).filter("n > 1").select("s1", "s2", "one")
    # of the blocks that occur twice one of each kind answers those that share only some of its windows
    stays = F.coalesce((F.col("one.pid") == F.col("pid")) & (F.col("one.lo") == F.col("lo")), F.lit(True))
    marked = full.join(places.hint("merge"), ["s1", "s2"], "left").select("pid", "lo", "hi", "core", (F.col("ask") & ~twice).alias("ask"), (F.col("ask") & twice).alias("known"), stays.alias("stays"))
    partly = blocks.filter("s1 IS NULL AND core IS NOT NULL").select("pid", "lo", "hi", "core", "ask", F.lit(False).alias("known"), F.lit(True).alias("stays"))
    marked = staged(marked.filter("known OR stays").unionByName(partly), "marked")
    rest = marked.filter("stays")
    shared = rest.groupBy("core").agg(F.count("*").alias("n"), F.max("ask").alias("asked")).filter("n > 1 AND asked").select("core")
    again = rest.join(shared.hint("merge"), "core", "left_semi").select("pid", "lo", "hi", "ask")
    return marked.filter("known").select("pid", "lo", "hi"), again.unionByName(blocks.filter("core IS NULL").select("pid", "lo", "hi", "ask"))


def repeated_starts(pieces: DataFrame, length: int) -> DataFrame:
    """(pid, lo, hi): the windows of ``length`` bytes that begin in pieces at lo to hi - 1 and occur more than once."""
    rows = _phrases(pieces, length)
    ranks = suffix_order(rows, length + WHOLE)
    ranked = staged(rows.select("pid", "t", "at", "gap", "whole", "core", "ladder").join(ranks.hint("merge"), ["pid", "t"]), "ranked")
    flags = _compared(ranked)
    w = W.partitionBy("pid").orderBy("t")
    gaps = ranked.drop("whole", "ladder").join(flags.hint("merge"), ["name", "rest"])
    gaps = gaps.withColumns({"rungs": F.lead("rungs").over(w), "next_core": F.lead("core").over(w)})
    # a window that begins l before the next cut needs a neighbour there that agrees on length - l bytes
    least = F.when(F.col("rungs").isNull(), 0).otherwise(F.greatest(F.lit(1), F.lit(WHOLE + 1) - F.col("rungs") * (WHOLE // RUNGS)))
    end = F.col("at") + F.col("gap")
    tried = F.when(~F.col("repeated"), end - least + F.when(F.col("rungs").isNull(), 0).otherwise(1))
    lead = F.col("leads") & (F.col("one.pid") == F.col("pid")) & (F.col("one.t") == F.col("t"))
    gaps = staged(gaps.select("pid", F.col("at").alias("lo"), end.alias("hi"), "repeated", tried.alias("tried"), least.alias("least"), "next_core", lead.alias("leads")), "gaps")

    gaps = gaps.withColumn("cut", F.col("hi"))
    asks = gaps.filter("tried > lo")
    # of the repeated stretches one of each kind answers, as near to the cut as anyone asks
    wanted = asks.groupBy("next_core").agg(F.min("least").alias("_least"))
    answers = gaps.filter("leads").join(wanted.hint("merge"), "next_core").withColumn("hi", F.col("hi") - F.col("_least") + 1).filter("hi > lo")
    # without a core after it, a cut is no part of any window
    near = F.when(F.col("next_core").isNotNull(), F.col("cut")).alias("cut")
    tried = asks.select("pid", "lo", F.col("tried").alias("hi"), near, F.lit(True).alias("ask")).unionByName(answers.select("pid", "lo", "hi", near, F.lit(False).alias("ask")))
    blocks, tried = _settled(pieces, tried, length)
    tried = tried.groupBy("pid").agg(F.collect_list(F.struct("lo", "hi", "ask")).alias("spans"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pid, text, spans in zip(*(batch.column(c).to_pylist() for c in ("pid", "bytes", "spans")), strict=True):
                view, top = memoryview(text), len(text) - length + 1
                ranges = [np.arange(x["lo"], max(x["lo"], min(x["hi"], top))) for x in spans]
                own, ask = np.concatenate(ranges), np.repeat([x["ask"] for x in spans], [len(r) for r in ranges])
                if not len(own):
                    continue
                keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[i : i + length]) for i in own.tolist()), "<i8").reshape(-1, 2)
                # what occurs twice in the piece (periodic text does) is known here; one of each kind goes on
                order = np.lexsort((own, keys[:, 1], keys[:, 0]))
                new = np.append(True, (keys[order][1:] != keys[order][:-1]).any(1))
                n = np.diff(np.append(np.flatnonzero(new), len(order)))
                many = np.repeat(n > 1, n) & ask[order]
                known = np.sort(own[order][many])
                cuts = np.flatnonzero(np.diff(known) > 1) + 1
                known = [(int(r[0]), int(r[-1]) + 1) for r in np.split(known, cuts) if len(r)]
                first = order[new]
                open_ = n == 1
                rows = [keys[first, 0], keys[first, 1], own[first].astype(np.int32), n.astype(np.int32)]
                rows = [pa.array(np.ascontiguousarray(r)) for r in rows]
                numbers = [pa.array(np.full(len(first), pid)), *rows, pa.array(ask[first] & open_)]
                yield pa.RecordBatch.from_arrays(numbers, ["pid", "w1", "w2", "lo", "n", "ask"])
                if known:
                    none, at, size = pa.nulls(len(known), pa.int64()), pa.array([k[0] for k in known], pa.int32()), pa.array([k[1] - k[0] for k in known], pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([pid] * len(known), pa.int64()), none, none, at, size, pa.array([False] * len(known))], ["pid", "w1", "w2", "lo", "n", "ask"])

    # (w1, w2): a window's hash and how often the piece has it; without them: n windows from lo on that are known to repeat
    found = staged(pieces.select("pid", "bytes").join(tried.hint("merge"), "pid").mapInArrow(windows, "pid long, w1 long, w2 long, lo int, n int, ask boolean"), "windows")
    twice = found.filter("w1 IS NOT NULL").groupBy("w1", "w2").agg(F.sum("n").alias("n")).filter("n > 1").select("w1", "w2")
    single = found.filter("ask").join(twice.hint("merge"), ["w1", "w2"], "left_semi").unionByName(found.filter("w1 IS NULL"))
    single = single.select("pid", F.col("lo").cast("long"), (F.col("lo") + F.col("n")).cast("long").alias("hi"))
    whole = gaps.filter("repeated").select("pid", "lo", "hi").unionByName(blocks)
    return whole.select("pid", F.col("lo").cast("long"), F.col("hi").cast("long")).unionByName(single)


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def without_repeats(df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(id_col, n_bytes, spans, kept) per row: the text's UTF-8 bytes, the maximal removed runs (lo, hi) and the bytes that stay.

    A byte goes if it lies in a string of ``length`` bytes that starts anywhere else
    too, in this text or another; strings never cross texts and are judged before
    anything is removed. Null texts are empty. Rows with null or repeated ids are
    texts of their own, so of repeated rows with ``length`` bytes or more all goes.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    docs = df.select(F.col(id_col).alias("id"), text.alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    copies = docs.filter(F.octet_length("text") >= length).groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1")
    pieces = _pieces(docs.select("k1", "k2", "text"), length, bits)
    starts = repeated_starts(pieces, length).join(pieces.select("pid", "k1", "k2", "start").hint("merge"), "pid")
    spans = starts.select("k1", "k2", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") + length - 1).alias("hi"))
    whole = copies.select("k1", "k2", F.lit(0).cast("long").alias("lo"), F.lit(2**31 - 1).cast("long").alias("hi"))
    spans = spans.unionByName(whole).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    spans = staged(spans, "spans")
    table = docs.sparkSession.sparkContext.broadcast(bit_table(spans, "k1", bits))
    kept = [df.schema[id_col]]
    schema = T.StructType([T.StructField("id", kept[0].dataType), *T._parse_datatype_string("n_bytes long, spans array<struct<lo:long,hi:long>>, kept binary").fields])

    def cut_rows(part: pa.RecordBatch, found: list) -> pa.RecordBatch:
        rows, sizes = [], []
        for text, spans in zip(part.column("text").to_pylist(), found, strict=True):
            runs = _merged([(s["lo"], min(s["hi"], len(text))) for s in spans or []])
            edges = [0, *(e for run in runs for e in run), len(text)]
            rows.append((runs, b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))))
            sizes.append(len(text))
        listed = pa.array([[{"lo": lo, "hi": hi} for lo, hi in runs] for runs, _ in rows], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), listed, pa.array([k for _, k in rows], pa.binary())], schema.names)

    def parts(batches: Iterator[pa.RecordBatch], known: bool | None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield part if known is None else part.filter(pa.array(in_table(table.value, part.column("k1").to_numpy()) == known))

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, False):
            yield cut_rows(part, [None] * part.num_rows)

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from parts(batches, True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, None):
            yield cut_rows(part, part.column("spans").to_pylist())

    # texts without repeats, which the table knows, stay where they are
    touched = docs.mapInArrow(maybe, docs.schema).join(spans.hint("merge"), ["k1", "k2"], "left")
    return docs.mapInArrow(clear, schema).unionByName(touched.mapInArrow(cut, schema)).withColumnRenamed("id", id_col)
