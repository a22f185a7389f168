"""Collocations by dynamic itemset counting (Brin et al., SIGMOD 1997) over phrases of consecutive words.

The corpus is dealt to a few shards that are scanned in turn, round and round.
Single words are counted from the start; a longer phrase is counted from the round
after both its subphrases (without the last, without the first word) have reached
the threshold, wherever in the cycle that is, and for exactly one full cycle. Tasks
learn from a table of fixed size when a subphrase became frequent: each phrase has
two cells, each cell keeps the first round that set it, and the later of the two is
the phrase's round. Phrases that share cells are at worst counted too early, and
the same in every round; none is counted before its subphrases are. So each phrase
still gets one whole cycle and its count is exact.

Texts are split into words once. Most words, and most pairs of frequent words, are
rare: two scans before the rounds add up words, then pairs of what is left, by 42
bits of their hashes (as PCY does, Park et al., SIGMOD 1995). Those whose sum stays
below the threshold, and so longer phrases with them, are never counted, and the
rounds read only the stretches of words that such pairs leave.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.llm.common import fresh_path, maybe_broadcast, staged
from barloom.llm.suffixes import bit_table, in_table

#: Shards of a cycle; cells of the table of rounds (one byte each, the size of what is broadcast).
SHARDS, CELLS = 4, 1 << 23
#: Bits of the tables of words and of pairs that may be frequent (8 MB); parts in which they are added up.
BITS, PARTS = 1 << 26, 1024
_UNSET = 255
#: Words of some texts of one language: how many, the distinct ones (a line each) and their counts, which of them
#: stands at each place (in as few bytes as its number needs), and whether the next place follows on it.
ROW = "lang string, total long, words binary, n binary, ids binary, follows binary"
_SPACE, _END = 0x20, 0x0A
_BYTES = bytes(_SPACE if b == 9 else _END if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of UTF-8 texts without nulls, in order, and each one's piece; a piece never spans two texts."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    data = np.frombuffer(bytes(raw).translate(_BYTES), np.uint8)
    first = np.zeros(len(data) + 1, bool)
    first[offsets - offsets[0]] = True
    first = first[:-1]
    word = (data != _SPACE) & (data != _END)
    begins = word & first
    begins[1:] |= word[1:] & ~word[:-1]
    begins = np.flatnonzero(begins)
    pieces = np.cumsum((data == _END) | first, dtype=np.int32)[begins]
    ends = np.cumsum(word, dtype=np.int32)
    cuts = np.append(ends[begins] - 1, ends[-1:] if len(ends) else [0]).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(cuts), pa.py_buffer(data[word])])
    return found.dictionary_encode(), pieces


def _longer(shorter: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word at the end."""
    x = (shorter * np.uint64(0x9E3779B97F4A7C15)) ^ (word + (shorter >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode()) & 0x7FFFFFFF
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def cells_of(hashes: np.ndarray, cells: int) -> np.ndarray:
    """Two cells for each hash."""
    return np.stack([hashes % np.uint64(cells), (hashes >> np.uint64(32)) * _MIX % np.uint64(cells)]).astype(np.int64)


def phrase_hashes(lang: str, phrases: list[str]) -> np.ndarray:
    split = [p.encode().split(b" ") for p in phrases]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    words, first = _word_hashes(lang, [w for p in split for w in p]), np.cumsum(sizes) - sizes
    out = words[first]
    for k in range(1, max(sizes, default=0)):
        at = sizes > k
        out[at] = _longer(out[at], words[first[at] + k])
    return out


def _place(hashes: np.ndarray) -> np.ndarray:
    """The part (10 bits) and the place in it (32 bits) where a word or a pair is added up."""
    return hashes >> np.uint64(22)


def _packed(lang: str, total: int, words: list[bytes], n: np.ndarray, ids: np.ndarray, follows: np.ndarray) -> pa.RecordBatch:
    values = [lang, total, b"\n".join(words), n.astype(np.int32).tobytes(), ids.astype(np.min_scalar_type(len(words))).tobytes(), np.packbits(follows).tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["lang", "total", "words", "n", "ids", "follows"])


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[str, int, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    for row in range(batch.num_rows):
        lang, total, words, n, ids, follows = (batch.column(c)[row].as_py() for c in ("lang", "total", "words", "n", "ids", "follows"))
        names = words.split(b"\n")
        ids = np.frombuffer(ids, np.min_scalar_type(len(names)))
        yield lang, total, names, np.frombuffer(n, np.int32), ids, np.unpackbits(np.frombuffer(follows, np.uint8), count=len(ids)).astype(bool)


def _encoded(docs: DataFrame) -> DataFrame:
    """The words of all texts, by batches and languages."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang")
            for lang in pc.unique(langs).to_pylist():
                words, pieces = words_of(batch.column("text").filter(pc.equal(langs, lang)))
                ids = words.indices.to_numpy()
                if len(ids):
                    names = words.dictionary.to_pylist()
                    yield _packed(lang, len(ids), names, np.bincount(ids, minlength=len(names)), ids, np.append(pieces[1:] == pieces[:-1], False))

    return staged(docs.select("lang", "text").mapInArrow(scan, ROW), "words")


def _likely(encoded: DataFrame, least: int, bits: int, known: Broadcast | None = None) -> np.ndarray:
    """A bit table of the words that occur ``least`` times, or of the pairs of ``known`` words that do, and of few others."""
    kind = np.min_scalar_type(least)

    def words(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lang, names, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "words", "n")), strict=True):
            yield _place(_word_hashes(lang, names.split(b"\n"))), np.frombuffer(n, np.int32)

    def pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lang, _, names, _, ids, follows in _unpacked(batch):
            single = _word_hashes(lang, names)
            at = _neighbours(in_table(known.value, _place(single)), ids, follows)
            yield np.unique(_place(_longer(single[ids[at]], single[ids[at + 1]])), return_counts=True)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(words(batch) if known is None else pairs(batch))
            place, n = (np.concatenate(x) for x in zip((np.zeros(0, np.uint64), np.zeros(0, np.int64)), *found, strict=True))
            order = np.argsort(place)
            place, n = place[order], n[order]
            edges = np.searchsorted(place >> np.uint64(32), np.arange(PARTS + 1, dtype=np.uint64))
            columns = [place.astype(np.uint32), np.minimum(n, least).astype(kind)]
            packed = [pa.Array.from_buffers(pa.binary(), PARTS, [None, pa.py_buffer((edges * c.itemsize).astype(np.int32)), pa.py_buffer(c)]) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS, dtype=np.int32)), *packed], ["part", "places", "n"]).filter(pa.array(np.diff(edges) > 0))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, packed in zip(batch.column("part").to_pylist(), batch.column("packed"), strict=True):
                packed = packed.as_py()
                places, of = np.unique(np.frombuffer(b"".join(p["places"] for p in packed), np.uint32), return_inverse=True)
                n = np.bincount(of, np.frombuffer(b"".join(p["n"] for p in packed), kind))
                yield pa.RecordBatch.from_arrays([pa.array((part << 32) + places[n >= least].astype(np.int64))], ["place"])

    rows = encoded.select("lang", "words", "n") if known is None else encoded
    packed = rows.mapInArrow(scan, "part int, places binary, n binary").groupBy("part").agg(F.collect_list(F.struct("places", "n")).alias("packed"))
    return bit_table(packed.mapInArrow(sums, "place long"), "place", bits)


def _neighbours(known: np.ndarray, ids: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """The places where a known word is followed by a known one."""
    at = known[ids]
    return np.flatnonzero(follows[:-1] & at[:-1] & at[1:])


def _reduced(encoded: DataFrame, words: Broadcast, pairs: Broadcast, shards: int) -> DataFrame:
    """The likely words with their counts, and the places of likely pairs, dealt to shards and written."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        for batch in batches:
            for lang, total, names, n, ids, follows in _unpacked(batch):
                single = _word_hashes(lang, names)
                known = in_table(words.value, _place(single))
                if not known.any():
                    continue
                at = _neighbours(known, ids, follows)
                at = at[in_table(pairs.value, _place(_longer(single[ids[at]], single[ids[at + 1]])))]
                likely = np.zeros(len(ids), bool)
                likely[at] = True
                kept = likely.copy()
                kept[at + 1] = True
                number, shard = np.cumsum(known) - 1, shard + 1
                row = _packed(lang, total, [names[i] for i in np.flatnonzero(known)], n[known], number[ids[kept]], likely[kept])
                yield row.append_column("shard", pa.array([shard % shards], pa.int32()))

    where = fresh_path(encoded.sparkSession, "shards")
    encoded.mapInArrow(scan, f"{ROW}, shard int").write.partitionBy("shard").option("compression", "zstd").parquet(where)
    return encoded.sparkSession.read.schema(f"{ROW}, shard int").parquet(where)


def _counts(lang: str, words: list[bytes], n: np.ndarray, ids: np.ndarray, follows: np.ndarray, known: np.ndarray, at: int, shards: int, most: int) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases that round ``at`` is to count in these texts of one language."""
    size, names, single = len(words), pa.array(words, pa.binary()).cast(pa.string()), _word_hashes(lang, words)
    # places of one stretch follow on each other, all of them in likely pairs
    ids, stretch = ids.astype(np.int64), np.cumsum(np.append(False, ~follows)[:-1])

    def rows(k: int, first: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        texts = names if k == 1 else pc.binary_join_element_wise(*(names.take(pa.array(ids[first + j])) for j in range(k)), " ")
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(np.full(len(n), k, np.int32)), texts, pa.array(n.astype(np.int64))], ["lang", "k", "phrase", "n"])

    if at < shards:
        yield rows(1, ids, n)
    # for every place: the phrase of k - 1 words from there on (-1: none is counted on), by its number here, and its round
    place, number, hashes = np.arange(len(ids)), ids, single
    rounds = known[cells_of(single, len(known))].max(0)[ids]
    for k in range(2, most + 1):
        after = np.full(len(ids) + 1, _UNSET, np.uint8)
        after[place] = rounds
        ok = (rounds < _UNSET) & (after[place + 1] < _UNSET)
        ok[ok] = stretch[place[ok]] == stretch[place[ok] + k - 1]
        place, number, own = place[ok], number[ok], np.maximum(rounds[ok], after[place[ok] + 1])
        if not len(place):
            return
        code, first, inverse, n = np.unique(number * size + ids[place + k - 1], return_index=True, return_inverse=True, return_counts=True)
        hashes, begun = _longer(hashes[code // size], single[code % size]), own[first].astype(int) + 1
        due = (begun <= at) & (at < begun + shards)
        if due.any():
            yield rows(k, place[first[due]], n[due])
        if k == most:
            return
        # cells that others set say nothing before the phrase itself is counted: longer ones would miss the rounds until then
        number, rounds = inverse, np.maximum(known[cells_of(hashes, len(known))].max(0), own[first])[inverse]


def _round(shard: DataFrame, known: np.ndarray, at: int, shards: int, most: int) -> DataFrame:
    """(lang, k, phrase, n) of one scan, written."""
    table = shard.sparkSession.sparkContext.broadcast(known)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, _, *row in _unpacked(batch):
                yield from _counts(lang, *row, table.value, at, shards, most)

    found = staged(shard.mapInArrow(scan, "lang string, k int, phrase string, n long").groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")), "counts")
    table.destroy()
    return found


def _newly(counts: DataFrame, cells: int) -> np.ndarray:
    """The cells of these phrases: at most as many numbers as there are cells."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column("lang")
            for lang in pc.unique(langs).to_pylist():
                found = phrase_hashes(lang, b.column("phrase").filter(pc.equal(langs, lang)).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(cells_of(found, cells)).astype(np.int32))], ["cell"])

    return counts.mapInArrow(marked, "cell int").distinct().toArrow().column("cell").to_numpy()


def _totals(rounds: list[DataFrame], least: int, shards: int, most: int) -> DataFrame:
    """(lang, k, phrase, n) of the phrases of up to ``most`` words with n >= least in these rounds together.

    A phrase is counted in ``shards`` rounds, so in one of them it has its share of
    least; only phrases that do are added up.
    """
    every, key = reduce(DataFrame.unionByName, rounds).filter(F.col("k") <= most), ["lang", "k", "phrase"]
    likely = staged(every.filter(F.col("n") >= -(-least // shards)).select(*key).distinct(), "likely")
    size = likely.agg(F.sum(F.octet_length("phrase") + F.octet_length("lang") + 32)).first()[0] or 0
    return every.join(maybe_broadcast(likely, size, 1), key, "left_semi").groupBy(*key).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def frequent(df: DataFrame, least: int = 100, most: int = 5, lang_col: str = "lang", text_col: str = "text", shards: int = SHARDS, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, n) of all phrases of up to ``most`` words that occur at least ``least`` times, and (lang, n) of all words.

    A-Z are lower-cased; texts are split into pieces at [.,;:!?] and line ends, and
    those into words at blanks and tabs. Occurrences overlap and stay within pieces.
    Null texts are empty, a null language is ``und``; every row counts, repeated ones too.
    """
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    encoded = _encoded(docs)
    words = spark.sparkContext.broadcast(_likely(encoded, least, BITS))
    pairs = spark.sparkContext.broadcast(_likely(encoded, least, BITS, words))
    dealt = _reduced(encoded, words, pairs, shards)
    words.destroy()
    pairs.destroy()
    known, found, last, at = np.full(cells, _UNSET, np.uint8), [], 0, 0
    while at < shards or at <= last + shards:
        found.append(_round(dealt.filter(F.col("shard") == at % shards).drop("shard"), known, at, shards, most))
        # a phrase that is still being counted has all its counts in the rounds of one cycle
        new = _newly(_totals(found[-shards:], least, shards, most - 1).select("lang", "phrase"), cells)
        new = new[known[new] == _UNSET]
        if len(new):
            known[new], last = at, at
        at += 1
        if at >= _UNSET:
            raise RuntimeError("too many rounds")
    return staged(_totals(found, least, shards, most), "frequent"), encoded.groupBy("lang").agg(F.sum("total").alias("n"))


def _score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 a n / (l r)), exact: products have up to 38 digits."""
    d = lambda c, digits: f"cast({c} as decimal({digits},0))"
    return F.expr(f"(cast(1000 as decimal(4,0)) * {d(a, 15)} * {d(n, 17)}) div ({d(left, 18)} * {d(right, 18)})")


def collocations(df: DataFrame, least: int = 100, most: int = 5, top: int = 2000, lang_col: str = "lang", text_col: str = "text", shards: int = SHARDS, cells: int = CELLS) -> DataFrame:
    """The ``top`` collocations per language: lang, rank, phrase, a, l, r, n, score.

    A phrase of two words or more counts by its weakest cut into a first part (l
    times) and the rest (r times): score = floor(1000 a n / (l r)), of equal cuts the
    earliest. A phrase that always stands within one longer frequent phrase is left
    out. Order: score, a (both falling), phrase. Without frequent phrases the result is empty.
    """
    counts, words = frequent(df, least, most, lang_col, text_col, shards, cells)
    candidates = counts.filter("k >= 2").withColumnRenamed("n", "a")
    parts = F.split("phrase", " ")
    inner = F.explode(F.array(F.concat_ws(" ", F.slice(parts, 1, F.col("k") - 1)), F.concat_ws(" ", F.slice(parts, 2, F.col("k") - 1))))
    within = candidates.filter("k >= 3").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("a"))
    kept = candidates.join(within, ["lang", "phrase", "a"], "left_anti")

    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = kept.select("lang", "phrase", "a", "k", cut)
    cuts = cuts.withColumns({"first": F.concat_ws(" ", F.slice(parts, 1, F.col("cut"))), "rest": F.concat_ws(" ", F.slice(parts, F.col("cut") + 1, F.col("k")))})
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part])
    # one row per language
    scored = cuts.join(words, "lang").withColumn("score", _score("a", "n", "l", "r"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("of")).select("lang", "phrase", "of.*")
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return weakest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
