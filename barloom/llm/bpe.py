"""Byte-level BPE encoding and decoding, with long texts encoded in overlapping chunks.

A text longer than a chunk is cut into chunks that overlap; each is pre-tokenised
and encoded by itself, wherever Spark puts it. A pre-token depends only on the
text from its start on, so two neighbours agree from the first boundary that they
share: there the chunks are stitched. Decoding joins the raw bytes of the ids.

Cuts are never placed inside a run that spans the whole overlap, so a common
boundary always exists; where a pattern breaks that rule, encoding fails loudly.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters at a chunk's end from which no boundary is trusted.
MARGIN = 16
#: Pieces whose ids are remembered; beyond that the memory starts anew.
REMEMBERED = 40_000
#: Rows, and chunks of long texts, that a worker holds as Python objects at a time.
_ROWS, _CHUNKS = 64, 16
_PARTS = ("ids", "head", "head_ids", "tail", "tail_ids")


class _Pieces(dict):
    """Ids of a pre-token as little-endian 32-bit integers, computed once."""

    def __init__(self, merges: tiktoken.Encoding):
        super().__init__()
        self._merges = merges

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = np.array(self._merges._encode_single_piece(piece.encode("utf-8", "replace")), dtype="<u4").tobytes()
        if len(piece) < 64:
            self[piece] = ids
        return ids


class Codec:
    """The vocabulary of one rank file with its pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.ids = _Pieces(tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
        self.bytes = np.empty(max(ranks.values()) + 1, dtype=object)
        for piece, rank in ranks.items():
            self.bytes[rank] = piece

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.ids.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.bytes[np.frombuffer(ids, dtype="<u4")].tolist())


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def chunks(text: str, pattern: regex.Pattern, size: int, overlap: int) -> Iterator[tuple[int, int, int, str]]:
    """(start, next chunk's start or -1, previous chunk's end, text): each reaches over the next one's start by the overlap at least."""
    start = end = 0
    while True:
        cut, stop = start + size, -1
        while stop < 0 and cut + overlap < len(text):
            giant = False
            for seen, m in enumerate(pattern.finditer(text, cut), 1):
                giant = seen == 1 and m.end() - cut > overlap
                if giant:
                    cut = m.end()
                    break
                if seen >= 8 and m.end() - cut >= overlap and m.end() + MARGIN <= len(text):
                    stop = m.end() + MARGIN
                    break
            if not giant:
                break
        if stop < 0:
            yield start, -1, end, text[start:]
            return
        yield start, cut, end, text[start:stop]
        start, end = cut, stop


def encode_chunk(text: str, start: int, cut: int, until: int, of: Codec) -> tuple[bytes, list[int], list[int], list[int], list[int]]:
    """The ids, and the boundaries near the chunk's head and tail as (text position, bytes of ids before)."""
    pieces = of.pattern.findall(text)
    ids = [of.ids[p] for p in pieces]
    at = start + np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])
    before = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
    head = at <= until if start else at < start
    trusted = at <= start + len(text) - MARGIN
    tail = trusted & (at >= cut) if cut >= 0 else at < start
    head &= trusted if cut >= 0 else True
    return b"".join(ids), at[head].tolist(), before[head].tolist(), at[tail].tolist(), before[tail].tolist()


def encode_chunks(batches: Iterator[pa.RecordBatch], of: Codec) -> Iterator[pa.RecordBatch]:
    """Rows of chunks with encode_chunk's values in place of cut, until and text; a few at a time, whatever a batch holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, _CHUNKS):
            part = batch.slice(at, _CHUNKS)
            rows = zip(*(part.column(n).to_pylist() for n in ("text", "start", "cut", "until")), strict=True)
            made = list(zip(*(encode_chunk(*row, of) for row in rows), strict=True))
            kept = [part.column(n) for n in ("id", "digest", "size", "start")]
            lists = [pa.array(m, pa.list_(pa.int64())) for m in made[1:]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(made[0], pa.binary()), *lists], ["id", "digest", "size", "start", *_PARTS])


def stitch(parts: list[tuple[bytes, list[int], list[int], list[int], list[int]]]) -> bytes:
    """Ids of the text whose chunks, in order, gave these parts."""
    out, begin = [], 0
    for this, following in zip(parts, [*parts[1:], None], strict=True):
        end = len(this[0])
        after = 0
        if following is not None:
            known = dict(zip(following[1], following[2], strict=True))
            found = next(((b, known[p]) for p, b in zip(this[3], this[4], strict=True) if p in known), None)
            if found is None:
                raise ValueError("two chunks share no boundary: give a larger overlap")
            end, after = found
        out.append(this[0][begin:end])
        begin = after
    return b"".join(out)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 16384, overlap: int = 512, decoded: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, ids (little-endian unsigned 32-bit integers, binary).

    decoded adds the bytes that the ids decode to, from the same Python worker.

    Each match of the pattern is encoded by itself, without special tokens. Null
    and empty texts have no ids. Repeated rows are returned as often as they
    occur; extra columns are ignored. Only texts longer than chunk + overlap are
    cut; they alone are shuffled, chunk by chunk.
    """
    id_type = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    is_long = F.length("text") > chunk + overlap
    extra = ["decoded"] if decoded else []
    out_type = T.StructType([T.StructField("id", id_type), *(T.StructField(n, T.BinaryType()) for n in ("ids", *extra))])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                ids = [of.encode(t) for t in part.column("text").to_pylist()]
                columns = [ids, *([[of.decode(i) for i in ids]] if decoded else [])]
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, pa.binary()) for c in columns)], out_type.names)

    short = rows.filter(~is_long).mapInArrow(whole, out_type)

    cut_type = T.StructType([*out_type.fields[:1], *(T.StructField(n, T.LongType()) for n in ("digest", "size", "start", "cut", "until")), T.StructField("text", T.StringType())])

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits = regex.compile(pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                text = row.column("text")[0].as_py()
                found = chunks(text, splits, chunk, overlap)
                while some := list(islice(found, _CHUNKS)):
                    same = [row.column(n).take(pa.array([0] * len(some))) for n in ("id", "digest")]
                    *places, pieces = zip(*some, strict=True)
                    numbers = [pa.array(c, pa.int64()) for c in ([len(text)] * len(some), places[0], places[1], places[2])]
                    yield pa.RecordBatch.from_arrays([*same, *numbers, pa.array(pieces, pa.string())], cut_type.names)

    longs = T.ArrayType(T.LongType())
    part_type = T.StructType([*cut_type.fields[:4], out_type.fields[1], *(T.StructField(n, longs) for n in _PARTS[1:])])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encode_chunks(batches, codec(path, pattern))

    def joined(part: pa.Table) -> pa.Table:
        rows = part.select(["start", *_PARTS]).to_pylist()
        copies = sum(r["start"] == 0 for r in rows)
        once = {r["start"]: tuple(r[n] for n in _PARTS) for r in rows}
        ids = stitch([once[start] for start in sorted(once)])
        columns = [ids, *([codec(path, pattern).decode(ids)] if decoded else [])]
        same = part.column("id").take(pa.array([0] * copies, pa.int64()))
        return pa.Table.from_arrays([same, *(pa.array([c] * copies, pa.binary()) for c in columns)], out_type.names)

    cut = rows.filter(is_long).withColumn("digest", F.xxhash64("text")).mapInArrow(cutting, cut_type)
    done = cut.repartition("id", "digest", "start").mapInArrow(parts, part_type)
    long = done.groupBy("id", "digest", "size").applyInArrow(joined, out_type)
    both = short.unionByName(long)
    return both.select(F.col("id").alias(id_col), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", *extra)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the raw bytes of its ids as a binary column; null ids give null."""
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.BinaryType())])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(path, pattern)
        for batch in found:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                texts = [None if x is None else of.decode(x) for x in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*part.schema.names, out_col])

    return df.mapInArrow(batches, schema)
