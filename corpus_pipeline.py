"""A training corpus from raw documents: quality, line dedup, near dedup, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, lines, mixing, quality, shingles
from barloom.llm.common import staged, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of sf_dir, doesn't reject.

    Null texts and ids and repeated rows are judged like any other. Without labels
    of both classes, and so for an empty table, every row stays.
    """
    return quality.good(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line repeats with at most one word edited (from ten words on).

    Null texts stay null, other texts may become empty; n_chars follows. Rows of one
    id are one document, null ids come first. An empty table gives an empty result.
    """
    return lines.dedup_lines(docs, counts=None)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are similar by 0.8 or more, directly or over others, that with the least id.

    SimHash fingerprints within 4 bits give the first links, each verified; a join
    of the shingle sets finds the similar texts whose fingerprints are further apart. Texts without words are copies of each other. Rows with null ids take part and
    all stay; of repeated rows of one id, one stays.
    """
    return shingles.keep_one_per_group(docs, shingle=5, least=0.8, radius=4)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; nulls, ties and repeated rows as in mixing.mixture."""
    return mixing.mixture(docs, quality=mixing.text_quality())


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the digest of the decoded bytes.

    One row per row of docs; a null text is an empty one, without ids.
    """
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True)
    return found.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_documents),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", without_near_copies),
    ("mixing sources", mixed_sources),
    ("byte-level BPE", tokens),
]

#: SQL can express neither the trained classifier nor the token merges; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = staged(docs, name.lower().replace(" ", "-"))
    return docs
