"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, licenses, lines, mixing, mpeg, phrases, quality, secrets, simhash, suffixes, topk, trie, warc
from barloom.llm.common import staged, table
from barloom.llm.oracles import ORACLES  # noqa: F401


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"), quality=mixing.text_quality())
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    found = bpe.decode(ids, ranks, public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(table(spark, sf_dir, "pages"))
    size, digest = F.octet_length("payload").cast("long"), F.sha1("payload")
    found = found.select("record_id", F.col("type").alias("record_type"), F.col("refers_to").alias("of"), size.alias("payload_bytes"), digest.alias("payload_digest"))
    found = staged(found, "records")
    full = found.filter("record_type = 'response'").groupBy(F.col("record_id").alias("of"))
    full = full.agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    revisits = found.filter("record_type = 'revisit'").select("record_id", "record_type", "of").join(full, "of", "left")
    every = found.filter("record_type = 'response'").unionByName(revisits)
    return every.select(warc.page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_id("of").alias("refers_to"))


def op4_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    found = mpeg.read(mpeg.write(docs.select("doc_id", n_bytes, mpeg.padded().alias("payload"))))
    found = found.withColumn("payload", F.expr("substring(body, 1, cast(tags['payload_bytes'] as int))"))
    feature = F.format_string(
        "mpeg%s layer%d %dHz %dch frames=%d samples=%d last=%d vbr=%s/%d crc=%d/%d junk=%d",
        *["version", "layer", "rate", "channels", "frames", "samples", F.element_at("offsets", -1), "vbr_kind", "vbr_frames", "crc_ok", "crc_bad", "junk"],
    )
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        F.col("duration.numerator").alias("duration_numerator"),
        F.col("duration.denominator").alias("duration_denominator"),
        F.sha2(F.array_join("offsets", ","), 256).alias("offsets_sha256"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "text_score", "page_score", "score", "keep")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def listed(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, secrets.BASE)
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    words = F.transform("base", lambda b: b["word"])
    base, own = (F.transform(c, lambda s: s["label"]) for c in ("base", "spans"))
    best = F.array_max(F.transform("spans", lambda s: s["similarity"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
        "spans",
    )


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "documents"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, most=5, top=2000)


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.ordered_turns(table(spark, sf_dir, "conversations"))
    heads = lambda c: F.crc32(F.encode(c.cast("string"), "UTF-8")) % 9
    sizes, rows = trie.forked(turns, heads, lambda c: c - c % 5, 8)
    return trie.trie(rows, sizes)


def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.without_repeats(table(spark, sf_dir, "documents"), length=400)
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed")
    return found.select("doc_id", "n_bytes", removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_bpe": op2_bpe,
    "op3_warc": op3_warc,
    "op4_mpeg": op4_mpeg,
    "op5_quality": op5_quality,
    "op6_secrets": op6_secrets,
    "op7_simhash": op7_simhash,
    "op8_licenses": op8_licenses,
    "op9_topk": op9_topk,
    "op10_lines": op10_lines,
    "op11_phrases": op11_phrases,
    "op12_trie": op12_trie,
    "op13_suffixes": op13_suffixes,
}
