import corpus_pipeline
import pytest
from pyspark.sql import functions as F


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).persist()
        sizes.append(out.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            docs = out
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2] and sizes[5] == sizes[4]
    bad = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 0")
    assert docs.join(bad, "doc_id").count() <= 0.1 * bad.count()
    check = out.join(docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("want")).distinct(), "doc_id")
    assert check.filter("decoded_sha256 <> want").count() == 0


@pytest.mark.parametrize("rows", [0, 1])
def test_tiny_tables(spark, sf, tmp_path, rows):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(rows).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == rows
