"""Each stage over the rows that the one before keeps."""

from __future__ import annotations

import corpus_pipeline

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns, name
        rows = out.count()
        assert 0 < rows <= seen, name
        docs, seen = out, rows
    assert "token = \"" not in " ".join(r.text for r in docs.collect())
    packed = corpus_pipeline.run(spark, SF_DIR)
    assert packed.select("doc_id").distinct().count() == seen
