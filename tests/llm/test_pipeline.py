import importlib
from pathlib import Path

import pytest

corpus_pipeline = importlib.import_module("corpus_pipeline")

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="test tables are not mounted")


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality", "near_duplicates", "decontamination", "mixing", "sharding"
    ]
    documents = spark.read.parquet(f"{TABLES}/documents.parquet")
    counts, now = [documents.count()], documents
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, str(TABLES))
        assert now.columns == documents.columns
        counts.append(now.count())
    assert counts == sorted(counts, reverse=True) and 0 < counts[-1] < counts[0]
    mixed = corpus_pipeline.mixing(spark, now, str(TABLES))
    assert mixed.columns == documents.columns
    assert mixed.where("n_chars != length(text)").count() == 0


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{TABLES}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert result.columns[-3:] == ["size", "shard", "slot"] and result.count() == 0
