"""From documents to shards of a training mix: five stages, each one corpus operator.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. Its
result is written as Parquet and read again as the documents of the next one. All stages but the
last return the columns of ``documents``. A null or empty text is rejected by the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.decontamination import drop_contaminated
from sessionloom.llm.mixing import mix_documents
from sessionloom.llm.near_dedup import drop_near_duplicates
from sessionloom.llm.quality import quality_columns
from sessionloom.llm.sharding import shard_by_bytes
from sessionloom.llm.text import documents_table, written

# A benchmark item of one or two words would drop every document in which they stand.
LEAST_ITEM_WORDS = 3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_columns(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest id."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items of at least ``LEAST_ITEM_WORDS`` words."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return drop_contaminated(docs, benchmark, short_inside=True, least_words=LEAST_ITEM_WORDS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in the slots of the mix; ``n_chars`` is that of the piece."""
    _, mixed = mix_documents(docs)
    changed = {"text": F.col("piece"), "n_chars": F.length("piece").cast("bigint")}
    return mixed.select(*[(changed.get(name) if name in changed else F.col(f"row.`{name}`")).alias(name) for name in docs.columns])


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in shards of near-equal bytes."""
    return shard_by_bytes(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

# Signatures, permutations and hashes of the engine have no SQL counterpart; the stages are tested
# against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = documents_table(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
