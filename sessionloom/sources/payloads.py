"""Raw inputs: line-delimited files, one JSON document per file, or tables with one per row.

Line-delimited files are the form for volume: they split, and one file holds many payloads. JSON
has no line ends outside its white space, so any payload fits on a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.schemas import DOCUMENT_SCHEMA, PAYLOAD_SCHEMA, SIGNAL_FIELDS

_TEXT = T.StructType([T.StructField("value", T.StringType())])


def _check_signal(signal: str) -> None:
    if signal not in SIGNAL_FIELDS:
        raise ValueError(f"signal must be one of {sorted(SIGNAL_FIELDS)}")


def _as_payloads(files: DataFrame, signal: str, content_type: str) -> DataFrame:
    return files.select(
        F.col("_metadata.file_path").alias("payload_id"),
        F.lit(signal).alias("signal"),
        F.lit(content_type).alias("content_type"),
        F.col("_metadata.file_modification_time").alias("received_at"),
        F.col("value").alias("body"),
    )


def read_payload_files(
    spark: SparkSession, path: str, signal: str, content_type: str = "application/json"
) -> DataFrame:
    """Payloads of one signal from a folder with one payload per file."""
    _check_signal(signal)
    return _as_payloads(spark.read.text(path, wholetext=True), signal, content_type)


def stream_payload_files(
    spark: SparkSession,
    path: str,
    signal: str,
    content_type: str = "application/json",
    max_files_per_trigger: int = 10000,
) -> DataFrame:
    """Payloads of one signal as they land in a folder."""
    _check_signal(signal)
    files = (
        spark.readStream.schema(_TEXT)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .text(path, wholetext=True)
    )
    return _as_payloads(files, signal, content_type)


def _lines_as_payloads(lines: DataFrame, signal: str, content_type: str) -> DataFrame:
    return lines.filter(F.col("value") != "").select(
        F.sha2("value", 256).alias("payload_id"),
        F.lit(signal).alias("signal"),
        F.lit(content_type).alias("content_type"),
        F.col("_metadata.file_modification_time").alias("received_at"),
        F.col("value").alias("body"),
    )


def read_payload_lines(
    spark: SparkSession, path: str, signal: str, content_type: str = "application/json"
) -> DataFrame:
    """Payloads of one signal from files with one payload per line; the id is the body's digest."""
    _check_signal(signal)
    return _lines_as_payloads(spark.read.option("lineSep", "\n").text(path), signal, content_type)


def stream_payload_lines(
    spark: SparkSession,
    path: str,
    signal: str,
    content_type: str = "application/json",
    max_files_per_trigger: int = 1000,
) -> DataFrame:
    """Payloads of one signal from line-delimited files as they land in a folder."""
    _check_signal(signal)
    reader = spark.readStream.schema(_TEXT).option("maxFilesPerTrigger", max_files_per_trigger)
    return _lines_as_payloads(reader.option("lineSep", "\n").text(path), signal, content_type)


def read_payload_table(spark: SparkSession, path: str) -> DataFrame:
    """Payloads from a Parquet table in the payload schema."""
    return spark.read.schema(PAYLOAD_SCHEMA).parquet(path)


def stream_payload_table(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Payloads appended to a Parquet table in the payload schema."""
    reader = spark.readStream.schema(PAYLOAD_SCHEMA)
    return reader.option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)


def read_document_files(spark: SparkSession, path: str) -> DataFrame:
    """Wrapped documents (metadata and payload) from a folder with one document per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("document_id"), F.col("value").alias("body")
    )


def read_document_lines(spark: SparkSession, path: str) -> DataFrame:
    """Wrapped documents from files with one document per line; the id is the body's digest."""
    return spark.read.option("lineSep", "\n").text(path).filter(F.col("value") != "").select(
        F.sha2("value", 256).alias("document_id"), F.col("value").alias("body")
    )


def read_document_table(spark: SparkSession, path: str) -> DataFrame:
    """Wrapped documents from a Parquet table in the document schema."""
    return spark.read.schema(DOCUMENT_SCHEMA).parquet(path)
