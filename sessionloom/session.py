"""Session settings every job of this package relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

RUNTIME_SETTINGS = {
    # Event times are instants; they are shown and compared in UTC.
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON key or attribute name keeps its last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Nested higher-order expressions need more analyzer passes than the default 100.
    "spark.sql.analyzer.maxIterations": "1000",
    # Parquet keeps min/max statistics for this timestamp form, so time filters prune row groups.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    # Sanitised rows with their provenance are over twenty times larger in a task's memory than in a
    # file or shuffle, and payloads cost a thousand times their compressed bytes: smaller tasks.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.files.maxPartitionBytes": "32m",
    # Keyed-hash pads are 64-byte literals; keep them out of plans, the UI and event logs.
    "spark.sql.redaction.string.regex": "(?i)(0x|X')[0-9a-f]{128}'?",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


# Settings that decide results: without them a repeated key or name would fail a payload.
DECISIVE_SETTINGS = ("spark.sql.variant.allowDuplicateKeys", "spark.sql.mapKeyDedupPolicy")


def require_settings(spark: SparkSession) -> None:
    """Raise unless the session has the settings on which verdicts depend; see :func:`configure`."""
    wrong = [name for name in DECISIVE_SETTINGS if spark.conf.get(name, None) != RUNTIME_SETTINGS[name]]
    if wrong:
        raise ValueError(f"call sessionloom.session.configure first; not set: {', '.join(wrong)}")


def build_session(app_name: str = "sessionloom", master: str | None = None, **settings: str) -> SparkSession:
    """Create (or reuse) a session; ``settings`` are extra Spark configuration entries."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return configure(builder.getOrCreate())


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written intermediate tables and stream checkpoints.

    It lies in the shared folder named by ``spark.checkpoint.dir``. Only a local-mode
    session without that setting falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="sessionloom-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a written table that nothing reads any more."""
    path, files = _file_system(spark, folder)
    files.delete(path, True)


def numbered_folders(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers of the finished tables ``prefix<number>`` in a folder, in ascending order."""
    path, files = _file_system(spark, folder)
    if not files.exists(path):
        return []
    names = [status.getPath().getName() for status in files.listStatus(path)]
    finished = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(
        int(name.removeprefix(prefix))
        for name in names
        if name.startswith(prefix) and files.exists(finished(path, f"{name}/_SUCCESS"))
    )
