"""Event tables on plain Parquet folders: append once, upsert sessions, keep rejected payloads.

Every write is an ordinary Spark job on a folder below the root. A batch has a name of its
caller's choice, such as a stream and its micro-batch number, and writing it again replaces its
folders, so a batch that is replayed after a failure is stored once:

``events/batch=B/session_bucket=K``  sanitised events, the first of each id
``ids/id_bucket=K/batch=B``          ids of those events, dealt by their hash
``provenance/batch=B``               provenance of those events, one list per event
``folds/batch=B``                    partial session folds of those events
``rejected/batch=B``                 ids and codes of rejected payloads
``counts/batch=B``                   numbers of accepted and rejected payloads
``sessions/version=N``               all sessions after the N-th upsert

There is one writer at a time. Readers that must not see a batch in progress, concurrent writers
and deletion in place are the business of a table format; put the same frames into one instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.operators.privacy import provenance_rows
from sessionloom.operators.query import without_sessions
from sessionloom.operators.sessions import FOLD_INPUT, deduplicate, finish_sessions, fold_events, merge_folds
from sessionloom.schemas import EVENT_SCHEMA, PROVENANCE_TYPE
from sessionloom.session import delete_folder, numbered_folders

_ORDER_TYPE = "nano: bigint, event_id: string, occurred_at: timestamp"
TABLES = {
    "events": T.StructType(
        [*EVENT_SCHEMA.fields, T.StructField("batch", T.StringType()), T.StructField("session_bucket", T.IntegerType())]
    ),
    "ids": "event_id string, id_bucket int, batch string",
    "provenance": "event_id string, session_id string, "
    f"provenance {PROVENANCE_TYPE.simpleString()}, batch string",
    "folds": f"session_id string, first struct<{_ORDER_TYPE}, schema_version: string, provider: string, tool: string>, "
    f"last struct<{_ORDER_TYPE}, state: string>, event_count bigint, batch string",
    "rejected": "payload_id string, signal string, received_at timestamp, error_code string, batch string",
    "counts": "accepted_payloads bigint, rejected_payloads bigint, batch string",
}
SESSION_TYPE = (
    "session_id string, schema_version string, provider string, tool string, state string, "
    "started_at timestamp, completed_at timestamp, event_count bigint"
)


class EventStore:
    """Events, their provenance and sessions under one root folder on shared storage."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = spark.read.schema("buckets int").parquet(f"{self.root}/settings").first().buckets

    @classmethod
    def create(cls, spark: SparkSession, root: str, buckets: int = 16) -> EventStore:
        """Start empty tables.

        ``buckets`` sets for good how finely events are partitioned by session, and ids by their
        hash. A lookup of one session reads one bucket; about one per few GB of events is a fair
        choice.
        """
        root = root.rstrip("/")
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{root}/settings")
        for name, schema in TABLES.items():
            spark.createDataFrame([], schema).write.partitionBy("batch").parquet(f"{root}/{name}")
        return cls(spark, root)

    # --- reading -----------------------------------------------------------------------

    def table(self, name: str) -> DataFrame:
        """All batches of one table, with the batch each row came in."""
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}")

    def events(self) -> DataFrame:
        """Stored events."""
        return self.table("events").drop("batch", "session_bucket")

    def session_events(self, session_id: str) -> DataFrame:
        """Events of one session in event-time order; reads one bucket of the event table."""
        bucket = _bucket(F.lit(session_id), self.buckets)
        rows = self.table("events").filter((F.col("session_bucket") == bucket) & (F.col("session_id") == session_id))
        return rows.drop("batch", "session_bucket").orderBy("occurred_at_unix_nano", "event_id")

    def sessions(self) -> DataFrame:
        """Sessions as of the last upsert."""
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], SESSION_TYPE)
        return self.spark.read.schema(SESSION_TYPE).parquet(f"{self.root}/sessions/version={versions[-1]}")

    def provenance(self) -> DataFrame:
        """One row per provenance entry of every stored event."""
        return provenance_rows(self.table("provenance"), "event_id")

    def rejected(self) -> DataFrame:
        """Rejected payloads: id, signal, time of receipt and error code, never their content."""
        return self.table("rejected").drop("batch")

    def counters(self) -> DataFrame:
        """Accepted and rejected payloads over all batches."""
        names = ("accepted_payloads", "rejected_payloads")
        return self.table("counts").agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names])

    def _versions(self) -> list[int]:
        return numbered_folders(self.spark, f"{self.root}/sessions", "version=")

    # --- writing -----------------------------------------------------------------------

    def append(self, events: DataFrame, arrival: list[str], batch: str) -> None:
        """Store the events whose ids are new and rebuild the sessions they belong to.

        ``events`` are sanitised and carry ``provenance``; ``arrival`` names the columns that
        order them, the first event per id winning. Ids stored by other batches are ignored, also
        under another session.
        """
        self._store(self._staged(self._first(events, arrival), batch, "events"), batch)
        delete_folder(self.spark, f"{self.root}/staging/{batch}")

    def append_payloads(self, rows: DataFrame, arrival: list[str], batch: str) -> None:
        """Store one batch of ingested payloads: new events, rejected payloads and counts.

        ``rows`` has a sanitised event per row and at least one row per payload, with ``error_code``
        and ``record_index``; a row without ``event_id`` stands for a payload without events. They
        are evaluated once, for all three outputs.
        """
        staged = self._staged(rows, batch, "rows")
        refused = F.col("error_code").isNotNull()
        self._write(
            staged.filter(refused).select("payload_id", "signal", "received_at", "error_code"), "rejected", batch
        )
        one_per_payload = staged.filter(F.coalesce("record_index", F.lit(0)) == 0)
        counts = one_per_payload.agg(
            F.count_if(~refused).alias("accepted_payloads"), F.count_if(refused).alias("rejected_payloads")
        )
        self._write(counts, "counts", batch)
        events = self._first(staged.filter(F.col("event_id").isNotNull()), arrival)
        self._store(self._staged(events, batch, "events"), batch)
        delete_folder(self.spark, f"{self.root}/staging/{batch}")

    def _staged(self, rows: DataFrame, batch: str, step: str) -> DataFrame:
        """A written copy of rows that are used several times; a lost executor costs a re-read."""
        path = f"{self.root}/staging/{batch}/{step}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    @staticmethod
    def _first(events: DataFrame, arrival: list[str]) -> DataFrame:
        """The first event of each id, with its provenance."""
        order = [name for name in arrival if name not in EVENT_SCHEMA.names]
        return deduplicate(events.select(*EVENT_SCHEMA.names, "provenance", *order), arrival).drop(*order)

    def _store(self, staged: DataFrame, batch: str) -> None:
        fresh = staged.join(self._known(staged, batch), "event_id", "left_anti")
        bucket = _bucket(F.col("session_id"), self.buckets).alias("session_bucket")
        path = f"{self.root}/events/batch={batch}"
        # The rebalance hint lets Spark split a bucket that a hot session blows up and merge small ones.
        (
            fresh.select(*EVENT_SCHEMA.names, bucket)
            .hint("rebalance", "session_bucket")
            .sortWithinPartitions("session_bucket", "session_id", "occurred_at_unix_nano")
            .write.mode("overwrite")
            .partitionBy("session_bucket")
            .parquet(path)
        )
        self._write(fresh.select("event_id", "session_id", "provenance"), "provenance", batch)
        written = self.spark.read.schema(EVENT_SCHEMA).parquet(path)
        self._write_ids(written, batch)
        self._write(fold_events(written.select(*FOLD_INPUT)), "folds", batch)
        self.upsert_sessions(batch)

    def _known(self, staged: DataFrame, batch: str) -> DataFrame:
        """Ids of the batch that other batches have stored; reads the buckets its own ids fall into."""
        own = staged.select("event_id", _bucket(F.col("event_id"), self.buckets).alias("own_bucket"))
        used = [row.own_bucket for row in own.select("own_bucket").distinct().collect()]
        stored = self.table("ids").filter(F.col("id_bucket").isin(used) & (F.col("batch") != batch))
        # The batch is the side Spark may broadcast, so a small one leaves the stored ids unshuffled.
        return stored.select("event_id").join(own.select("event_id"), "event_id", "left_semi")

    def _write(self, rows: DataFrame, name: str, batch: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")

    def _write_ids(self, events: DataFrame, batch: str) -> None:
        ids = events.select(
            "event_id", _bucket(F.col("event_id"), self.buckets).alias("id_bucket"), F.lit(batch).alias("batch")
        )
        (
            ids.hint("rebalance", "id_bucket")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("id_bucket", "batch")
            .parquet(f"{self.root}/ids")
        )

    def upsert_sessions(self, batch: str) -> None:
        """Write the next version of the sessions: those the batch touches are merged anew.

        A touched session is merged from its folds of all batches, so doing it again after a
        failure changes nothing. The version before stays for readers that have opened it.
        """
        folds = self.table("folds")
        touched = folds.filter(F.col("batch") == batch).select("session_id")
        merged = finish_sessions(merge_folds(folds.drop("batch").join(touched, "session_id", "left_semi")))
        self._write_sessions(self.sessions().join(touched, "session_id", "left_anti").unionByName(merged))

    def _write_sessions(self, sessions: DataFrame) -> None:
        versions = self._versions()
        number = versions[-1] + 1 if versions else 0
        sessions.sortWithinPartitions("started_at", "session_id").write.parquet(f"{self.root}/sessions/version={number}")
        for old in versions[:-1]:
            delete_folder(self.spark, f"{self.root}/sessions/version={old}")

    def rewrite(self, root: str, deleted: DataFrame | None = None) -> EventStore:
        """Copy everything into one batch of new tables at ``root``, without the deleted sessions.

        Their events, ids, provenance and folds are left out, so the same events may be stored
        again. The old folders are the caller's to remove once no reader uses them.
        """
        target = EventStore.create(self.spark, root, self.buckets)

        def kept(rows: DataFrame) -> DataFrame:
            return rows if deleted is None else without_sessions(rows, deleted)

        bucket = _bucket(F.col("session_id"), self.buckets).alias("session_bucket")
        events = kept(self.events()).select(*EVENT_SCHEMA.names, bucket)
        path = f"{target.root}/events/batch=base"
        (
            events.hint("rebalance", "session_bucket")
            .sortWithinPartitions("session_bucket", "session_id", "occurred_at_unix_nano")
            .write.partitionBy("session_bucket")
            .parquet(path)
        )
        target._write_ids(self.spark.read.schema(EVENT_SCHEMA).parquet(path), "base")
        target._write(kept(self.table("provenance").drop("batch")), "provenance", "base")
        target._write(merge_folds(kept(self.table("folds").drop("batch"))), "folds", "base")
        target._write(self.rejected(), "rejected", "base")
        target._write(self.counters(), "counts", "base")
        # Sorted over all files, so that time filters and cursors prune the scan.
        target._write_sessions(kept(self.sessions()).repartitionByRange("started_at", "session_id"))
        return target


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def delete_cascade(deleted: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Survivors of every given table after the deletion of sessions."""
    return {name: without_sessions(table, deleted) for name, table in tables.items()}
