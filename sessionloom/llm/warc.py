"""WARC archives by way of a chunked record table.

A payload becomes rows (record_no, chunk, part) of bounded size, cut one after the other from the value
that the table holds and passed on in batches of bounded size; every row is written as one WARC
record, the first as ``response``, the following ones as ``continuation`` segments with
WARC-Segment-Number and WARC-Segment-Origin-ID, the last of several with WARC-Segment-Total-Length.
A payload that equals an earlier one is written as ``revisit`` without a body. Reading cuts archives
into records, and a stream over the chunk rows of a record, in order, carries the digest of the
payload from chunk to chunk, so that no oversized payload is put together in memory.

Archives are written and read by Spark's own text source, in gzip, so they can be in any store that
Spark reaches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.text import written
from sessionloom.session import work_dir

CHUNK_BYTES = 1 << 20
# Bytes of chunks that a task puts into one batch of rows.
BATCH_BYTES = 4 << 20
REVISIT_BYTES = 100
# Revisits (about 40 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
# Every record starts with this line; it also separates records when an archive is read.
VERSION = "WARC/1.1\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


CHUNK_SCHEMA = (
    "record_no bigint, page_id bigint, url string, role string, refers_no bigint, refers_to bigint, "
    "payload_bytes bigint, payload_digest string, chunk int, chunks int, part binary"
)
PARSED_SCHEMA = (
    "record_id string, role string, page_id bigint, refers_id string, refers_to bigint, declared string, "
    "segment int, last boolean, block_bytes bigint, digest string, part binary"
)


def payload_table(pages: DataFrame, *, page_id: str, url: str, payload: str) -> DataFrame:
    """Rows (record_no, page_id, url, body, payload_bytes, payload_digest), written once.

    A null payload is empty. ``record_no`` numbers the written rows, so that repeated rows are told
    apart and stay so if a task runs again.
    """
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    rows = pages.select(
        F.monotonically_increasing_id().alias("record_no"),
        F.col(f"`{page_id}`").cast("bigint").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        body.alias("body"),
        F.octet_length(body).cast("bigint").alias("payload_bytes"),
        F.sha2(body, 256).alias("payload_digest"),
    )
    return written(rows, "payloads")


def with_roles(payloads: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Add ``role`` (response or revisit), ``refers_no`` and ``refers_to`` by equal payloads.

    Of equal payloads of at least ``revisit_bytes`` bytes the one with the smallest page id is the
    response, null ids last, then the first written. Only the keys of copied payloads are joined by
    digest; the payloads themselves meet the list of revisits, which is broadcast if it is short.
    """
    keys = payloads.select("record_no", "page_id", "payload_bytes", "payload_digest")
    large = keys.where(F.col("payload_bytes") >= revisit_bytes)
    first = F.min(F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "record_no")).alias("first")
    copied = (
        large.groupBy("payload_digest")
        .agg(first, F.count("*").alias("rows"))
        .where("rows > 1")
        .select("payload_digest", F.col("first.page_id").alias("first_page"), F.col("first.record_no").alias("first_no"))
    )
    revisits = written(
        large.join(copied, "payload_digest").where("first_no != record_no").select("record_no", "first_no", "first_page"),
        "revisits",
    )
    if revisits.count() <= BROADCAST_ROWS:
        revisits = F.broadcast(revisits)
    again = F.col("first_no").isNotNull()
    return payloads.join(revisits, "record_no", "left").select(
        *payloads.columns,
        F.when(again, "revisit").otherwise("response").alias("role"),
        F.when(again, F.col("first_no")).alias("refers_no"),
        F.when(again, F.col("first_page")).alias("refers_to"),
    )


def _cuts(body: memoryview, chunk_bytes: int) -> list[int]:
    """Ends of the chunks: at most ``chunk_bytes`` apart, and inside every record-starting line."""
    line, ends, start = VERSION.encode(), [], 0
    while True:
        found = bytes(body[start : start + chunk_bytes + len(line)]).find(line)
        if found < 0 and len(body) - start <= chunk_bytes:
            return [*ends, len(body)]
        start += chunk_bytes if found < 0 else min(chunk_bytes, found + 4)
        ends.append(start)


def chunk_table(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each chunk of a payload, ``chunk`` from 1; empty payloads and revisits have one, empty.

    A payload that holds the line that starts a record is cut inside that line, so the line never
    occurs within a written record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = batch.drop_columns(["body"])
            roles, bodies = batch.column("role").to_pylist(), batch.column("body")
            rows: list[tuple[int, int, int, bytes]] = []
            held = 0

            def made() -> pa.RecordBatch:
                at, numbers, counts, parts = zip(*rows)
                chunked = heads.take(pa.array(at, pa.int32()))
                columns = [pa.array(numbers, pa.int32()), pa.array(counts, pa.int32()), pa.array(parts, pa.binary())]
                return pa.RecordBatch.from_arrays(
                    [*chunked.columns, *columns], [*chunked.schema.names, "chunk", "chunks", "part"]
                )

            for at, role in enumerate(roles):
                body = memoryview(bodies[at].as_buffer() or b"") if role == "response" else memoryview(b"")
                ends, start = _cuts(body, chunk_bytes), 0
                for number, end in enumerate(ends, 1):
                    # A batch of rows that is full goes on before the next chunk is cut.
                    if rows and held + end - start > BATCH_BYTES:
                        yield made()
                        rows, held = [], 0
                    rows.append((at, number, len(ends), bytes(body[start:end])))
                    held += end - start
                    start = end
            if rows:
                yield made()

    columns = [field.split()[0] for field in CHUNK_SCHEMA.split(", ")]
    ordered = [name for name in columns if name not in ("chunk", "chunks", "part")]
    return records.select(*ordered, "body").mapInArrow(run, CHUNK_SCHEMA)


def record_lines(chunks: DataFrame) -> DataFrame:
    """One column ``value``: the bytes of a WARC record for every chunk row, less its last line end."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    when = lambda condition, value: F.when(condition, value).otherwise(F.lit(""))
    record = lambda number, chunk: F.concat(
        F.lit("<urn:warc-record:"), number.cast("string"), F.lit(":"), chunk.cast("string"), F.lit(">")
    )
    first, several, revisit = F.col("chunk") == 1, F.col("chunks") > 1, F.col("role") == "revisit"
    block = F.concat(F.when(first & ~revisit, F.lit(HTTP_HEAD.encode())).otherwise(F.lit(b"")), F.col("part"))
    total = F.col("payload_bytes") + len(HTTP_HEAD)
    head = F.concat(
        F.lit(VERSION),
        line("WARC-Type", F.when(first, F.col("role")).otherwise("continuation")),
        line("WARC-Record-ID", record(F.col("record_no"), F.col("chunk"))),
        line("WARC-Date", F.lit(DATE)),
        when(F.col("url").isNotNull(), line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"))),
        when(F.col("page_id").isNotNull(), line("X-Page-Id", F.col("page_id"))),
        when(first, line("Content-Type", F.lit("application/http;msgtype=response"))),
        when(first, line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block, 256))),
        when(several, line("WARC-Segment-Number", F.col("chunk"))),
        when(~first, line("WARC-Segment-Origin-ID", record(F.col("record_no"), F.lit(1)))),
        when(several & (F.col("chunk") == F.col("chunks")), line("WARC-Segment-Total-Length", total)),
        when(revisit, line("WARC-Profile", F.lit(PROFILE))),
        when(revisit, line("WARC-Refers-To", record(F.col("refers_no"), F.lit(1)))),
        when(revisit & F.col("refers_to").isNotNull(), line("X-Refers-To-Page", F.col("refers_to"))),
        line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
    )
    return chunks.select(F.concat(head.cast("binary"), block, F.lit(b"\r\n")).cast("string").alias("value"))


def write_warc(
    pages: DataFrame,
    path: str,
    *,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    chunk_bytes: int = CHUNK_BYTES,
    revisit_bytes: int = REVISIT_BYTES,
) -> None:
    """Write one WARC record per row to gzip archives below ``path``, in segments of ``chunk_bytes``.

    Null payloads are empty, null ids and addresses leave out their header line, repeated rows are
    records of their own and revisit each other. An empty table writes no record. Other columns
    are ignored.
    """
    payloads = payload_table(pages, page_id=page_id, url=url, payload=payload)
    lines = record_lines(chunk_table(with_roles(payloads, revisit_bytes), chunk_bytes))
    lines.write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def _parsed(value: bytes, keep_parts: bool) -> tuple:
    split = value.find(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in value[:split].decode().split("\r\n"))
    length = int(head["Content-Length"])
    if split < 0 or len(value) - split - 8 != length:
        raise ValueError(f"record {head.get('WARC-Record-ID')} does not have the {length} bytes it declares")
    block = memoryview(value)[split + 4 : split + 4 + length]
    if hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"].removeprefix("sha256:"):
        raise ValueError(f"record {head['WARC-Record-ID']} does not have the content it declares")
    kind, segment = head["WARC-Type"], int(head.get("WARC-Segment-Number", 1))
    if kind == "response":
        # The payload starts after the head of the archived HTTP message.
        block = block[bytes(block[:4096]).find(b"\r\n\r\n") + 4 :]
    whole = kind == "response" and "WARC-Segment-Number" not in head
    number = lambda name: int(head[name]) if name in head else None
    return (
        head.get("WARC-Segment-Origin-ID", head["WARC-Record-ID"]),
        kind,
        number("X-Page-Id"),
        head.get("WARC-Refers-To"),
        number("X-Refers-To-Page"),
        head.get("WARC-Payload-Digest", "").removeprefix("sha256:"),
        segment,
        whole or kind == "revisit" or "WARC-Segment-Total-Length" in head,
        len(block),
        hashlib.sha256(block).hexdigest() if whole else None,
        bytes(block) if kind != "revisit" and (keep_parts or not whole) else None,
    )


def read_records(spark: SparkSession, path: str, *, keep_parts: bool = False) -> DataFrame:
    """The records of archives, one row per segment.

    ``digest`` is set for payloads of one segment. ``part`` holds the payload's bytes of the segment
    for payloads of several segments, and for all if ``keep_parts``. A record whose length or block
    digest differs from its head stops the job.
    """
    names = [field.split()[0] for field in PARSED_SCHEMA.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                values = batch.column(0).slice(start, 256).to_pylist()
                rows = [_parsed(value, keep_parts) for value in values if value]
                columns = list(zip(*rows)) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    raw = spark.read.option("lineSep", VERSION).text(path)
    return raw.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, PARSED_SCHEMA)


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and length of each record from its chunk rows in order; one chunk is held at a time."""
    current, state, length, expected = None, None, 0, 1
    for batch in batches:
        done: list[tuple[str, int, str]] = []
        columns = (batch.column(name) for name in ("record_id", "segment", "last", "part"))
        ids, segments, lasts, parts = columns
        for at in range(batch.num_rows):
            record, segment = ids[at].as_py(), segments[at].as_py()
            if record != current:
                current, state, length, expected = record, hashlib.sha256(), 0, 1
            if segment != expected:
                raise ValueError(f"segment {expected} of record {record} is missing")
            part = parts[at].as_buffer()
            state.update(part)
            length, expected = length + len(part), expected + 1
            if lasts[at].as_py():
                done.append((record, length, state.hexdigest()))
        made = list(zip(*done)) if done else [[], [], []]
        arrays = [pa.array(made[0], pa.string()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["record_id", "payload_bytes", "payload_digest"])


def read_payload_digests(spark: SparkSession, path: str) -> DataFrame:
    """One row per archived page: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    Both payload figures are counted from the archived bytes: of the record itself, or for a revisit
    of the response that it refers to. ``intact`` tells whether the digest is the declared one.
    """
    records = written(read_records(spark, path), "records")
    several = records.where("part is not null").select("record_id", "segment", "last", "part")
    streamed = (
        several.repartition("record_id")
        .sortWithinPartitions("record_id", "segment")
        .mapInArrow(_stream_digests, "record_id string, payload_bytes bigint, payload_digest string")
    )
    heads = records.where("role != 'continuation'")
    whole = heads.where("digest is not null").select(
        "record_id", F.col("block_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest")
    )
    long_heads = heads.where("role = 'response' and digest is null")
    shape = lambda frame: frame.select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        F.col("role").alias("record_type"),
        "refers_to",
        (F.col("payload_digest") == F.col("declared")).alias("intact"),
    )
    single = heads.where("digest is not null").withColumns(
        {"payload_bytes": F.col("block_bytes"), "payload_digest": F.col("digest")}
    )
    chunked = long_heads.join(streamed, "record_id")
    revisits = heads.where("role = 'revisit'")
    wanted = revisits.select(F.col("refers_id").alias("record_id")).distinct()
    targets = whole.union(streamed).join(wanted, "record_id", "left_semi")
    resolved = revisits.join(targets.withColumnRenamed("record_id", "refers_id"), "refers_id")
    return shape(single).unionByName(shape(chunked)).unionByName(shape(resolved))


def op3_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    path = f"{work_dir(spark, 'warc')}/archives"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_payload_digests(spark, path)


WARC_SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_page THEN first_page END AS refers_to,
       true AS intact
FROM firsts
"""
