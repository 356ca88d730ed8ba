import gzip
import hashlib
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import warc
from sessionloom.llm.warc import VERSION, read_payload_digests, read_records, write_warc

SCHEMA = "page_id bigint, url string, html string, record_no int, chunk string"
PAGES = [
    (1, "http://a/1", None),
    (2, None, ""),
    (None, "x\r\nWARC-Type: forged", "a" * 150),
    (4, "z", "a" * 150),
    (4, "z", "a" * 150),
    (3, "q", "b" * 99),
    (5, "q", "b" * 99),
    (6, "w", f"head {VERSION}{VERSION} tail é" * 30),
    (7, "v", "long payload \r\n\r\n" * 5000),
    (8, "v", "long payload \r\n\r\n" * 5000),
]


@pytest.mark.parametrize("chunk_bytes", [7, 1000, 1 << 20])
def test_round_trip(spark, tmp_path, chunk_bytes):
    pages = [page for page in PAGES if chunk_bytes > 7 or page[0] not in (7, 8)]
    path = str(tmp_path / "archives")
    frame = spark.createDataFrame([(*page, 0, "c") for page in pages], SCHEMA).repartition(3)
    write_warc(frame, path, chunk_bytes=chunk_bytes)
    got = read_payload_digests(spark, path).collect()
    sha = lambda text: hashlib.sha256((text or "").encode()).hexdigest()
    want = sorted((page[0] or -1, len((page[2] or "").encode()), sha(page[2])) for page in pages)
    assert sorted((row.page_id or -1, row.payload_bytes, row.payload_digest) for row in got) == want
    assert all(row.intact for row in got)
    revisits = sorted((row.page_id or -1, row.refers_to) for row in got if row.record_type == "revisit")
    assert revisits == sorted([(-1, 4), (4, 4)] + ([(8, 7)] if chunk_bytes > 7 else []))
    records = read_records(spark, path, keep_parts=True).where("role != 'revisit'")
    assert records.agg(F.max("block_bytes")).first()[0] <= chunk_bytes
    parts = records.where("page_id = 6").orderBy("segment").collect()
    assert b"".join(bytes(row.part) for row in parts).decode() == next(page[2] for page in pages if page[0] == 6)


def test_standard_layout(spark, tmp_path):
    path = tmp_path / "archives"
    write_warc(spark.createDataFrame([(9, "http://a", "hello", 0, "")], SCHEMA).coalesce(1), str(path))
    body = b"".join(gzip.decompress(file.read_bytes()) for file in Path(path).glob("*.gz"))
    assert body.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and body.endswith(b"hello\r\n\r\n")
    head = body.split(b"\r\n\r\n")[0].decode()
    block = body.split(b"\r\n\r\n", 1)[1][:-4]
    assert f"Content-Length: {len(block)}" in head


def test_damage_is_found(spark, tmp_path):
    path = tmp_path / "archives"
    write_warc(spark.createDataFrame([(9, "http://a", "hello", 0, "")], SCHEMA).coalesce(1), str(path))
    file = next(Path(path).glob("*.gz"))
    body = gzip.decompress(file.read_bytes()).replace(b"hello", b"hellO")
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "part.gz").write_bytes(gzip.compress(body))
    with pytest.raises(Exception, match="content it declares"):
        read_records(spark, str(bad)).collect()


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "archives")
    write_warc(spark.createDataFrame([], SCHEMA), path)
    assert read_payload_digests(spark, path).count() == 0


def test_chunk_rows_come_in_bounded_batches(spark, monkeypatch):
    """Batches of chunk rows stay below the bound, whatever the payloads; the rows are the same."""
    bodies = [b"x" * 5_000, b"", b"y" * 10, b"z" * 12_345] * 3
    schema = "record_no bigint, page_id bigint, url string, role string, refers_no bigint, refers_to bigint, payload_bytes bigint, payload_digest string, body binary"
    rows = [(at, at, "u", "response", None, None, len(body), "d", bytearray(body)) for at, body in enumerate(bodies)]
    seen = []
    frame = spark.createDataFrame(rows, schema).coalesce(1)

    class Table:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            seen.extend(run(iter(frame.toArrow().combine_chunks().to_batches())))
            return seen

    monkeypatch.setattr(warc, "BATCH_BYTES", 4_000)
    warc.chunk_table(Table(), chunk_bytes=1_000)
    assert max(sum(len(part.as_py()) for part in batch.column("part")) for batch in seen) <= 4_000
    joined = {}
    for batch in seen:
        for row in batch.to_pylist():
            joined[row["record_no"]] = joined.get(row["record_no"], b"") + row["part"]
    assert [joined[at] for at in range(len(bodies))] == bodies
