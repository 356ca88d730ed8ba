import random

import pytest
from pyspark.sql import functions as F

from sessionloom.llm.sharding import find_cuts, shard_by_bytes

SCHEMA = "doc_id bigint, text string, shard string, _k1 int"


def shards_of(spark, rows, shards, **settings):
    return shard_by_bytes(spark.createDataFrame(rows, SCHEMA), shards, **settings).collect()


def test_sizes_slots_and_ties(spark):
    draw = random.Random(1)
    rows = [(at, "x" * draw.randrange(400), "s", at) for at in range(3000)]
    rows += [(10_000 + at, "hot copy " * 20, "s", at) for at in range(1500)]  # a third of all rows
    rows += [(None, None, None, None)] * 3 + [(7, "x", "s", 7)] * 2
    result = shards_of(spark, rows, 10, piece_bytes=20_000)
    assert len(result) == len(rows)
    sizes, slots = {}, {}
    for row in result:
        assert row["size"] == len(row.text or "") + 16
        sizes[row["shard"]] = sizes.get(row["shard"], 0) + row["size"]
        slots.setdefault(row["shard"], []).append(row.slot)
    mean = sum(sizes.values()) / 10
    assert sorted(sizes) == list(range(10))
    assert all(abs(size - mean) <= 2 * 416 + 0.002 * mean for size in sizes.values())
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())


def test_reruns_agree(spark):
    rows = [(at, f"text {at % 50}", None, 1) for at in range(300)]
    first, second = (sorted(map(tuple, shards_of(spark, rows, 7))) for _ in range(2))
    assert first == second


@pytest.mark.parametrize("rows", [[], [(1, "only", "s", 1)], [(None, None, None, None)]])
def test_few_rows(spark, rows):
    result = shards_of(spark, rows, 40)
    assert [(row.text, row.slot) for row in result] == [(row[1], 0) for row in rows]


def test_cuts_bound_equal_bytes(spark):
    keys = spark.range(2000).select(
        F.xxhash64("id").alias("_k1"), F.xxhash64("id", F.lit(1)).alias("_k2"), F.lit(10).cast("bigint").alias("_size")
    )
    cuts = find_cuts(keys, 8, tolerance=0.0)
    assert cuts == sorted(cuts) and len(cuts) == 7
    values = sorted(((row._k1 % 2**64) << 64) | (row._k2 % 2**64) for row in keys.collect())
    below = [sum(value < cut for value in values) for cut in cuts]
    assert below == [250 * at for at in range(1, 8)]
