import numpy as np
import pytest

from pyspark.sql import functions as F

from sessionloom.llm import mixing
from sessionloom.llm.mixing import drawn_counts, mix_documents, permuted, running_before, source_targets

SCHEMA = "doc_id bigint, text string, source string, rank int, start string"


def filled(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda name: (name is None, (name or "").encode()))
    weight = {name: weights[at % len(weights)] for at, name in enumerate(names)}
    target = {name: sum(sizes.values()) * weight[name] / sum(weight.values()) for name in names}
    capped = set()
    while over := [name for name in names if name not in capped and target[name] > most * sizes[name] + 1e-9]:
        excess = sum(target[name] - most * sizes[name] for name in over)
        capped |= set(over)
        for name in over:
            target[name] = most * sizes[name]
        rest = sum(weight[name] for name in names if name not in capped)
        for name in names:
            if name not in capped:
                target[name] += excess * weight[name] / rest
    return target


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 100, "c": 100},
        {"a": 1, "b": 1, "c": 1000, None: 5},
        {"é": 10, "z": 70, "": 3, "Z": 900, None: 0},
        {"only": 17},
        {"none": 0},
    ],
)
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {row.source: row.target for row in source_targets(frame).collect()}
    assert got == pytest.approx(filled(sizes))


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64, 1000])
def test_permutation(size):
    images = permuted(np.arange(size), size, 42)
    assert sorted(images) == list(range(size))
    assert size < 64 or (images != np.arange(size)).mean() > 0.9
    assert size < 64 or (permuted(np.arange(size), size, 43) != images).any()


def rows():
    out = [(at, " ".join(f"w{at}.{n}" for n in range(at % 90)) + "\n\ttail ", f"s{at % 4}", 0, "") for at in range(160)]
    out += [(1000 + at, "  hot\n" + "word " * 30, "hot", 0, "") for at in range(80)]
    return out + [(None, None, None, 0, ""), (5000, "lost words of no source", None, 0, ""), (5001, " \n", "s0", 0, "")]


def test_mix(spark):
    frame = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    placed, mixed = mix_documents(frame, block_words=16, shard_slots=64)
    documents = placed.collect()
    assert len(documents) == len(rows())
    pieces = mixed.collect()
    taken, texts = {}, {row[0]: row[1] for row in rows()}
    for piece in pieces:
        text = texts[piece.id]
        assert piece.piece.split() == text.split()[piece.first_word : piece.first_word + piece.n_words]
        assert piece.piece in text
        key = (piece.rank, piece.start)
        taken[key] = taken.get(key, 0) + piece.n_words
    by_source = {}
    for row in documents:
        own = taken.get((row.rank, row.start), 0) if row["size"] else 0
        assert own <= 3 * row["size"]
        total = by_source.setdefault(row.rank, [0, 0, row.source_size, row.target])
        total[0] += row["size"]
        total[1] += own
    for size, words_taken, source_size, target in by_source.values():
        assert size == source_size and abs(words_taken - target) <= 1
    again = mix_documents(frame, block_words=16, shard_slots=64)[1].collect()
    same = lambda found: sorted((p.rank, p.start, p.shard, p.slot, p.first_word, p.n_words) for p in found)
    assert same(again) == same(pieces)
    assert len({piece.shard for piece in pieces}) > 3


def test_empty_table(spark):
    placed, mixed = mix_documents(spark.createDataFrame([], SCHEMA))
    assert placed.count() == 0 and mixed.count() == 0


def test_running_sums_over_ranges(spark):
    frame = spark.range(500).select((F.col("id") * 7919 % 503).alias("key")).repartition(5)
    got = running_before(frame, [F.col("key")], {"before": F.col("key"), "rank": F.lit(1)}).orderBy("key").collect()
    keys = [row.key for row in got]
    assert keys == sorted(keys) and [row["rank"] for row in got] == list(range(500))
    assert [row.before for row in got] == [sum(keys[:at]) for at in range(500)]


def test_every_shard_draws_its_own_counts(spark):
    """Counts per shard add up to its size and scatter around the shares as multinomial counts do."""
    slots = [4000, 900, 60, 0, 40]
    planned = [(at, own, sum(slots[:at])) for at, own in enumerate(slots)]
    frame = spark.createDataFrame(planned, "rank int, slots bigint, before bigint")
    rows = drawn_counts(frame, sum(slots), 128).collect()
    table = np.zeros((-(-5000 // 128), 5))
    for row in rows:
        table[row.shard, row["rank"]] = row.drawn
    assert list(table.sum(axis=1)) == [128] * 39 + [8] and table[:, 3].sum() == 0
    share = np.array(slots) / 5000
    spread = table[:39].std(axis=0)[:2] / np.sqrt(128 * share * (1 - share))[:2]
    assert (abs(table[:39].mean(axis=0) - 128 * share) < 4).all() and ((0.7 < spread) & (spread < 1.3)).all()
    assert len({tuple(row) for row in table[:39]}) > 30


def test_shards_are_full_and_slots_are_shown_once(spark):
    frame = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    pieces = mix_documents(frame, block_words=16, shard_slots=64)[1].collect()
    slots = {(piece.rank, piece.slot): piece.shard for piece in pieces}
    sizes = np.bincount(list(slots.values()))
    assert set(sizes[:-1]) == {64} and 0 < sizes[-1] <= 64
    for rank in {rank for rank, _ in slots}:
        own = sorted(slot for of, slot in slots if of == rank)
        assert own == list(range(len(own)))
    places = [(piece.rank, piece.start, piece["pass"], piece.first_word) for piece in pieces]
    assert len(places) == len(set(places))


def test_many_sources(spark):
    """More sources than slots of a shard; each source's words come to its target."""
    data = [(at, " ".join(["w"] * (1 + at % 7)), f"s{at:04}", 0, "") for at in range(700)]
    placed, mixed = mix_documents(spark.createDataFrame(data, SCHEMA), block_words=4, shard_slots=16)
    taken = {row["rank"]: row.n for row in mixed.groupBy("rank").agg(F.sum("n_words").alias("n")).collect()}
    for row in placed.collect():
        assert abs(taken.get(row["rank"], 0) - row.target) <= 1


def test_very_long_text(spark):
    data = [(1, "long " * 60_000, "a", 0, ""), (2, "short text", "b", 0, "")]
    placed, mixed = mix_documents(spark.createDataFrame(data, SCHEMA))
    taken = {row.id: row.n for row in mixed.groupBy("id").agg(F.sum("n_words").alias("n")).collect()}
    target = {row.id: row.target for row in placed.collect()}
    assert abs(taken[1] - target[1]) <= 1 and taken[2] == 6
    assert mixing.MOST_PASSES == 3
