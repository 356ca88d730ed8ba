"""Mixing sources to target weights.

Each source's words are packed, document after document, into blocks of a fixed number of words.
Every output shard draws how many of its slots each source gets from a multinomial distribution:
each slot falls on a number below the sum of all sources' slots, and a source owns as many numbers
as it has slots. What a source was drawn above its target, at pseudorandom places, goes to sources
that were drawn too seldom, so every target is met and every shard keeps its size. The slots of a
source are mapped to its blocks by a pseudorandom permutation of the block numbers, a new one for
every pass over the source, and are joined with the blocks by that number.

Sums over all sources or shards in order are partial per range of them; only the sums of the ranges
meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.functions.evaluate import evaluate_once
from sessionloom.llm.text import documents_table, mix64, words, written

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
BLOCK_WORDS = 256
SHARD_SLOTS = 4096
SEED = 17
# Documents packed by one task; the packing of a larger source is divided.
PACK_ROWS = 2_000
# Shards whose counts are summed together when a source's slots are numbered.
SHARD_RANGE = 1_024
FEISTEL_ROUNDS = 4
# Source rows (about 60 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
# A word with the white space after it; the first also takes what is before it.
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def running_before(frame: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """Add for each name the sum of its value over all rows before a row; ``order`` is a total order.

    Rows are dealt to ranges of the order. Sums run within a range, and start from the sums of the
    ranges before it; there is one such sum for each shuffle partition.
    """
    named = {f"_{name}": value for name, value in values.items()}
    ranged = frame.withColumns(named).repartitionByRange(*order)
    ranged = written(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_range").agg(*[F.sum(name).alias(name) for name in named])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = [F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_start{name}") for name in named]
    known = F.broadcast(sums.select("_range", *starts))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.join(known, "_range").select(
        *frame.columns,
        *[
            (F.col(f"_start{name}") + F.coalesce(F.sum(name).over(inside), F.lit(0))).alias(name[1:])
            for name in named
        ],
    )
    return summed


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """Add ``rank``, ``weight`` and ``target`` to sources (source, source_size); one row per source.

    Sources in code point order, null last, take the weights in turn. Targets share the total by
    weight. No target exceeds ``most`` times its source's size: what is above is shared again by
    weight among the others until none is above. That ends where all uncapped sources get the same
    amount per unit of weight, and the capped ones are those with the least size per weight.
    """
    exact = lambda value: value.cast("decimal(30,6)")
    ranked = running_before(sizes, [F.col("source").isNull(), F.col("source")], {"rank": F.lit(1).cast("bigint")})
    listed = F.array(*[F.lit(weight) for weight in weights])
    weight = exact(F.get(listed, (F.col("rank") % len(weights)).cast("int")))
    limit = exact(F.col("source_size") * F.lit(most))
    weighted = ranked.withColumns({"rank": F.col("rank").cast("int"), "weight": weight, "limit": limit})
    room = F.col("limit").cast("double") / F.col("weight").cast("double")
    levelled = running_before(
        weighted.withColumn("room", room),
        [F.col("room"), F.col("rank")],
        {"limit_before": F.col("limit"), "weight_before": F.col("weight")},
    )
    levelled = written(levelled, "levels")
    whole = levelled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    left = F.lit(whole["size"] or 0).cast("double") - F.col("limit_before").cast("double")
    level = left / (F.lit(whole["weight"] or 1).cast("double") - F.col("weight_before").cast("double"))
    open_sources = levelled.withColumn("level", level).where(F.col("room") >= F.col("level"))
    common = open_sources.agg(F.min_by("level", F.struct("room", "rank"))).first()[0]
    share = F.lit(common).cast("double") * F.col("weight").cast("double")
    return levelled.select(
        "source",
        "source_size",
        "rank",
        F.col("weight").cast("double").alias("weight"),
        F.coalesce(F.least(F.col("limit").cast("double"), share), F.lit(0.0)).alias("target"),
    )


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Images of ``index`` under a keyed pseudorandom permutation of range(size).

    A balanced Feistel network permutes the next power of four; images outside the range are
    permuted again until they fall inside.
    """
    if size <= 1:
        return np.zeros_like(index)
    half = np.uint64(max(1, ((size - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    pending = np.arange(len(out))
    while len(pending):
        left, right = out[pending] >> half, out[pending] & mask
        for turn in range(FEISTEL_ROUNDS):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
            left, right = right, left ^ (mix64(right + salt) & mask)
        out[pending] = (left << half) | right
        pending = pending[out[pending] >= np.uint64(size)]
    return out.astype(np.int64)


def _shown(rank: int, slot: np.ndarray, row, block_words: int) -> pd.DataFrame:
    """Block, pass and words of slots of one source; ``row`` has its blocks, slots, last_words and cut."""
    turn, at = slot // row.blocks, slot % row.blocks
    block = at.copy()
    for one in np.unique(turn):
        # The last, possibly short block ends every pass.
        moved = (turn == one) & (at < row.blocks - 1)
        block[moved] = permuted(at[moved], row.blocks - 1, (int(rank) << 8) + int(one) + SEED)
    take = np.where(block == row.blocks - 1, row.last_words, block_words)
    take[slot == row.slots - 1] = row.cut
    return pd.DataFrame({"rank": rank, "block": block, "slot": slot, "pass": turn, "take": take})


SLOT_SCHEMA = "rank int, block bigint, shard bigint, slot bigint, pass bigint, take bigint, unit bigint"


def _expand_slots(block_words: int):
    """Slots of each source and shard from its count; those above the source's target become units to give away."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                number = permuted(np.arange(row.first, row.first + row.drawn), row.total_drawn, (int(row.rank) << 8) + 255 + SEED)
                kept = number[number < row.slots]
                yield _shown(row.rank, kept, row, block_words).assign(shard=row.shard, unit=pd.array([None] * len(kept), "Int64"))
                unit = number[number >= row.slots] - row.slots + row.surplus_before
                if len(unit):
                    yield pd.DataFrame({"rank": row.rank, "shard": row.shard, "unit": unit}).reindex(
                        columns=["rank", "block", "shard", "slot", "pass", "take", "unit"]
                    ).astype({name: "Int64" for name in ("block", "slot", "pass", "take")})

    return run


def _fill_slots(block_words: int):
    """Slots for the units that sources drawn too seldom take over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rank, rows in batch.groupby("rank"):
                one = next(rows.itertuples())
                shown = _shown(rank, rows["slot"].to_numpy(), one, block_words)
                yield shown.assign(shard=rows["shard"].to_numpy(), unit=rows["unit"].to_numpy())

    return run


def drawn_counts(planned: DataFrame, total: int, shard_slots: int) -> DataFrame:
    """Rows (shard, rank, drawn): multinomial counts of the sources over the slots of every shard.

    ``planned`` has the number of ``slots`` of each source and of those ``before`` it. Each of the
    shard's slots, all but the last shard's being ``shard_slots``, falls on a number below ``total``;
    numbers meet the sources that own them in buckets, of which there are more than sources.
    """
    sources = planned.count()
    width = max(1, total // max(4_096, 4 * sources))
    owned = planned.where("slots > 0").select(
        "rank",
        F.col("before").alias("low"),
        (F.col("before") + F.col("slots")).alias("high"),
        F.explode(F.sequence(F.floor(F.col("before") / width), F.floor((F.col("before") + F.col("slots") - 1) / width))).alias("bucket"),
    )
    fallen = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(max(1, total)))
    draws = planned.sparkSession.range(total).select(F.floor(F.col("id") / shard_slots).alias("shard"), fallen.alias("on"))
    draws = draws.withColumn("bucket", F.floor(F.col("on") / width))
    met = draws.join(owned, "bucket").where((F.col("on") >= F.col("low")) & (F.col("on") < F.col("high")))
    return met.groupBy("shard", "rank").agg(F.count("*").alias("drawn"))


def _numbered(counts: DataFrame) -> DataFrame:
    """Add ``first``, the source's slots in the shards before; ranges of shards are summed first."""
    ranged = counts.withColumn("range", F.floor(F.col("shard") / SHARD_RANGE))
    before = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("rank", "range").agg(F.sum("drawn").alias("sum"))
    starts = sums.select("rank", "range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("rank", "range").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("first", F.coalesce(F.sum("drawn").over(inside), F.lit(0)))
    joined = within.join(starts, ["rank", "range"])
    return joined.select("rank", "shard", "drawn", (F.col("first") + F.col("start")).alias("first"))


def _slots(sources: DataFrame, block_words: int, shard_slots: int) -> DataFrame:
    """Rows (rank, block, shard, slot, pass, take): which block each slot of a source shows.

    A source's target is met to the word: whole passes over its blocks, then as many blocks of one
    more pass as are needed, the last of them cut to ``take`` words.
    """
    size, words_wanted = F.col("source_size"), F.floor(F.col("target") + 1e-6).cast("bigint")
    whole = words_wanted - F.pmod(words_wanted, size)
    rest = F.pmod(words_wanted, size)
    blocks = F.ceil(size / block_words).cast("bigint")
    last_words = size - (blocks - 1) * block_words
    extra = F.ceil(rest / block_words).cast("bigint")
    planned = sources.where(size > 0).select(
        "rank",
        blocks.alias("blocks"),
        ((whole / size).cast("bigint") * blocks + extra).alias("slots"),
        last_words.alias("last_words"),
        F.when(rest > 0, rest - (extra - 1) * block_words).otherwise(last_words).alias("cut"),
    )
    planned = written(running_before(planned, [F.col("rank")], {"before": F.col("slots")}), "planned")
    total = planned.agg(F.sum("slots")).first()[0] or 0
    counts = written(drawn_counts(planned, total, shard_slots), "drawn")
    drawn = counts.groupBy("rank").agg(F.sum("drawn").alias("total_drawn"))
    settled = planned.drop("before").join(drawn, "rank", "left")
    settled = settled.withColumn("total_drawn", F.coalesce("total_drawn", F.lit(0)))
    over = F.col("total_drawn") - F.col("slots")
    settled = written(
        running_before(
            settled,
            [F.col("rank")],
            {"surplus_before": F.greatest(over, F.lit(0)), "missing_before": F.greatest(-over, F.lit(0))},
        ),
        "settled",
    )
    own = ["blocks", "slots", "last_words", "cut"]
    expanded = _numbered(counts).join(settled, "rank").select(
        "rank", "shard", "drawn", "first", "total_drawn", "surplus_before", *own
    )
    expanded = written(expanded.repartition("shard", "rank").mapInPandas(_expand_slots(block_words), SLOT_SCHEMA), "slots")
    missing = settled.where("total_drawn < slots").select(
        "rank", *own, "total_drawn", "missing_before", F.explode(F.sequence(F.lit(0), F.col("slots") - F.col("total_drawn") - 1)).alias("nth")
    )
    missing = missing.select(
        "rank", *own, (F.col("total_drawn") + F.col("nth")).alias("slot"), (F.col("missing_before") + F.col("nth")).alias("unit")
    )
    given = expanded.where("unit is not null").select("unit", "shard")
    filled = missing.join(given, "unit").mapInPandas(_fill_slots(block_words), SLOT_SCHEMA)
    return expanded.where("unit is null").unionByName(filled).drop("unit")


def mix_documents(
    frame: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_PASSES,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
) -> tuple[DataFrame, DataFrame]:
    """The documents with their place in the packed sources, and the mix.

    First frame: one row per input row: ``row`` (all columns but the text), ``id``, ``rank``, ``start`` (first
    word in the source's packing; with rank it identifies a row that has words), ``size`` (words),
    ``source_size``, ``target``. Second frame, one row per piece of a document in a slot: ``row``
    (as above), ``id``, ``rank``, ``start``, ``shard``, ``slot``, ``pass``,
    ``first_word`` and ``n_words`` in the document, and ``piece``, the text of these words with its
    white space.

    A null source is a source of its own, after all others. Texts without words (null, empty,
    blank) have size 0 and are never taken. Rows with equal id and text are packed one after the
    other, each as a document. Ids may be null. An empty table gives empty frames.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    narrow = frame.select(
        F.col(f"`{source}`").alias("source"),
        F.xxhash64(F.col(f"`{doc_id}`"), body).alias("order"),
        F.size(words(body)).cast("bigint").alias("size"),
    )
    sizes = written(narrow, "sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    pieces = totals.select("source", F.ceil(F.col("rows") / PACK_ROWS).cast("int").alias("parts"))
    sources = written(source_targets(totals.drop("rows"), weights, most).join(
        pieces.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))
    ).drop("s"), "sources")
    few = sources.count() <= BROADCAST_SOURCES
    known = F.broadcast(sources) if few else sources
    part = F.pmod("order", F.col("parts")).cast("int")
    before = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    joined = sizes.alias("d").join(known.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    offsets = (
        joined.groupBy("rank", part.alias("part"))
        .agg(F.sum("size").alias("words"))
        .select("rank", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("part_start"))
    )
    rows = frame.select(
        F.struct(*[f"`{name}`" for name in frame.columns if name != text]).alias("row"),
        F.col(f"`{doc_id}`").alias("id"),
        F.col(f"`{source}`").alias("source"),
        F.xxhash64(F.col(f"`{doc_id}`"), body).alias("order"),
        body.alias("body"),
    )
    rows = evaluate_once(rows, {"size": F.size(words(F.col("body"))).cast("bigint")})
    rows = rows.alias("d").join(known.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    rows = rows.select("row", "id", "order", "body", "size", "rank", "source_size", "target", part.alias("part"))
    rows = rows.join(offsets, ["rank", "part"])
    running = Window.partitionBy("rank", "part").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn(
        "start", F.col("part_start") + F.coalesce(F.sum("size").over(running), F.lit(0))
    ).select("row", "id", "rank", "start", "size", "source_size", "target", "body")
    first_block = F.floor(F.col("start") / block_words).cast("bigint")
    last_block = F.floor((F.col("start") + F.col("size") - 1) / block_words).cast("bigint")
    spaced = evaluate_once(
        placed.where("size > 0"), {"spaced": F.regexp_extract_all("body", F.lit(SPACED_WORD), F.lit(0))}
    )

    def fragment(block):
        low = F.greatest(block * block_words, F.col("start"))
        high = F.least((block + 1) * block_words, F.col("start") + F.col("size"))
        cut = F.slice("spaced", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
        return F.struct(
            block.alias("block"),
            (low - block * block_words).alias("inside"),
            (low - F.col("start")).alias("first_word"),
            (high - low).alias("n_words"),
            F.array_join(cut, "").alias("piece"),
        )

    blocks = spaced.select(
        "row", "id", "rank", "start", F.inline(F.transform(F.sequence(first_block, last_block), fragment))
    )
    room = F.col("take") - F.col("inside")
    shown = F.least("n_words", room)
    piece = F.when(room >= F.col("n_words"), F.col("piece")).otherwise(
        F.array_join(F.slice(F.regexp_extract_all("piece", F.lit(SPACED_WORD), F.lit(0)), 1, shown.cast("int")), "")
    )
    # Slots outnumber the source rows they are made from, which the planner cannot know: it must
    # not take them for a small side.
    slots = _slots(sources, block_words, shard_slots).hint("merge")
    mixed = (
        blocks.join(slots, ["rank", "block"])
        .where(room > 0)
        .select("row", "id", "rank", "start", "shard", "slot", "pass", "first_word", shown.alias("n_words"), piece.alias("piece"))
    )
    return placed.drop("body"), mixed


def op6_block_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    placed, mixed = mix_documents(documents_table(spark, sf_dir))
    taken = mixed.groupBy("rank", "start").agg(F.sum("n_words").alias("taken"), F.max("pass").alias("last_pass"))
    has_words = placed.where("size > 0").select("id", "size", "source_size", "target", "rank", "start")
    counted = has_words.join(taken, ["rank", "start"], "left")
    return counted.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    ).union(placed.where("size = 0").select("id", "size", "source_size", "target", F.lit(0).cast("bigint")))
