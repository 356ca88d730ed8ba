"""Near-duplicate documents by ProbMinHash.

Every distinct run of five words of a text is an element with weight 1 + ln(occurrences). The
elements arrive in Poisson processes whose rates are the weights; each arrival falls into one of
the registers, which keep their earliest arrival. Once the arrival times pass the latest register,
an element stops (early termination), so a text costs little more than one arrival per element.
The share of equal registers of two texts estimates their probability Jaccard similarity. Texts
that agree in a whole band of registers are verified with the exact similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.components import connected_components
from sessionloom.llm.text import (
    NEAR,
    documents_table,
    mix64,
    shingle_hashes,
    steps,
    text_bytes,
    word_hashes,
    word_spans,
    written,
)

BANDS = 25
BAND_ROWS = 5
REGISTERS = BANDS * BAND_ROWS
# Registers of the finer estimate for texts in shared buckets.
FINE_REGISTERS = 512
ELEMENT_BITS = 44
# Members that one task compares with a pivot before the pivot's text is sent to another task.
MEMBERS_PER_SALT = 256
# Bits kept of every register to estimate similarities, and the estimate below which a pair is not
# verified: 4.5 standard errors under the threshold.
NIBBLE = 4
ERRORS_BELOW = 4.5
# A similarity is a sum of quotients; one that equals the threshold may come out this much below it.
ROUNDING = 1e-9
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def weighted_elements(column: pa.Array):
    """Element keys, weights and owners of all distinct shingles of a batch, by owner."""
    data, offsets = text_bytes(column)
    starts, ends, owner = word_spans(data, offsets)
    runs, of = shingle_hashes(word_hashes(data, starts, ends), owner, len(column))
    packed = np.sort((of.astype(np.uint64) << np.uint64(ELEMENT_BITS)) | (runs >> np.uint64(64 - ELEMENT_BITS)))
    first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.zeros(0, int)
    counts = np.diff(np.append(first, len(packed)))
    packed = packed[first]
    owners = (packed >> np.uint64(ELEMENT_BITS)).astype(np.int64)
    return packed & np.uint64((1 << ELEMENT_BITS) - 1), 1.0 + np.log(counts), owners


def registers(
    elements: np.ndarray, weights: np.ndarray, owners: np.ndarray, texts: int, count: int = REGISTERS
) -> np.ndarray:
    """The element that arrives first in each register; texts without elements keep zeros.

    All elements advance together. Arrival ``n`` of an element depends only on the element and
    ``n``, so the result does not depend on how many arrivals a round takes; rounds get longer
    because few elements, those of short texts, need many arrivals.
    """
    earliest = np.full(texts * count, np.inf)
    holder = np.zeros(texts * count, dtype=np.uint64)
    limit = np.full(texts, np.inf)
    clock = np.zeros(len(elements))
    done, size = 0, 1
    while len(elements):
        nth = (np.arange(done + 1, done + size + 1, dtype=np.uint64) * GOLDEN)[None, :]
        draw = mix64(elements[:, None] + nth)
        waits = -np.log1p(-((draw >> np.uint64(11)).astype(np.float64) / (1 << 53))) / weights[:, None]
        times = clock[:, None] + np.cumsum(waits, axis=1)
        place = (mix64(draw ^ GOLDEN) >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)
        slot = owners[:, None] * count + place.astype(np.int64)
        near = times < earliest[slot]
        at, when = slot[near], times[near]
        np.minimum.at(earliest, at, when)
        won = earliest[at] == when
        holder[at[won]] = np.broadcast_to(elements[:, None], slot.shape)[near][won]
        touched = np.unique(owners)
        limit[touched] = earliest.reshape(texts, count)[touched].max(axis=1)
        clock = times[:, -1]
        alive = clock < limit[owners]
        elements, weights, owners, clock = elements[alive], weights[alive], owners[alive], clock[alive]
        done += size
        size = min(done, 256)
    return holder.reshape(texts, count)


def band_values(sketch: np.ndarray) -> np.ndarray:
    """One hash for each text and band."""
    grouped = sketch.reshape(len(sketch), BANDS, BAND_ROWS)
    value = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN, grouped.shape[:2]).copy()
    for row in range(BAND_ROWS):
        value = mix64(value + grouped[:, :, row])
    return value.view(np.int64)


def packed_registers(sketch: np.ndarray) -> np.ndarray:
    """Four hashed bits of every register, sixteen registers to a number."""
    bits = mix64(sketch) >> np.uint64(64 - NIBBLE)
    shifts = np.arange(16, dtype=np.uint64) * np.uint64(NIBBLE)
    return np.bitwise_or.reduce(bits.reshape(len(sketch), -1, 16) << shifts, axis=2).view(np.int64)


def _agreeing(left: Column, right: Column) -> Column:
    """Fine registers whose packed bits agree in two rows."""
    differing = F.lit(0)
    for at in range(FINE_REGISTERS // 16):
        apart = F.get(left, F.lit(at)).bitwiseXOR(F.get(right, F.lit(at)))
        folded = apart.bitwiseOR(F.shiftrightunsigned(apart, 2))
        folded = folded.bitwiseOR(F.shiftrightunsigned(folded, 1)).bitwiseAND(F.lit(0x1111111111111111))
        differing = differing + F.bit_count(folded)
    return F.lit(FINE_REGISTERS) - differing


def least_agreement(threshold: float) -> int:
    """Agreeing fine registers below which a pair is taken to be under the threshold."""
    share = threshold + (1 - threshold) / (1 << NIBBLE)
    return int(FINE_REGISTERS * share - ERRORS_BELOW * (FINE_REGISTERS * share * (1 - share)) ** 0.5)


def _lists(values: np.ndarray, filled: np.ndarray) -> pa.Array:
    """A list per text, empty for texts without words."""
    ends = np.concatenate([[0], np.cumsum(filled) * values.shape[1]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch, "text"):
            elements = weighted_elements(part.column("text"))
            filled = np.bincount(elements[2], minlength=part.num_rows) > 0
            bands = _lists(band_values(registers(*elements, part.num_rows)[filled]), filled)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("node"), bands], ["id", "node", "bands"])


def _fine_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch, "text"):
            elements = weighted_elements(part.column("text"))
            filled = np.ones(part.num_rows, dtype=bool)
            bands = _lists(band_values(registers(*elements, part.num_rows)), filled)
            bits = _lists(packed_registers(registers(*elements, part.num_rows, FINE_REGISTERS)), filled)
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), part.column("text"), bands, bits], ["node", "text", "bands", "bits"]
            )


def similarity(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets, each given as sorted hashes and weights."""
    (a, wa), (b, wb) = left, right
    _, in_a, in_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(in_a):
        return 0.0
    only_a, only_b = wa.sum() - wa[in_a].sum(), wb.sum() - wb[in_b].sum()
    ca, cb = wa[in_a], wb[in_b]
    order = np.argsort(ca / cb, kind="stable")
    ca, cb = ca[order], cb[order]
    ratio = ca / cb
    # For element d, elements of at least its ratio count by the left weight, the others by the right.
    from_d = np.searchsorted(ratio, ratio, side="left")
    tail_a = np.concatenate([np.cumsum(ca[::-1])[::-1], [0.0]])[from_d]
    head_b = np.concatenate([[0.0], np.cumsum(cb)])[from_d]
    return float((1.0 / ((tail_a + only_a) / ca + (head_b + only_b) / cb)).sum())


def _weighted_sets(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(column)
    starts, ends, owner = word_spans(data, offsets)
    runs, of = shingle_hashes(word_hashes(data, starts, ends), owner, len(column))
    bounds = np.searchsorted(of, np.arange(len(column) + 1))
    sets = []
    for text in range(len(column)):
        own, counts = np.unique(runs[bounds[text] : bounds[text + 1]], return_counts=True)
        sets.append((own, 1.0 + np.log(counts)))
    return sets


def _verifier(threshold: float):
    """Streams rows sorted by pivot and salt, the pivot's text first, and yields verified links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pivot = None, None
        for batch in batches:
            for part in steps(batch, "text"):
                sets = _weighted_sets(part.column("text"))
                left, right, weight = [], [], []
                rows = zip(
                    part.column("pivot").to_pylist(),
                    part.column("salt").to_pylist(),
                    part.column("member").to_pylist(),
                    part.column("node").to_pylist(),
                    part.column("popularity").to_pylist(),
                    sets,
                )
                for of, salt, member, node, popularity, own in rows:
                    if not member:
                        current, pivot = (of, salt), own
                    elif current == (of, salt) and similarity(pivot, own) >= threshold - ROUNDING:
                        left.append(node)
                        right.append(of)
                        weight.append(popularity)
                columns = [pa.array(values, pa.int64()) for values in (left, right, weight)]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "popularity"])

    return run


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b, popularity) among ``pairs`` (node, pivot, popularity) whose texts are similar enough.

    The members of a pivot are dealt over salts; every salt gets the pivot's text once.
    """
    salts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / MEMBERS_PER_SALT).cast("int").alias("salts"))
    members = pairs.join(salts, "pivot").select(
        "pivot", F.pmod(F.xxhash64("node", "pivot"), "salts").cast("int").alias("salt"), F.lit(True).alias("member"), "node", "popularity"
    )
    pivots = salts.select(
        "pivot",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.lit(False).alias("member"),
        F.col("pivot").alias("node"),
        F.lit(0).cast("bigint").alias("popularity"),
    )
    rows = members.union(pivots).join(texts, "node")
    return (
        rows.select("pivot", "salt", "member", "node", "popularity", "text")
        .repartition("pivot", "salt")
        .sortWithinPartitions("pivot", "salt", "member")
        .mapInArrow(_verifier(threshold), "a bigint, b bigint, popularity bigint")
    )


def near_duplicate_classes(
    frame: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = NEAR
) -> DataFrame:
    """One row per input row: id, node, class_id, class_size, links and first.

    Texts are linked when their probability Jaccard over weighted five-word runs is ``threshold``
    or more, and classes are the connected components of links. ``class_id`` is the smallest id of
    the class, ``class_size`` its rows, ``links`` the verified links of the text to other texts
    that were used to connect the class, ``first`` marks rows with the class's smallest id. Equal
    texts are one node of the graph. A text of fewer than five words is one run. Null, empty and
    blank texts have no words: each is a class of its own, of size 1. Ids may be null or repeated:
    a class of null ids only has a null class id, and repeated rows count as copies. Other columns
    are ignored.

    Which pairs are verified: first every text with the most popular other text of its band buckets,
    the one that shares most buckets with others and so is in the middle of its group; this connects
    a group of near copies with one comparison per text. Then all other pairs that
    share a bucket and are not linked to the same such text, each in the first bucket they share,
    unless fewer of 512 registers agree than 4.5 standard errors below the threshold allow. Two texts of
    similarity 0.8 share no bucket with probability 0.00005, and are under the estimate with
    probability 0.000004. A node is a 64-bit hash of the text.
    """
    source = frame.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    ).select("id", F.xxhash64("text").alias("node"), "text")
    sketches = written(source.mapInArrow(_sketch_batches, "id bigint, node bigint, bands array<bigint>"), "sketches")
    rows = sketches.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = (
        rows.groupBy("bucket")
        .agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size"))
        .where("low != high")
    )
    members = written(rows.join(shared.select("bucket", "size"), "bucket").distinct(), "buckets")
    # The text of one row for every node in a shared bucket: the one with the smallest id.
    chosen = (
        sketches.groupBy("node")
        .agg(F.min("id").alias("id"))
        .join(members.select("node").distinct(), "node", "left_semi")
        .withColumnRenamed("id", "chosen")
    )
    texts = written(
        source.join(chosen, (source.node == chosen.node) & source.id.eqNullSafe(chosen.chosen))
        .select(source.node, source.text)
        .mapInArrow(_fine_batches, "node bigint, text string, bands array<bigint>, bits array<bigint>"),
        "texts",
    )
    popular = members.groupBy("node").agg(F.sum("size").alias("popularity"))
    pivots = (
        members.join(popular, "node")
        .groupBy("bucket")
        .agg(F.max(F.struct("popularity", "node")).alias("top"))
        .select("bucket", F.col("top.node").alias("pivot"), F.col("top.popularity").alias("popularity"))
    )
    pairs = written(
        members.join(pivots, "bucket")
        .where("node != pivot")
        .groupBy("node")
        .agg(F.max(F.struct("popularity", "pivot")).alias("top"))
        .select("node", "top.pivot", "top.popularity"),
        "pairs",
    )
    links = written(_verify(pairs, texts.select("node", "text"), threshold), "links")
    # Texts that are linked to the same pivot need not be compared with each other.
    label = links.groupBy("a").agg(F.max(F.struct("popularity", "b")).alias("top"))
    label = label.select(F.col("a").alias("node"), F.col("top.b").alias("label"))
    placed = members.join(label, "node", "left").select(
        "bucket", "band", "node", F.coalesce("label", "node").alias("label")
    )
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    signatures = texts.select("node", "bands", "bits").dropDuplicates(["node"])
    open_rows = written(placed.join(mixed.select("bucket"), "bucket").join(signatures, "node"), "open")
    left, right = open_rows.alias("l"), open_rows.alias("r")
    earlier = F.arrays_overlap(
        F.slice("l.bands", F.lit(1), F.col("l.band")), F.slice("r.bands", F.lit(1), F.col("r.band"))
    )
    fresh = left.join(
        right,
        (F.col("l.bucket") == F.col("r.bucket"))
        & (F.col("l.node") < F.col("r.node"))
        & (F.col("l.label") != F.col("r.label"))
        & (_agreeing(F.col("l.bits"), F.col("r.bits")) >= least_agreement(threshold))
        & ~earlier,
    ).select(F.col("l.node").alias("node"), F.col("r.node").alias("pivot"))
    known = pairs.select("node", "pivot").union(pairs.select("pivot", "node"))
    fresh = written(
        fresh.join(known, ["node", "pivot"], "left_anti").withColumn("popularity", F.lit(0).cast("bigint")), "pairs"
    )
    links = written(links.union(_verify(fresh, texts.select("node", "text"), threshold)).select("a", "b"), "links")
    roots = connected_components(links)
    degree = (
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
        .select(F.explode(F.array("a", "b")).alias("node"))
        .groupBy("node")
        .agg(F.count("*").alias("links"))
    )
    nodes = roots.join(degree, "node", "left")
    found = sketches.select("id", "node", (F.size("bands") == 0).alias("blank")).join(nodes, "node", "left")
    found = found.withColumn("root", F.coalesce("root", "node"))
    classes = (
        found.where("not blank").groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    )
    placed = found.join(classes, "root", "left")
    class_id = F.when(F.col("blank"), F.col("id")).otherwise(F.col("class_id"))
    return placed.select(
        "id",
        "node",
        class_id.alias("class_id"),
        F.when(F.col("blank"), F.lit(1)).otherwise(F.col("class_size")).cast("bigint").alias("class_size"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("links"),
        (F.col("blank") | F.col("id").eqNullSafe(F.col("class_id"))).alias("first"),
        "blank",
    )


def drop_near_duplicates(frame: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Keep one row of every class, that with the smallest id, with all columns.

    Rows with null, empty or blank text are all kept. Of rows that repeat the kept id and text,
    one stays.
    """
    classes = near_duplicate_classes(frame, doc_id=doc_id, text=text)
    kept = classes.where("first and not blank").select(F.col("id").alias("_id"), F.col("node").alias("_node")).distinct()
    has_words = F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    node = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    rows = frame.select(
        F.struct(*[f"`{name}`" for name in frame.columns]).alias("_row"),
        F.col(f"`{doc_id}`").cast("bigint").alias("_id"),
        node.alias("_node"),
        has_words.alias("_words"),
    )
    left, right = rows.where("_words").alias("l"), kept.alias("r")
    match = (F.col("l._node") == F.col("r._node")) & F.col("l._id").eqNullSafe(F.col("r._id"))
    first = left.join(right, match, "left_semi").dropDuplicates(["_node", "_id"])
    return first.select("_row.*").unionByName(rows.where("not _words").select("_row.*"))


def op1_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies of every document."""
    return near_duplicate_classes(documents_table(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "class_id", "class_size", "links", (F.col("class_size") > 1).alias("duplicated")
    )
