"""Line deduplication by an exact set-similarity join.

A line is the set of its words, and a line goes if an earlier one is similar: Jaccard of 0.8 or
more. The words of a line are ordered by rarity. Two similar lines must share a word among their
first few, the prefix, so only prefix words are joined, and of the smaller set only those of a shorter
prefix; pairs whose sizes, places of the shared word or word bitmaps cannot reach the threshold are
left out in the join itself. The remaining pairs are verified on the words.

Rarity is counted over all words in a fixed number of hash buckets. That order is the same for all
lines, which is all the join needs to be exact; it only decides how many pairs share a prefix word.
Words are compared as 64-bit hashes, whose low bits are replaced by the rank of their bucket, as high
bits. Texts are cut into words and hashed in numpy, batch by batch: with column functions that took
half of the operator's time (the README has the figures). All joins are column code.

Pairs grow with the square of a family of similar sets, so no table holds them: a set only learns its smallest
candidate, its home if that is smaller than itself, and a second join of the few sets with candidates sends every set to
the homes of its smaller candidates. There a set is known by what it lacks and adds to the words of the home. Two counts
of those settle most pairs, bitmaps others, and the few words themselves the rest; what is found is summed per set in the
task that finds it. Sets that share a word or home with very many others are dealt to blocks, so that no task compares all
of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.text import documents_table, mix64, removed, steps, text_bytes, word_hashes, word_spans, written
from sessionloom.session import work_dir

PERCENT = 80
BUCKET_BITS = 16
# Document keys (about 40 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
# Sets with one home that meet in one task; more are dealt to blocks of about this size.
CROWD = 1_024
# The same for sets with one prefix word, which are compared faster; blocks cost a copy of their word's sets each.
WORD_CROWD = 16_384
# Words of 64 bits in the bitmaps that judge pairs at a home.
LANES = 4
# Shuffle files of a written table go when it is written, and not with the driver's next full collection.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Sets smaller than this can only be similar to equal ones.
LEAST_SIZE = 100 // (100 - PERCENT) - 1


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a task's texts in each hash bucket."""
    counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    for batch in batches:
        for part in steps(batch, "text"):
            data, offsets = text_bytes(part.column("text"))
            starts, ends, _ = word_spans(data, offsets)
            counts += np.bincount(_bucket(word_hashes(data, starts, ends)), minlength=len(counts))
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["bucket", "words"])


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64)


def rarity(texts: DataFrame, crowd: int | None = None) -> tuple[np.ndarray, int]:
    """The rank of every hash bucket by the number of words in it.

    Also returns the first rank whose bucket holds ``crowd`` words, by default ``CROWD``.
    """
    crowd = CROWD if crowd is None else crowd
    counted = texts.select("text").mapInArrow(_count_batches, "bucket int, words bigint")
    counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("words").alias("words")).collect():
        counts[row.bucket] = row.words
    ranks = np.empty(len(counts), dtype=np.int64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    return ranks, int((counts < crowd).sum())


def _order(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """What sorts by group, which ascends, and by signed value."""
    bits = int(group[-1]).bit_length() if len(group) else 0
    # One sort of whole numbers that hold the group and the high bits of the value is several times faster than two.
    upper = (value.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(bits)
    key = (group.astype(np.uint64) << np.uint64(64 - bits) | upper) if bits else upper
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    if (value[order[1:]] != value[order[:-1]])[same].any():
        return np.lexsort((value, group))
    return order


def token_values(hashes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Words as whole numbers whose order is that of rarity; different hashes stay different."""
    # Whole numbers are signed: the rarest bucket gets the smallest one.
    high = (ranks[_bucket(hashes)] - (1 << (BUCKET_BITS - 1))) << (64 - BUCKET_BITS)
    return high | (hashes >> np.uint64(BUCKET_BITS)).astype(np.int64)


def _overlap_is_enough(overlap: Column, left: Column, right: Column) -> Column:
    """Whether two sets of these sizes reach the threshold with so many shared words."""
    return overlap * (100 + PERCENT) >= (left + right) * PERCENT


LINE_SCHEMA = "id bigint, node bigint, line int, h1 bigint, h2 bigint, size int, bits bigint, more bigint, prefix array<int>"
_SECOND_HASH = np.uint64(0xA0761D6478BD642F)


def line_sets(column: pa.Array, ranks: np.ndarray):
    """Text, line, two hashes, size, bitmap and prefix of the word set of every line with words.

    The prefix comes as the words of all prefixes and their number per line.
    """
    return _line_parts(column, ranks)[:-1]


def _line_parts(column: pa.Array, ranks: np.ndarray):
    """What ``line_sets`` gives and a second bitmap."""
    data, offsets = text_bytes(column)
    starts, ends, text = word_spans(data, offsets)
    token = token_values(word_hashes(data, starts, ends), ranks)
    breaks = np.flatnonzero(data == ord("\n"))
    line = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[:-1])[text]
    fresh = np.ones(len(token), dtype=bool)
    fresh[1:] = (text[1:] != text[:-1]) | (line[1:] != line[:-1])
    group = np.cumsum(fresh) - 1
    text, line = text[fresh], line[fresh]
    order = _order(group, token)
    token, group = token[order], group[order]
    kept = np.ones(len(token), dtype=bool)
    kept[1:] = (token[1:] != token[:-1]) | (group[1:] != group[:-1])
    token, group = token[kept], group[kept]
    size = np.bincount(group, minlength=len(text))
    first = np.cumsum(size) - size
    if not len(token):
        empty = np.zeros(0, dtype=np.int64)
        return text, line, empty, empty, size, empty, empty, empty, empty
    value = token.view(np.uint64)
    h1 = np.add.reduceat(mix64(value), first).view(np.int64)
    h2 = np.add.reduceat(mix64(value ^ _SECOND_HASH), first).view(np.int64)
    # Each word flips one bit of 64, so two bitmaps differ in at most as many bits as the sets in words.
    bits = np.bitwise_xor.reduceat(np.uint64(1) << (value & np.uint64(63)), first).view(np.int64)
    # Half of the words flip their bit in a second one, which with the first tells long lines apart.
    half = (value >> np.uint64(6)) & np.uint64(1)
    more = np.bitwise_xor.reduceat(half << (value & np.uint64(63)), first).view(np.int64)
    length = np.where(size >= LEAST_SIZE, size + (-size * PERCENT // 100) + 1, 0)
    # The upper halves of the words are enough to meet; the filters and the words decide.
    prefix = (token >> 32)[np.arange(len(token)) - first[group] < length[group]]
    return text, line, h1, h2, size, bits, prefix, length, more


def _line_rows(source: DataFrame, ranks: np.ndarray) -> DataFrame:
    """Rows (id, node, line, h1, h2, size, bits, prefix) for lines with words, h1 and h2 of the set."""
    shared = source.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                text, line, h1, h2, size, bits, prefix, length, more = _line_parts(part.column("text"), shared.value)
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                columns = [
                    part.column("id").take(pa.array(text)),
                    part.column("node").take(pa.array(text)),
                    pa.array(line.astype(np.int32)),
                    pa.array(h1),
                    pa.array(h2),
                    pa.array(size.astype(np.int32)),
                    pa.array(bits),
                    pa.array(more),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(prefix.astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays(columns, [field.split()[0] for field in LINE_SCHEMA.split(", ")])

    return source.select("id", "node", "text").mapInArrow(run, LINE_SCHEMA)


def _landed(frame: DataFrame, purpose: str = "", *, folder: str | None = None) -> DataFrame:
    """A written table whose shuffle files do not stay on the disks."""
    conf = frame.sparkSession.conf
    before = conf.get(CLEAN_UP, "false")
    conf.set(CLEAN_UP, "true")
    try:
        return written(frame, purpose, folder=folder)
    finally:
        conf.set(CLEAN_UP, before)


def _meetings(rows: DataFrame, crowded: DataFrame, admitted: Column, chosen: list[Column], among: str = "true") -> DataFrame:
    """The ``chosen`` columns of pairs (l, r) of rows with one key for which ``admitted`` holds.

    ``crowded`` names keys with many rows and a number of ``blocks`` for each: one side is dealt
    to the blocks, the other goes to all of them. Only rows that fulfil ``among`` are an l.
    """
    joined = (F.col("l.key") == F.col("r.key")) & admitted
    if crowded.isEmpty():
        return rows.where(among).alias("l").join(rows.alias("r"), joined).select(*chosen)
    few = rows.join(crowded, "key", "left_anti")
    many = rows.join(crowded, "key")
    dealt = many.where(among).withColumn("block", F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int"))
    everywhere = many.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = [
        few.where(among).alias("l").join(few.alias("r"), joined),
        dealt.alias("l").join(everywhere.alias("r"), joined & (F.col("l.block") == F.col("r.block"))),
    ]
    found = [pair.select(*chosen) for pair in pairs]
    return found[0].union(found[1])


def _crowded(rows: DataFrame, most: int) -> DataFrame:
    """Keys with more than ``most`` rows and the number of blocks for them, as a written table."""
    counted = rows.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > most)
    return _landed(counted.select("key", F.ceil(F.col("rows") / most).cast("int").alias("blocks")), "crowded")


def _enough(sizes: list[Column], bitmaps: list[tuple[Column, Column]]) -> Column:
    """Whether two sets can share the words they need, by their sizes and bitmaps."""
    apart = sum((F.bit_count(left.bitwiseXOR(right)) for left, right in bitmaps), F.lit(0))
    return apart * (100 + PERCENT) <= (sizes[0] + sizes[1]) * (100 - PERCENT)


def _candidates(sets: DataFrame, frequent: int, chosen: list[Column], *carried: str) -> DataFrame:
    """The ``chosen`` columns of pairs (l, r) that prefix, length, positional and bitmap filters admit.

    A pair comes once for each word at which it meets, with its smaller set, or of two equally large the one
    with the smaller number, as l.
    """
    kept = ["number", "bits", "more", *carried]
    entries = sets.where(F.size("prefix") > 0).select("size", *kept, F.posexplode("prefix").alias("pos", "key"))
    # Size and place in one number keep the shuffled rows small.
    entries = entries.select("key", *kept, F.shiftleft(F.col("size").cast("bigint"), 32).bitwiseOR(F.col("pos")).alias("at"))
    # Nothing is null here; saying so keeps Spark from adding it on one side of the join.
    entries = entries.where(" and ".join(f"{name} is not null" for name in entries.columns)).repartition("key")
    # A word with many rows is in a bucket with many words, so only those are counted.
    rank = F.shiftright("key", 32 - BUCKET_BITS) + (1 << (BUCKET_BITS - 1))
    crowded = _crowded(entries.where(rank >= frequent), WORD_CROWD)
    sizes = [F.shiftright(f"{side}.at", 32) for side in "lr"]
    rests = [size - F.col(f"{side}.at").bitwiseAND(F.lit(0xFFFFFFFF)) for side, size in zip("lr", sizes)]
    # The first bitmap less the second is that of the other half of the words.
    bitmaps = [(F.col("l.more"), F.col("r.more")), tuple(F.col(f"{side}.bits").bitwiseXOR(F.col(f"{side}.more")) for side in "lr")]
    ordered = (sizes[0] < sizes[1]) | ((sizes[0] == sizes[1]) & (F.col("l.number") < F.col("r.number")))
    long_enough = sizes[0] * 100 >= sizes[1] * PERCENT
    admitted = long_enough & ordered & _overlap_is_enough(F.least(*rests), *sizes) & _enough(sizes, bitmaps)
    # With a larger set, a set of n words has to share 2 * PERCENT of each 100 + PERCENT, so fewer words can be missed before one is shared.
    # A condition that is not deterministic stays above the exchange, which then is one for both sides.
    among = f"monotonically_increasing_id() >= 0 = ((shiftright(at, 32) - (at & 4294967295)) * {100 + PERCENT} >= shiftright(at, 32) * {2 * PERCENT})"
    return _meetings(entries, crowded, admitted, chosen, among)


def _both_ways(pairs: DataFrame, left: list[str], right: list[str], names: list[str]) -> DataFrame:
    """Rows with ``names`` for either side of the pairs."""
    sides = [F.struct(*[F.col(column).alias(name) for column, name in zip(side, names)]) for side in (left, right)]
    return pairs.select(F.inline(F.array(*sides)))


def _candidate_pairs(sets: DataFrame, frequent: int) -> DataFrame:
    """Rows (number, nearest): every set with candidates and the smallest number of one."""
    pairs = _candidates(sets, frequent, [F.col("l.number").alias("a"), F.col("r.number").alias("b")])
    return _both_ways(pairs, ["a", "b"], ["b", "a"], ["number", "other"]).groupBy("number").agg(F.min("other").alias("nearest"))


def _homes(members: DataFrame, frequent: int) -> DataFrame:
    """Rows (key, number): every member at its home, and at the homes of its candidates with smaller numbers."""
    first = F.col("l.number") < F.col("r.number")
    met = _candidates(
        members,
        frequent,
        [F.when(first, F.col("l.home")).otherwise(F.col("r.home")).alias("key"), F.greatest("l.number", "r.number").alias("number")],
        "home",
    )
    return met.union(members.select(F.col("home").alias("key"), "number")).distinct()


def word_sets(column: pa.Array) -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
    """The distinct words of every text as sorted hashes, their number, and the lanes of their bitmap."""
    data, offsets = text_bytes(column)
    starts, ends, text = word_spans(data, offsets)
    value = word_hashes(data, starts, ends)
    order = _order(text, value.view(np.int64) ^ np.int64(-1 << 63))
    value, text = value[order], text[order]
    kept = np.ones(len(value), dtype=bool)
    kept[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[kept], text[kept]
    size = np.bincount(text, minlength=len(column))
    bounds = np.concatenate([[0], np.cumsum(size)])
    sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(value.view(np.int64)))
    # As in line_sets, each word flips one bit.
    lane, bit = (value >> np.uint64(6)) % np.uint64(LANES), np.uint64(1) << (value & np.uint64(63))
    lanes = []
    for number in range(LANES):
        flips = np.zeros(len(value) + 1, dtype=np.uint64)
        np.bitwise_xor.accumulate(np.where(lane == number, bit, np.uint64(0)), out=flips[1:])
        lanes.append((flips[bounds[1:]] ^ flips[bounds[:-1]]).view(np.int64))
    return sets, size, lanes


BITMAPS = [f"bits{number}" for number in range(LANES)]
BODY_SCHEMA = "number bigint, set array<bigint>, size bigint, " + ", ".join(f"{name} bigint" for name in BITMAPS)


def _body_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch, "body"):
            sets, size, lanes = word_sets(part.column("body"))
            columns = [part.column("number"), sets, pa.array(size.astype(np.int64)), *map(pa.array, lanes)]
            yield pa.RecordBatch.from_arrays(columns, ["number", "set", "size", *BITMAPS])


def _set_words(source: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of BODY_SCHEMA: the words of the members, read again from a document that holds them."""
    located = members.select("number", "place")
    per_document = located.groupBy(
        F.col("place.id").alias("of_id"), F.col("place.node").alias("of_node")
    ).agg(F.collect_list(F.struct(F.col("place.line").alias("line"), "number")).alias("wanted"))
    if located.count() <= BROADCAST_ROWS:
        per_document = F.broadcast(per_document)
    holders = source.join(
        per_document, (F.col("node") == F.col("of_node")) & F.col("id").eqNullSafe(F.col("of_id"))
    ).select(F.split("text", "\n").alias("parts"), "wanted")
    picked = holders.select(
        F.inline(
            F.transform(
                "wanted", lambda item: F.struct(item["number"].alias("number"), F.get("parts", item["line"]).alias("body"))
            )
        )
    )
    # A repeated row of a document gives its lines again.
    return picked.mapInArrow(_body_batches, BODY_SCHEMA).dropDuplicates(["number"])


def _links(homes: DataFrame, members: DataFrame, bodies: DataFrame) -> DataFrame:
    """Rows (number, links, earlier): sets with similar ones, the number of those and whether one has an earlier place."""
    pivots = bodies.select(F.col("number").alias("key"), F.col("set").alias("pivot"))
    own = members.select("number", "home", "place").join(bodies, "number")
    rows = homes.join(own, "number").join(pivots, "key").select(
        "key",
        "number",
        "home",
        "place",
        "size",
        *BITMAPS,
        F.size("pivot").alias("whole"),
        F.array_except("pivot", "set").alias("lacks"),
        F.array_except("set", "pivot").alias("adds"),
    )
    rows = _landed(rows, "homes")
    sizes = [F.col(f"{side}.size") for side in "lr"]
    bitmaps = [(F.col(f"l.{name}"), F.col(f"r.{name}")) for name in BITMAPS]
    # Words of the pivot that neither set lacks; those that both lack were taken off twice, and both may add the same.
    surely = F.col("l.whole") - F.size("l.lacks") - F.size("r.lacks")
    shared = surely + F.size(F.array_intersect("l.lacks", "r.lacks")) + F.size(F.array_intersect("l.adds", "r.adds"))
    similar = _overlap_is_enough(surely, *sizes) | (_enough(sizes, bitmaps) & _overlap_is_enough(shared, *sizes))
    # Candidates meet at the home of the smaller one, and there only is their pair counted.
    counted = (F.col("l.home") == F.col("l.key")) & (F.col("l.number") < F.col("r.number"))
    chosen = [F.col("l.number").alias("a"), F.col("r.number").alias("b"), (F.col("l.place") < F.col("r.place")).alias("b_later")]
    pairs = _meetings(rows, _crowded(rows, CROWD), counted & similar, chosen, "home = key")
    pairs = pairs.withColumn("a_later", ~F.col("b_later"))
    found = _both_ways(pairs, ["a", "a_later"], ["b", "b_later"], ["number", "later"])
    return found.groupBy("number").agg(F.count("*").alias("links"), F.max("later").alias("earlier"))


def similar_lines(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Line rows and, for every set, (h1, h2, place, links, earlier).

    ``source`` has id, node (a hash of the text) and text. The place of a line is (id, null ids
    last, node, line number), that of a set the smallest of its lines; ``earlier`` tells whether a similar
    set has a smaller one.
    """
    spark = source.sparkSession
    ranks, frequent = rarity(source, WORD_CROWD)
    lines = written(_line_rows(source, ranks), "lines")
    place = F.struct(F.col("id").isNull().alias("unknown"), "id", "node", "line")
    grouped = lines.groupBy("h1", "h2").agg(
        F.min(place).alias("place"),
        F.first("size").alias("size"),
        F.first("bits").alias("bits"),
        F.first("more").alias("more"),
        F.first("prefix").alias("prefix"),
    )
    sets = _landed(grouped.withColumn("number", F.monotonically_increasing_id()), "sets")
    folders = {purpose: work_dir(spark, purpose) for purpose in ("members", "bodies")}
    candidates = _candidate_pairs(sets, frequent).withColumn("home", F.least("number", "nearest"))
    members = _landed(sets.join(candidates, "number"), folder=folders["members"])
    bodies = _landed(_set_words(source, members), folder=folders["bodies"])
    links = _links(_homes(members, frequent), members, bodies)
    # By hash, as sets and lines are joined next.
    found = _landed(links.join(members.select("number", "h1", "h2"), "number").drop("number"), "links")
    for folder in folders.values():
        removed(spark, folder)
    own = sets.select("h1", "h2", "place").join(found, ["h1", "h2"], "left")
    return lines, own.select("h1", "h2", "place", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("earlier", F.lit(False)).alias("earlier"))


def removed_lines(frame: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, node, lines, links, removed): per document its lines with words and those to remove.

    ``removed`` lists the numbers, from 0, of lines that have an earlier similar line, ``links`` is
    the number of other word sets that the document's lines are linked to. Earlier means a
    smaller id (null last), then text hash, then line number; a line is judged on the input,
    whether or not the earlier one is itself removed. Blank lines have no words and always stay; a
    null, empty or blank text has no lines. Rows that repeat id and text are one document. Equal
    word sets are similar, whatever their order and repetitions.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    source = frame.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), body.alias("text"))
    source = source.select("id", F.xxhash64("text").alias("node"), "text")
    lines, sets = similar_lines(source)
    place = F.struct(F.col("id").isNull().alias("unknown"), "id", "node", "line")
    judged = lines.select("id", "node", "line", "h1", "h2").join(sets.withColumnRenamed("place", "first"), ["h1", "h2"])
    # A set, since the lines of a repeated row come again.
    line = F.struct("line", "links", (F.col("earlier") | (place > F.col("first"))).alias("gone"))
    per_document = judged.groupBy("id", "node").agg(F.sort_array(F.collect_set(line)).alias("judged"))
    return per_document.select(
        "id",
        "node",
        F.size("judged").alias("lines"),
        F.aggregate("judged", F.lit(0).cast("bigint"), lambda total, line: total + line["links"]).alias("links"),
        F.transform(F.filter("judged", lambda line: line["gone"]), lambda line: line["line"]).alias("removed"),
    )


def dedup_lines(frame: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``row``, ``id``, n_lines, n_removed, links and ``kept``, the text without removed lines."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = removed_lines(frame, doc_id=doc_id, text=text).alias("f")
    rows = frame.select(
        F.struct(*[f"`{name}`" for name in frame.columns]).alias("row"),
        F.col(f"`{doc_id}`").cast("bigint").alias("id"),
        F.xxhash64(body).alias("node"),
        body.alias("body"),
    ).alias("d")
    both = rows.join(found, (F.col("d.node") == F.col("f.node")) & F.col("d.id").eqNullSafe(F.col("f.id")), "left")
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    numbers = F.sequence(F.lit(0), F.size(F.split("body", "\n")) - 1)
    stay = F.array_except(numbers, gone)
    # The parts are the variable of a function, so that a text is cut once and not for every line.
    kept_lines = F.transform(F.array(F.split("body", "\n")), lambda parts: F.transform(stay, lambda at: F.get(parts, at)))
    kept = F.when(F.size(gone) == 0, F.col("body")).otherwise(F.array_join(F.get(kept_lines, F.lit(0)), "\n"))
    return both.select(
        "row",
        "d.id",
        F.coalesce("lines", F.lit(0)).cast("bigint").alias("n_lines"),
        F.size(gone).cast("bigint").alias("n_removed"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("links"),
        kept.alias("kept"),
    )


def op8_set_join_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat an earlier line, and the digest of the rest."""
    return dedup_lines(documents_table(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "n_lines", "n_removed", "links", F.sha2("kept", 256).alias("kept_sha256")
    )
