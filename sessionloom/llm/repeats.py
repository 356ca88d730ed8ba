"""Exact removal of long repeated byte strings with a run-length index.

Windows of 400 bytes are dealt by content: the smallest hash of the 100-byte strings in a window,
its anchor, is the same wherever the window occurs, so all occurrences of a repeated window have
one anchor. Neighbouring windows with one anchor make a segment, and only segments whose anchor
occurs twice go on. Equal segments are counted; the distinct segments of an anchor are indexed
together: a run-length Burrows-Wheeler transform with the suffix array sampled at both ends of
every run. Between samples the length of the longest match only falls by one per byte, so the
matching statistics of all segments are streamed from the samples, and windows whose match reaches
400 bytes are marked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.text import (
    BASE,
    BYTE_VALUE,
    INVERSE,
    documents_table,
    mix64,
    powers,
    steps,
    text_bytes,
    written,
)

WINDOW = 400
ANCHOR = 100
# Distinct segments of one anchor that one task indexes; larger groups are divided.
GROUP_SEGMENTS = 2_000
INDEX_BYTES = 1 << 20
INDEX_ROWS = 256
# Rows of one key that are joined in one task; the keys with more are broadcast, as many at most.
HOT_ROWS = 10_000
BROADCAST_ROWS = 100_000
SCAN_BYTES = 1 << 20
# Neighbouring windows per piece when a large group is divided, then divided again.
DIVISIONS = (16, 1)
PLACE_BITS = 24


class Hashes:
    """Rolling hashes of all substrings of a byte string."""

    def __init__(self, data: np.ndarray):
        self.total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUE[data] * powers(BASE, len(data)), out=self.total[1:])
        self.back = powers(INVERSE, len(data) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.total[ends] - self.total[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks in both directions."""
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


def segments_of(data: np.ndarray, offsets: np.ndarray):
    """Segments of a batch of texts: text, first window, windows, anchor hash, hash, anchor's place.

    Every window of every text is in exactly one segment. Long data is scanned in parts; a segment
    at the edge of two parts is then two segments with one anchor.
    """
    found = []
    for low in range(0, max(0, len(data) - WINDOW + 1), SCAN_BYTES):
        part = data[low : low + SCAN_BYTES + WINDOW - 1]
        hashes = Hashes(part)
        at = np.arange(len(part) - ANCHOR + 1)
        grams = hashes.of(at, at + ANCHOR)
        place_mask = np.uint64((1 << PLACE_BITS) - 1)
        place = (sliding_minimum((grams & ~place_mask) | at.astype(np.uint64), WINDOW - ANCHOR + 1) & place_mask).astype(np.int64)
        windows = len(part) - WINDOW + 1
        text = np.searchsorted(offsets, low + np.arange(windows), side="right") - 1
        whole = offsets[text + 1] - low - np.arange(windows) >= WINDOW
        begins = whole.copy()
        begins[1:] &= (place[1:] != place[:-1]) | ~whole[:-1]
        starts = np.flatnonzero(begins)
        stops = whole.copy()
        stops[:-1] &= (place[:-1] != place[1:]) | ~whole[1:]
        lasts = np.flatnonzero(stops)
        found.append(
            (
                text[starts],
                starts + low - offsets[text[starts]],
                lasts - starts + 1,
                grams[place[starts]].view(np.int64),
                hashes.of(starts, lasts + WINDOW).view(np.int64),
                place[starts] - starts,
            )
        )
    if not found:
        return [np.zeros(0, dtype=np.int64)] * 6
    return [np.concatenate(column) for column in zip(*found)]


SEGMENT_SCHEMA = "node bigint, size bigint, start bigint, windows int, anchor bigint, segment bigint, place int"


def _segment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in SEGMENT_SCHEMA.split(", ")]
    for batch in batches:
        for part in steps(batch, "text", SCAN_BYTES):
            data, offsets = text_bytes(part.column("text"))
            text, start, windows, anchor, segment, place = segments_of(data, offsets)
            columns = [
                part.column("node").take(pa.array(text)),
                part.column("size").take(pa.array(text)),
                pa.array(start),
                pa.array(windows.astype(np.int32)),
                pa.array(anchor),
                pa.array(segment),
                pa.array(place.astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)


class RunLengthIndex:
    """Run-length Burrows-Wheeler transform of a set of strings, sampled at the ends of its runs.

    Of the transform only its samples are kept, as many as it has runs: ``heads`` and ``tails`` are the
    text positions of the first and last suffix of every run and
    ``lengths`` the common prefix of a run's first suffix with the suffix before it, the last one of
    the previous run. A suffix that starts a string is a run of its own.
    """

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(string) for string in strings], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        self.ends = self.starts + sizes
        text = np.frombuffer(b"".join(string + b"\0" for string in strings), dtype=np.uint8)
        self.text, self.owner = text, np.repeat(np.arange(len(strings)), sizes + 1)
        order = self._suffixes(text)
        order = order[len(strings) :]  # without the suffixes that are only an end mark
        before = np.where(order == self.starts[self.owner[order]], -1, text[order - 1].astype(np.int64))
        first = np.ones(len(order), dtype=bool)
        first[1:] = (before[1:] != before[:-1]) | (before[1:] < 0)
        at = np.flatnonzero(first)
        self.heads, self.tails = order[at], order[np.append(at[1:], len(order)) - 1]
        self.lengths = np.zeros(len(at), dtype=np.int64)
        self.lengths[1:] = self._common(self.tails[:-1], self.heads[1:])

    def _suffixes(self, text: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling; each round sorts only suffixes that are still tied."""
        count, total = len(self.starts), len(text)
        symbol = text.astype(np.int64) + count
        symbol[self.ends] = np.arange(count)
        width = int(count + 256).bit_length()
        depth = max(1, 62 // width)
        key = np.zeros(total, dtype=np.int64)
        padded = np.concatenate([symbol, np.zeros(depth, dtype=np.int64)])
        for at in range(depth):
            key = (key << width) | padded[at : at + total]
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        group = np.maximum.accumulate(np.where(fresh, np.arange(total), 0))
        rank = np.empty(total, dtype=np.int64)
        rank[order] = group
        while True:
            tied = ~fresh
            tied[:-1] |= ~fresh[1:]
            places = np.flatnonzero(tied)
            if not len(places):
                return order
            members = order[places]
            follow = rank[np.minimum(members + depth, total - 1)]
            key = (rank[members] << 31) | follow
            inner = np.argsort(key, kind="stable")
            members, key = members[inner], key[inner]
            order[places] = members
            new = np.concatenate([[True], key[1:] != key[:-1]])
            fresh[places] = new
            rank[members] = np.maximum.accumulate(np.where(new, places, 0))
            depth *= 2

    def _common(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Common prefix lengths of suffix pairs, compared eight bytes at a time."""
        limit = np.minimum(self.ends[self.owner[left]] - left, self.ends[self.owner[right]] - right)
        padded = np.concatenate([self.text, np.zeros(16, dtype=np.uint8)])
        word = np.zeros(len(self.text) + 8, dtype=np.uint64)
        for at in range(8):
            word |= padded[at : at + len(word)].astype(np.uint64) << np.uint64(8 * at)
        length = np.zeros(len(left), dtype=np.int64)
        open_at = np.arange(len(left))
        while len(open_at):
            a, b = left[open_at] + length[open_at], right[open_at] + length[open_at]
            apart = word[a] ^ word[b]
            lowest = apart & (~apart + np.uint64(1))
            equal = np.where(apart == 0, 8, np.log2(np.maximum(lowest, 1).astype(np.float64)).astype(np.int64) // 8)
            length[open_at] += equal
            open_at = open_at[(apart == 0) & (length[open_at] < limit[open_at])]
        return np.minimum(length, limit)

    def matching_statistics(self) -> np.ndarray:
        """Length of the longest match of every suffix with another one, streamed from the samples.

        Along the text the match with the neighbour on one side of the suffix array shrinks by one
        per byte until the next sample of that side.
        """
        best = np.zeros(len(self.text), dtype=np.int64)
        after = np.append(self.lengths[1:], 0)
        for places, lengths in ((self.heads, self.lengths), (self.tails, after)):
            reach = np.full(len(self.text), -1, dtype=np.int64)
            reach[places] = places + lengths
            sampled = np.maximum.accumulate(np.where(reach >= 0, np.arange(len(reach)), -1))
            known = sampled >= 0
            known[known] &= self.owner[sampled[known]] == self.owner[np.flatnonzero(known)]
            at = np.flatnonzero(known)
            best[at] = np.maximum(best[at], reach[sampled[at]] - at)
        return best


def long_matches(strings: list[bytes], least: int) -> list[tuple[int, int, int]]:
    """Maximal stretches (string, start, end) covered by matches of ``least`` bytes with another place."""
    index = RunLengthIndex(strings)
    starts = np.flatnonzero(index.matching_statistics() >= least)
    if not len(starts):
        return []
    breaks = np.flatnonzero((np.diff(starts) > least) | (np.diff(index.owner[starts]) != 0))
    first = starts[np.concatenate([[0], breaks + 1])]
    last = starts[np.concatenate([breaks, [len(starts) - 1]])] + least
    owner = index.owner[first]
    return list(zip(owner.tolist(), (first - index.starts[owner]).tolist(), (last - index.starts[owner]).tolist()))


MARK_SCHEMA = "anchor bigint, segment bigint, low bigint, high bigint"


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Indexes whole groups of pieces, some at a time, from rows sorted by group."""
    rows: list[tuple] = []
    held, group = 0, None

    def marks():
        found = long_matches([row[4] for row in rows], WINDOW)
        columns = [[rows[at][1], rows[at][2], rows[at][3] + low, rows[at][3] + high] for at, low, high in found]
        arrays = [pa.array(list(column), pa.int64()) for column in (zip(*columns) if columns else [[]] * 4)]
        return pa.RecordBatch.from_arrays(arrays, ["anchor", "segment", "low", "high"])

    names = ("grouping", "anchor", "segment", "low", "bytes")
    for batch in batches:
        for start in range(0, batch.num_rows, INDEX_ROWS):
            part = batch.slice(start, INDEX_ROWS)
            for row in zip(*[part.column(name).to_pylist() for name in names]):
                if row[0] != group:
                    if held >= INDEX_BYTES:
                        yield marks()
                        rows, held = [], 0
                    group = row[0]
                elif rows and rows[-1][:4] == row[:4]:
                    continue  # the same piece from a repeated row
                rows.append(row)
                held += len(row[4])
    if rows:
        yield marks()


PIECE_SCHEMA = "grouping bigint, anchor bigint, segment bigint, low bigint, content bigint, place int, bytes binary"


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted segments of each text."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        out = [[] for _ in range(5)]
        for at, wanted in enumerate(batch.column("wanted").to_pylist()):
            for item in wanted:
                low = int(offsets[at]) + item["start"]
                out[0].append(item["anchor"])
                out[1].append(item["segment"])
                out[2].append(item["place"])
                out[3].append(data[low : low + item["windows"] + WINDOW - 1].tobytes())
        count = len(out[0])
        arrays = [
            pa.array(out[0], pa.int64()),
            pa.array(out[0], pa.int64()),
            pa.array(out[1], pa.int64()),
            pa.array(np.zeros(count, dtype=np.int64)),
            pa.array(out[1], pa.int64()),
            pa.array(out[2], pa.int32()),
            pa.array(out[3], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["grouping", "anchor", "segment", "low", "content", "place", "bytes"])


def _divider(span: int):
    """Divides pieces into runs of ``span`` windows at fixed places around the anchor.

    Equal windows are at equal places, and all windows of a run share its core; place and core are
    the new group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(7)]
            rows = zip(*[batch.column(name).to_pylist() for name in batch.schema.names])
            for grouping, anchor, segment, low, _, place, body in rows:
                hashes = Hashes(np.frombuffer(body, dtype=np.uint8))
                windows, at = len(body) - WINDOW + 1, 0
                while at < windows:
                    # Windows at place p (of the anchor in the window) downwards to a multiple of span.
                    number, inside = divmod(place - at, span)
                    stop = min(windows, at + inside + 1)
                    core = (at + inside, at + inside - span + 1 + WINDOW)
                    ends = np.array([core[1], stop - 1 + WINDOW]), np.array([core[0], at])
                    core_hash, content = hashes.of(ends[1], ends[0]).view(np.int64)
                    mixed = mix64(np.array([grouping ^ core_hash], dtype=np.int64).view(np.uint64) + np.uint64(number))
                    values = (int(mixed.view(np.int64)[0]), anchor, segment, low + at, int(content), place - at)
                    for column, value in zip(out, (*values, body[at : stop - 1 + WINDOW])):
                        column.append(value)
                    at = stop
            types = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], batch.schema.names)

    return run


def _joined(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """Rows joined with ``keys``, which has the key, its number of ``rows`` and more.

    Keys with many rows are broadcast, so their rows stay where they are: those with more than
    ``HOT_ROWS`` rows, or with more than the hundred-thousandth part of the ``total``, which bounds their number.
    """
    least = max(HOT_ROWS, total // BROADCAST_ROWS)
    hot = written(keys.where(F.col("rows") > least).drop("rows"), "hot-keys")
    others = keys.where(F.col("rows") <= least).drop("rows")
    cold = rows.join(F.broadcast(hot.select(*on).distinct()), on, "left_anti").join(others, on)
    return rows.join(F.broadcast(hot), on).unionByName(cold)


def _indexed(pieces: DataFrame) -> DataFrame:
    """Marks from groups of pieces, each group indexed in one task."""
    return (
        pieces.select("grouping", "anchor", "segment", "low", "bytes")
        .repartition("grouping")
        .sortWithinPartitions("grouping", "anchor", "segment", "low")
        .mapInArrow(_index_batches, MARK_SCHEMA)
    )


def _segment_marks(pieces: DataFrame, group_segments: int) -> DataFrame:
    """Marks (anchor, segment, low, high) within distinct segments from matches between them.

    Groups of at most ``group_segments`` are indexed. Pieces of larger groups are divided into runs
    of a few windows, grouped by place and core, then again into single windows; equal pieces are
    marked as wholes and one of them goes on. At single windows every group holds one string.
    """
    marks = []
    for span in (*DIVISIONS, None):
        sizes = pieces.groupBy("grouping").agg(F.count("*").alias("members"))
        limited = pieces.join(sizes.where((F.col("members") > 1) & (F.col("members") <= group_segments)), "grouping")
        marks.append(_indexed(limited))
        large = sizes.where(F.col("members") > group_segments)
        if span is None or large.isEmpty():
            break
        whole = pieces.join(large.select("grouping"), "grouping").dropDuplicates(["grouping", "anchor", "segment", "low"])
        cut = written(whole.select(*pieces.columns).mapInArrow(_divider(span), PIECE_SCHEMA), "pieces")
        copies = cut.groupBy("grouping", "content").agg(F.count("*").alias("copies")).where("copies > 1")
        marks.append(
            cut.join(copies, ["grouping", "content"]).select(
                "anchor", "segment", "low", (F.col("low") + F.octet_length("bytes")).alias("high")
            )
        )
        pieces = written(cut.dropDuplicates(["grouping", "content"]), "pieces")
    out = marks[0]
    for more in marks[1:]:
        out = out.union(more)
    return out


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = []
        for marks in batch.column("marks").to_pylist():
            merged: list[list[int]] = []
            for low, high in sorted((mark["low"], mark["high"]) for mark in marks):
                if merged and low <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], high)
                else:
                    merged.append([low, high])
            spans.append([{"low": low, "high": high} for low, high in merged])
        kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), batch.column("size"), pa.array(spans, kind)], ["node", "size", "spans"]
        )


def repeated_spans(source: DataFrame, group_segments: int = GROUP_SEGMENTS) -> DataFrame:
    """Rows (node, size, spans) for texts with repeated windows; ``source`` has id, node, size, text."""
    segments = written(source.select("node", "size", "text").mapInArrow(_segment_batches, SEGMENT_SCHEMA), "segments")
    anchors = (
        segments.groupBy("anchor")
        .agg(F.count("*").alias("found"), F.min("segment").alias("first"), F.max("segment").alias("last"))
        .where("found > 1")
        .select("anchor", (F.col("first") == F.col("last")).alias("same"), F.col("found").alias("rows"))
    )
    total = segments.count()
    repeated = written(_joined(segments, written(anchors, "anchors"), ["anchor"], total), "repeated")
    mixed = repeated.where("not same")
    end = F.col("windows") + (WINDOW - 1)
    distinct = written(
        mixed.groupBy("anchor", "segment").agg(
            F.count("*").alias("copies"),
            F.min("node").alias("node"),
            F.min_by("start", "node").alias("start"),
            F.min_by("size", "node").alias("size"),
            F.min("windows").alias("windows"),
            F.min("place").alias("place"),
        ),
        "distinct",
    )
    wanted = distinct.groupBy("node", "size").agg(
        F.collect_list(F.struct("anchor", "segment", "start", "windows", "place")).alias("wanted")
    )
    # One row of equal texts gives the bytes: that with the smallest id.
    chosen = source.groupBy("node", "size").agg(F.min("id").alias("chosen")).join(wanted, ["node", "size"])
    match = ["node", "size"]
    texts = source.alias("d").join(
        chosen.alias("c"),
        (F.col("d.node") == F.col("c.node")) & (F.col("d.size") == F.col("c.size")) & F.col("d.id").eqNullSafe(F.col("c.chosen")),
    )
    pieces = written(texts.select("d.text", "c.wanted").mapInArrow(_cut_batches, PIECE_SCHEMA), "pieces")
    copied = distinct.where("copies > 1").select(
        "anchor", "segment", F.lit(0).cast("bigint").alias("low"), end.cast("bigint").alias("high")
    )
    inner = written(copied.union(_segment_marks(pieces, group_segments)).distinct(), "marks")
    # A segment has few marks, so what is broadcast is bounded by the number of segments with many copies.
    counted = inner.join(distinct.select("anchor", "segment", F.col("copies").alias("rows")), ["anchor", "segment"])
    places = written(mixed.select("anchor", "segment", "node", "size", "start").distinct(), "places")
    placed = _joined(places, counted, ["anchor", "segment"], total)
    marks = (
        repeated.where("same")
        .select("node", "size", F.col("start").alias("low"), (F.col("start") + end).alias("high"))
        .union(placed.select("node", "size", F.col("start") + F.col("low"), F.col("start") + F.col("high")))
        .distinct()
    )
    gathered = marks.groupBy(*match).agg(F.collect_list(F.struct("low", "high")).alias("marks"))
    return gathered.mapInArrow(
        _merge_batches, "node bigint, size bigint, spans array<struct<low: bigint, high: bigint>>"
    )


def remove_repeats(
    frame: DataFrame, *, doc_id: str = "doc_id", text: str = "text", group_segments: int = GROUP_SEGMENTS
) -> DataFrame:
    """Remove every byte covered by a 400-byte string that also starts anywhere else.

    Returns one row per input row: ``row`` (its columns), ``id``, ``n_bytes``, ``spans`` (removed
    stretches, neither touching nor overlapping), ``n_removed`` and ``kept``, the remaining UTF-8
    bytes. Matches lie within one text, overlap or not, or in two rows, never across rows; they are
    judged on the input. Texts shorter than 400 bytes, also null and empty ones (n_bytes 0), lose
    nothing. Repeated rows are occurrences of each other. Ids may be null or repeated. Texts are
    identified by a 64-bit hash and their size.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    source = frame.select(
        F.struct(*[f"`{name}`" for name in frame.columns]).alias("row"),
        F.col(f"`{doc_id}`").cast("bigint").alias("id"),
        F.xxhash64(body).alias("node"),
        F.octet_length(body).cast("bigint").alias("size"),
        body.alias("text"),
    )
    spans = repeated_spans(source.select("id", "node", "size", "text").where(F.col("size") >= WINDOW), group_segments)
    joined = source.join(spans, ["node", "size"], "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast("array<struct<low: bigint, high: bigint>>"))
    )
    # Kept stretches lie before the first span, between two, and after the last; as raw bytes.
    raw = F.col("text").cast("binary")
    piece = lambda at: F.substring(
        raw,
        (F.coalesce(F.get("spans", at - 1)["high"], F.lit(0)) + 1).cast("int"),
        (F.coalesce(F.get("spans", at)["low"], F.col("size")) - F.coalesce(F.get("spans", at - 1)["high"], F.lit(0))).cast("int"),
    ).cast("string")
    kept = F.when(F.size("spans") == 0, F.col("text")).otherwise(
        F.array_join(F.transform(F.sequence(F.lit(0), F.size("spans")), piece), "")
    )
    removed = F.aggregate(
        "spans", F.lit(0).cast("bigint"), lambda total, span: total + span["high"] - span["low"]
    )
    return joined.select(
        "row", "id", F.col("size").alias("n_bytes"), "spans", removed.alias("n_removed"), kept.cast("binary").alias("kept")
    )


def op2_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document inside repeated 400-byte strings, and the digest of the rest."""
    return remove_repeats(documents_table(spark, sf_dir)).select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        "n_removed",
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
