"""Shards of near-equal bytes by histogram sort.

Rows are ordered by a 128-bit key: a hash of the text, then a hash of the row. The order is cut
into shards at boundaries found by counting alone: each round counts, over all partitions, the
exact bytes below candidate boundaries, and refines the candidates around every wanted cut until
the cut is within tolerance or its interval is one key. Only then are rows exchanged, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.llm.text import documents_table, written

SHARDS = 40
ROW_OVERHEAD = 16
TOLERANCE = 0.001
PROBE_BITS = 10
PIECE_BYTES = 64 << 20
MAX_OFFSETS = 1_000_000
KEY_BITS = 128
_HASHED = ("string", "binary", "boolean", "date", "timestamp", "timestamp_ntz")
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def row_keys(frame: DataFrame, text: str) -> tuple[Column, Column]:
    """Hash of the text, and hash of the row's other plain columns."""
    others = [
        F.col(f"`{name}`")
        for name, kind in frame.dtypes
        if name != text and (kind in _HASHED or kind.startswith(_NUMBERS))
    ]
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return F.xxhash64(content), F.xxhash64(*others, F.length(content))


def _prefix(high: Column, low: Column, bits: int) -> tuple[Column, Column]:
    """The first ``bits`` bits of a key as two columns."""
    first = F.lit(0).cast("bigint") if bits == 0 else F.shiftrightunsigned(high, max(0, 64 - bits))
    return first, F.lit(0).cast("bigint") if bits <= 64 else F.shiftrightunsigned(low, KEY_BITS - bits)


def _as_number(first: int, second: int, bits: int) -> int:
    """The smallest key with this prefix, as an unsigned number."""
    mask = (1 << 64) - 1
    if bits <= 64:
        return (first & mask) << (KEY_BITS - bits)
    return ((first & mask) << 64) | (second & mask) << (KEY_BITS - bits)


def _as_prefix(number: int, bits: int) -> tuple[int, int]:
    signed = lambda value: value - (1 << 64) if value >= 1 << 63 else value
    if bits <= 64:
        return signed(number >> (KEY_BITS - bits)), 0
    return signed(number >> 64), signed((number & ((1 << 64) - 1)) >> (KEY_BITS - bits))


def find_cuts(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """Boundaries that split ``keys`` (_k1, _k2, _size) into ``shards`` parts of near-equal bytes.

    A row belongs to the part whose number is the count of boundaries at or below its key. Each
    round brings at most ``(shards - 1) * 2**PROBE_BITS`` counts to the driver.
    """
    total = keys.agg(F.sum("_size")).first()[0] or 0
    targets = [total * at / shards for at in range(1, shards)]
    cuts: dict[int, int] = {}
    # Open intervals: (first key, bytes below it) -> the wanted cuts that fall into it.
    open_at = {(0, 0): list(range(len(targets)))} if total else {}
    bits = 0
    while open_at:
        deeper = min(bits + PROBE_BITS, KEY_BITS)
        now, then = _prefix(F.col("_k1"), F.col("_k2"), bits), _prefix(F.col("_k1"), F.col("_k2"), deeper)
        wanted = [_as_prefix(start, bits) for start, _ in open_at]
        inside = keys
        if bits:
            inside = keys.where(now[0].isin([first for first, _ in wanted]))
        if bits > 64:
            inside = inside.where(now[1].isin([second for _, second in wanted]))
        counted = inside.groupBy(then[0].alias("a"), then[1].alias("b")).agg(
            F.sum("_size").alias("size"), F.count("*").alias("rows")
        ).collect()
        sizes = sorted((_as_number(row.a, row.b, deeper), row.size, row.rows) for row in counted)
        width = 1 << (KEY_BITS - deeper)
        span = 1 << (KEY_BITS - bits)
        following: dict[tuple[int, int], list[int]] = {}
        for (start, below), members in open_at.items():
            own = [(key, size, rows) for key, size, rows in sizes if start <= key < start + span]
            for cut in members:
                reached = below
                for key, size, rows in own:
                    if reached + size >= targets[cut]:
                        break
                    reached += size
                if size <= tolerance * total / shards or rows == 1 or deeper == KEY_BITS:
                    near_start = targets[cut] - reached <= reached + size - targets[cut]
                    cuts[cut] = key if near_start else key + width
                else:
                    following.setdefault((key, reached), []).append(cut)
        open_at, bits = following, deeper
    return [cuts[at] for at in sorted(cuts)]


def _part(high: Column, low: Column, cuts: list[int], base: int = 0) -> Column:
    """Number of cuts at or below a key: a balanced tree of comparisons."""
    if not cuts:
        return F.lit(base)
    middle = len(cuts) // 2
    if cuts[middle] >= 1 << KEY_BITS:
        return _part(high, low, cuts[:middle], base)
    # Signed columns compare like unsigned numbers once the first bit is flipped.
    flip = -(1 << 63)
    signed = lambda value: value - (1 << 63)
    first, second = signed(cuts[middle] >> 64), signed(cuts[middle] & ((1 << 64) - 1))
    high_order, low_order = high.bitwiseXOR(F.lit(flip)), low.bitwiseXOR(F.lit(flip))
    above = (high_order > first) | ((high_order == first) & (low_order >= second))
    return F.when(above, _part(high, low, cuts[middle + 1 :], base + middle + 1)).otherwise(
        _part(high, low, cuts[:middle], base)
    )


def shard_by_bytes(
    frame: DataFrame,
    shards: int = SHARDS,
    *,
    text: str = "text",
    tolerance: float = TOLERANCE,
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """Add ``size`` (bytes of the text plus 16), ``shard`` and ``slot`` to every row.

    Shards differ from the mean by at most ``tolerance`` of it and one row. Equal texts are
    neighbours in the order, so they share a shard unless a cut falls into the group; then the
    hash of their other columns divides them, however large the group is. Slots number the rows of
    a shard from 0 without gaps. A null text has 16 bytes. Rows that are equal in every plain
    column cannot be told apart: they keep the same shard and take neighbouring slots. An empty
    table stays empty. Columns of the input named size, shard or slot are replaced; other columns
    are kept as they are.
    """
    high, low = row_keys(frame, text)
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("bigint") + ROW_OVERHEAD
    keyed = high.alias("_k1"), low.alias("_k2"), size.alias("_size")
    keys = written(frame.select(*keyed), "shard-keys")
    cuts = find_cuts(keys, shards, tolerance)
    total = keys.agg(F.sum("_size")).first()[0] or 0
    # Pieces of a shard bound what one task numbers; the row hash deals them evenly.
    pieces = max(1, -(-total // (shards * piece_bytes)))
    shard, piece = _part(F.col("_k1"), F.col("_k2"), cuts), F.pmod("_k2", F.lit(pieces))
    counts = keys.groupBy(shard.alias("_shard"), piece.alias("_piece")).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("_shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_shard", "_piece", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    if shards * pieces <= MAX_OFFSETS:
        offsets = F.broadcast(offsets)
    kept = [name for name in frame.columns if name not in ("size", "shard", "slot")]
    # The columns travel as one, so that no name of theirs can clash.
    rows = (
        frame.select(F.struct(*[f"`{name}`" for name in kept]).alias("_row"), *keyed)
        .withColumns({"_shard": shard, "_piece": piece})
        .join(offsets, ["_shard", "_piece"])
    )
    ordered = Window.partitionBy("_shard", "_piece").orderBy("_k1", "_k2")
    return rows.select(
        "_row.*",
        F.col("_size").alias("size"),
        F.col("_shard").alias("shard"),
        (F.col("_offset") + F.row_number().over(ordered) - 1).alias("slot"),
    )


def op10_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, with the checksum of its text."""
    sharded = shard_by_bytes(documents_table(spark, sf_dir))
    return sharded.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
