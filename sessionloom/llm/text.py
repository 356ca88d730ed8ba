"""What the corpus operators share: words, content keys, written tables.

A word is a maximal run of characters other than the six ASCII white-space characters. A null
text has no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.session import work_dir

WORD = r"[^\x20\x09-\x0D]+"
SHINGLE_WORDS = 5
NEAR = 0.8

# Bytes of text that one vectorised step handles at a time; a longer text is a step of its own.
STEP_BYTES = 2 << 20


def words(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def shingles(of_words: Column) -> Column:
    """Distinct runs of five words, joined by blanks; a shorter text is one run of all its words."""
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(of_words) - (SHINGLE_WORDS - 1), F.lit(1))),
        lambda at: F.array_join(F.slice(of_words, at, SHINGLE_WORDS), " "),
    )
    return F.when(F.size(of_words) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def content_key(text: Column) -> Column:
    """128 bits of the text's SHA-256; a null text counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def written(frame: DataFrame, purpose: str, *, folder: str | None = None) -> DataFrame:
    """Cut the lineage: write the frame to the session's shared folder and read it back."""
    path = folder or work_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete the folder of a written table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mix64(value: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


# A random 64-bit value for each byte, and an odd base for rolling hashes.
BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    if count:
        out[0] = 1
    return np.multiply.accumulate(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a batch of texts and the offsets at which each text starts; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES):
    """Slices of a batch whose texts have at most ``limit`` bytes together, or one text each."""
    sizes = np.diff(text_bytes(batch.column(column))[1])
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if at > start and held + size > limit:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += int(size)
    if len(sizes) > start:
        yield batch.slice(start)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE):
    """First byte, end and text number of every word in a batch of texts."""
    inside = ~space[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


_KEPT: dict[int, np.ndarray] = {}


def _kept_powers(base: int, count: int) -> np.ndarray:
    """``powers`` for a step; those of a longer text are not kept."""
    if count > STEP_BYTES + 1:
        return powers(base, count)
    if len(_KEPT.get(base, ())) < count:
        _KEPT[base] = powers(base, STEP_BYTES + 1)
    return _KEPT[base][:count]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, from one rolling sum over the bytes."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[data] * _kept_powers(BASE, len(data)), out=total[1:])
    back = _kept_powers(INVERSE, len(data) + 1)
    return mix64((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, owner: np.ndarray, count: int, width: int = SHINGLE_WORDS):
    """Hashes of runs of ``width`` words and the text of each run.

    A text of fewer words has one run of all its words.
    """
    per_text = np.bincount(owner, minlength=count)
    first = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    if len(hashes) >= width:
        windows = len(hashes) - width + 1
        runs = np.zeros(windows, dtype=np.uint64)
        for at in range(width):
            runs = runs * np.uint64(BASE) + hashes[at : at + windows]
        whole = owner[:windows] == owner[width - 1 :]
        runs, of = mix64(runs[whole]), owner[:windows][whole]
    else:
        runs, of = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=owner.dtype)
    short = np.flatnonzero((per_text > 0) & (per_text < width))
    if len(short):
        extra = []
        for text in short:
            value = 0
            for word in hashes[first[text] : first[text] + per_text[text]]:
                value = (value * BASE + int(word) + 1) & 0xFFFFFFFFFFFFFFFF
            extra.append(value)
        runs = np.concatenate([runs, mix64(np.array(extra, dtype=np.uint64))])
        of = np.concatenate([of, short.astype(of.dtype)])
        order = np.argsort(of, kind="stable")
        runs, of = runs[order], of[order]
    return runs, of
