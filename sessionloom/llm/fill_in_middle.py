"""Fill-in-middle transformation by a displacement scatter.

A text is cut into prefix, middle and suffix and written as ``<P>``prefix``<S>``suffix``<M>``middle
(psm) or ``<S>``suffix``<P>``prefix``<M>``middle (spm). For a batch of texts the places of the cuts
are scanned from the UTF-8 bytes; every part then moves by one displacement, so a difference array
with an entry at the start and end of each part, summed up, holds the shift of every byte, and one
scatter builds all outputs. The way back finds the marks in the output and gathers the bytes by the
inverse shifts. Bytes are moved in steps of fixed size, so a very long text needs no more index
memory than a short one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.text import documents_table, steps, text_bytes

# The marks before the three parts, the draw's prefix and the shares in percent.
MARKS = ("<P>", "<S>", "<M>")
DRAW_PREFIX = "1:"
TRANSFORMED_PERCENT = 90
SPM_PERCENT = 20
# Bytes moved at a time.
MOVE_BYTES = 1 << 20

_MARK = len(MARKS[0])
_MARK_BYTES = {mark[1]: np.frombuffer(mark.encode(), dtype=np.uint8) for mark in MARKS}
# The order of the parts, named by their marks, in each form.
ORDER = {"psm": "PSM", "spm": "SPM"}


def _shifts(starts: np.ndarray, values: np.ndarray, low: int, high: int) -> np.ndarray:
    """Shift of every place in [low, high): the difference array of the parts, summed up.

    Part i begins at ``starts[i]`` (ascending) and moves by ``values[i]``; of several parts with
    one start only the last one can hold places.
    """
    first, last = np.searchsorted(starts, [low, high], side="left")
    carried = values[first - 1] if first else 0
    steps_ = np.diff(values[first:last], prepend=carried)
    difference = np.zeros(high - low, dtype=np.int64)
    np.add.at(difference, starts[first:last] - low, steps_)
    return np.cumsum(difference) + carried


def _move(data: np.ndarray, starts: np.ndarray, values: np.ndarray, out: np.ndarray) -> None:
    """Scatter every byte to its place plus the shift of its part."""
    for low in range(0, len(data), MOVE_BYTES):
        high = min(len(data), low + MOVE_BYTES)
        out[np.arange(low, high) + _shifts(starts, values, low, high)] = data[low:high]


def _fetch(data: np.ndarray, starts: np.ndarray, values: np.ndarray, out: np.ndarray) -> None:
    """Gather every byte of ``out`` from its place plus the shift of its part."""
    for low in range(0, len(out), MOVE_BYTES):
        high = min(len(out), low + MOVE_BYTES)
        out[low:high] = data[np.arange(low, high) + _shifts(starts, values, low, high)]


def code_point_places(data: np.ndarray, offsets: np.ndarray, text: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Byte place of code point ``number`` of each given text; the number of code points means its end."""
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(begins, offsets[text], side="left")
    return np.append(begins, len(data))[first + number]


def scatter_parts(data: np.ndarray, offsets: np.ndarray, form: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Outputs of a batch of texts and their offsets.

    ``form`` holds plain, psm or spm, ``low`` and ``high`` the code points before which middle and
    suffix begin; a plain text is moved as one part.
    """
    count = len(form)
    every = np.arange(count)
    cut = form != "plain"
    middle, suffix = offsets[1:].copy(), offsets[1:].copy()
    middle[cut] = code_point_places(data, offsets, every[cut], low[cut])
    suffix[cut] = code_point_places(data, offsets, every[cut], high[cut])
    begins = np.stack([offsets[:-1], middle, suffix], axis=1)  # starts of P, M, S in the text
    sizes = np.diff(np.concatenate([begins, offsets[1:, None]], axis=1), axis=1)
    size_of = dict(zip("PMS", sizes.T))
    out_offsets = np.concatenate([[0], np.cumsum(sizes.sum(axis=1) + cut * 3 * _MARK)])
    out = np.empty(out_offsets[-1], dtype=np.uint8)
    targets = {part: out_offsets[:-1].copy() for part in "PMS"}
    for name, order in ORDER.items():
        chosen = np.flatnonzero(form == name)
        at = out_offsets[:-1][chosen]
        for part in order:
            for byte in range(_MARK):
                out[at + byte] = _MARK_BYTES[part][byte]
            targets[part][chosen] = at + _MARK
            at = at + _MARK + size_of[part][chosen]
    targets["M"][~cut] += sizes[~cut, 0]
    targets["S"][~cut] += sizes[~cut, 0]
    placed = np.stack([targets[part] for part in "PMS"], axis=1)
    _move(data, begins.ravel(), (placed - begins).ravel(), out)
    return out, out_offsets


def gather_parts(data: np.ndarray, offsets: np.ndarray, form: np.ndarray):
    """The texts that outputs were built from, and their offsets; cuts are found from the marks.

    A text with a mark of its own stays plain, and no mark can arise where a part meets a mark, so
    every other output holds each mark once.
    """
    count = len(form)
    places = {}
    for part, mark in _MARK_BYTES.items():
        hit = np.ones(max(0, len(data) - _MARK + 1), dtype=bool)
        for byte in range(_MARK):
            hit &= data[byte : byte + len(hit)] == mark[byte]
        found = np.flatnonzero(hit)
        owner = np.searchsorted(offsets, found, side="right") - 1
        inside = found + _MARK <= offsets[owner + 1]
        places[part] = np.zeros(count, dtype=np.int64)
        places[part][owner[inside]] = found[inside]
    sources = {part: offsets[:-1].copy() for part in "PMS"}
    sizes = {part: np.zeros(count, dtype=np.int64) for part in "PMS"}
    sizes["P"] = np.diff(offsets)
    for name, order in ORDER.items():
        chosen = np.flatnonzero(form == name)
        ends = [places[part][chosen] for part in order[1:]] + [offsets[1:][chosen]]
        for part, end in zip(order, ends):
            sources[part][chosen] = places[part][chosen] + _MARK
            sizes[part][chosen] = end - places[part][chosen] - _MARK
    per_text = np.stack([sizes[part] for part in "PMS"], axis=1)
    out_offsets = np.concatenate([[0], np.cumsum(per_text.sum(axis=1))])
    begins = out_offsets[:-1, None] + np.concatenate(
        [np.zeros((count, 1), dtype=np.int64), np.cumsum(per_text, axis=1)[:, :-1]], axis=1
    )
    out = np.empty(out_offsets[-1], dtype=np.uint8)
    wanted = np.stack([sources[part] for part in "PMS"], axis=1)
    _fetch(data, begins.ravel(), (wanted - begins).ravel(), out)
    return out, out_offsets


def _text_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, buffers).cast(pa.string())


def _forms(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype="U5")


def _replaced(part: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
    columns = [texts if name == "body" else part.column(name) for name in part.schema.names]
    return pa.RecordBatch.from_arrays(columns, part.schema.names)


def _scatter_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch, "body"):
            data, offsets = text_bytes(part.column("body"))
            low, high = (part.column(name).fill_null(0).to_numpy() for name in ("low", "high"))
            yield _replaced(part, _text_array(*scatter_parts(data, offsets, _forms(part.column("form")), low, high)))


def _gather_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch, "body"):
            data, offsets = text_bytes(part.column("body"))
            yield _replaced(part, _text_array(*gather_parts(data, offsets, _forms(part.column("form")))))


def _draw(doc_id: Column, group: int) -> Column:
    """One of the four 32-bit numbers drawn for an id."""
    digest = F.sha2(F.concat(F.lit(DRAW_PREFIX), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 1 + 8 * group, 8), 16, 10).cast("bigint")


def cut_columns(doc_id: Column, body: Column) -> dict[str, Column]:
    """Code points ``n``, the cuts ``low`` and ``high`` (code points) and the ``form``."""
    n = F.length(body).cast("bigint")
    one, two = (_draw(doc_id, group) % (n + 1) for group in (0, 1))
    plain = (n == 0) | (_draw(doc_id, 2) % 100 >= TRANSFORMED_PERCENT)
    for mark in MARKS:
        plain = plain | body.contains(mark)
    form = F.when(plain, "plain").when(_draw(doc_id, 3) % 100 < SPM_PERCENT, "spm").otherwise("psm")
    return {"n": n, "low": F.least(one, two), "high": F.greatest(one, two), "form": form}


def fill_in_middle(frame: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (row, id, n, form, prefix_chars, middle_chars, output), one per input row.

    ``row`` holds the input's columns, so their names cannot clash. Cuts and form are drawn from
    the id alone (a null id draws as an empty one), so repeated rows give the same output. A null
    or empty text, one that contains a mark and a tenth of all others stay plain: the output is
    the text, the numbers of characters are null. Cuts may be equal, which leaves parts empty.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = frame.select(
        F.struct(*[f"`{name}`" for name in frame.columns]).alias("row"),
        F.col(f"`{doc_id}`").cast("bigint").alias("id"),
        body.alias("body"),
    )
    cuts = rows.select("row", "id", *[value.alias(name) for name, value in cut_columns(F.col("id"), F.col("body")).items()], "body")
    moved = cuts.mapInArrow(_scatter_batches, cuts.schema)
    whole = F.col("form") == "plain"
    return moved.select(
        "row",
        "id",
        "n",
        "form",
        F.when(~whole, F.col("low")).alias("prefix_chars"),
        F.when(~whole, F.col("high") - F.col("low")).alias("middle_chars"),
        F.col("body").alias("output"),
    )


def restore_texts(transformed: DataFrame) -> DataFrame:
    """Add ``restored``: the text rebuilt from ``output`` and ``form`` alone."""
    both = transformed.withColumn("body", F.col("output"))
    return both.mapInArrow(_gather_batches, both.schema).withColumnRenamed("body", "restored")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as its fill-in-middle output, and the text restored from it, as digests."""
    documents = documents_table(spark, sf_dir).select("doc_id", "text")
    slim = fill_in_middle(documents).drop("row")
    return restore_texts(slim).select(
        F.col("id").alias("doc_id"),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


FILL_IN_MIDDLE_SQL = f"""
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS body, length(coalesce(text, '')) AS n,
           sha256('{DRAW_PREFIX}' || coalesce(doc_id::VARCHAR, '')) AS digest
    FROM documents
), numbered AS (
    SELECT *, [('0x' || substr(digest, 1 + 8 * i, 8))::BIGINT for i in range(4)] AS h FROM drawn
), cut AS (
    SELECT doc_id, body, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
           CASE WHEN n = 0 OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>')
                     OR h[3] % 100 >= {TRANSFORMED_PERCENT} THEN 'plain'
                WHEN h[4] % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form
    FROM numbered
), parts AS (
    SELECT *, substring(body, 1, low) AS prefix, substring(body, low + 1, high - low) AS middle,
           substring(body, high + 1) AS suffix FROM cut
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN low END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM parts
"""
