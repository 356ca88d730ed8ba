import hashlib

import numpy as np
import pyarrow as pa

from sessionloom.llm import fill_in_middle as fim

SCHEMA = "doc_id bigint, text string, n string, body int"


def plain_rule(doc_id, text):
    """The transformation one text at a time."""
    text = text or ""
    digest = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h = [int(digest[8 * at : 8 * at + 8], 16) for at in range(4)]
    n = len(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h[3] % 100 < 20:
        return n, "spm", low, high - low, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", low, high - low, f"<P>{prefix}<S>{suffix}<M>{middle}"


def compare(spark, rows):
    frame = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], SCHEMA)
    found = fim.restore_texts(fim.fill_in_middle(frame)).collect()
    got = sorted((str(r.id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found)
    assert got == sorted((str(a), *plain_rule(a, b)) for a, b in rows)
    assert sorted((str(r.id), r.restored) for r in found) == sorted((str(a), b or "") for a, b in rows)
    assert all(r.row.n == "x" and r.row.body == 1 for r in found)


def test_equals_the_plain_rule(spark):
    pieces = ["a", "é", "語", "😀", "<", "P>", "<S", ">", " ", "\n", "<M", "\0"]
    draw = np.random.default_rng(4)
    texts = ["".join(pieces[at] for at in draw.integers(0, len(pieces), draw.integers(0, 30))) for _ in range(400)]
    compare(spark, list(enumerate(texts)))
    forms = {plain_rule(at, text)[1] for at, text in enumerate(texts)}
    assert forms == {"plain", "psm", "spm"}


def test_odd_rows(spark):
    odd = [(None, "null id"), (None, "null id"), (7, None), (8, ""), (9, "x"), (9, "x"), (-3, "<M>"), (10, "<S>" * 3)]
    compare(spark, odd)
    empty = fim.fill_in_middle(spark.createDataFrame([], SCHEMA))
    assert fim.restore_texts(empty).count() == 0


def test_very_long_text(spark):
    compare(spark, [(at, "añ語😀 " * 300_000 + "end") for at in (1, 5)] + [(2, "short")])


def test_texts_are_moved_in_small_steps(monkeypatch):
    monkeypatch.setattr(fim, "MOVE_BYTES", 5)
    texts = ["", "añ語😀 text", "b", "one more, longer than a step", "", "c"]
    data, offsets = fim.text_bytes(pa.array(texts))
    form = np.array(["psm", "spm", "plain", "psm", "plain", "spm"])
    low, high = np.array([0, 2, 0, 5, 0, 1]), np.array([0, 2, 1, 20, 0, 1])
    out, ends = fim.scatter_parts(data, offsets, form, low, high)
    assert out[ends[1] : ends[2]].tobytes().decode() == "<S>語😀 text<P>añ<M>"
    assert out[ends[3] : ends[4]].tobytes() == b"<P>one m<S>n a step<M>ore, longer tha"
    back, starts = fim.gather_parts(out, ends, form)
    assert back.tobytes() == data.tobytes() and (starts == offsets).all()
