import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import personal_data as pii

SCHEMA = "doc_id bigint, text string, spans string, row int"


@pytest.fixture(scope="module")
def model():
    return pii.fit(*pii.generated_windows(pii.GENERATED_WINDOWS))


def luhn(digits):
    doubled = [int(d) * 2 if at % 2 else int(d) for at, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_rule(text):
    """The patterns as they are written, with the standard scanner."""
    only = lambda found: re.sub("[^0-9]", "", found.group())
    spans = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(part) <= 255 for part in m.group().split(".")):
            spans.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 16 <= len(only(m)) <= 19 and luhn(only(m)):
            spans.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(only(m)) <= 15:
            spans.append((3, *m.span()))
    return spans


def test_base_spans_equal_the_patterns():
    draw = np.random.default_rng(5)
    pieces = ["a", "b.", "@", ".c", "-", "%", "+", "1", "25", "255.", "256", ".", " ", "(5", ")", "4111111111111111", "x@y.z", "é", "00"]
    for _ in range(4000):
        text = "".join(pieces[at] for at in draw.integers(0, len(pieces), draw.integers(1, 25)))
        assert pii.base_spans(text) == plain_rule(text), text


@pytest.mark.parametrize("text", ["a." * 500_000, "1" * 1_000_000, "1.2" * 300_000, "+1 (" * 250_000, "@" * 500_000, "a@b" * 200_000])
def test_long_runs_are_read_in_linear_time(text):
    assert isinstance(pii.base_spans(text), list)


def test_gradients():
    exact = pii.new_model(units=4)
    for name in ("ahead_in", "ahead", "back_in", "back", "out", "bias", "moves", "first", "last"):
        array = getattr(exact, name).astype(np.float64)
        setattr(exact, name, array + np.random.default_rng(1).normal(0, 0.1, array.shape))
    signs, tags = (window[:, :30] for window in pii.generated_windows(4))
    _, slopes = pii.slopes_of(exact, signs, tags)
    for array, slope in zip(exact.arrays(), slopes):
        place = np.unravel_index(np.abs(slope).argmax(), array.shape)
        array[place] += 1e-3
        above = pii.slopes_of(exact, signs, tags)[0]
        array[place] -= 2e-3
        below = pii.slopes_of(exact, signs, tags)[0]
        array[place] += 1e-3
        assert abs((above - below) / 2e-3 - slope[place]) < 1e-2 * max(1.0, abs(slope[place]))


def test_viterbi_is_the_best_path(model):
    signs = pii.generated_windows(3, seed=8)[0][:, :5]
    scores = pii.emissions(model, signs)
    best = pii.best_tags(model, scores)
    for window in range(3):
        paths = np.stack(np.meshgrid(*[range(pii.TAGS)] * 5, indexing="ij"), -1).reshape(-1, 5)
        value = model.first[paths[:, 0]] + model.last[paths[:, -1]]
        value = value + sum(scores[at, window, paths[:, at]] for at in range(5))
        value = value + sum(model.moves[paths[:, at], paths[:, at + 1]] for at in range(4))
        assert tuple(paths[value.argmax()]) == tuple(best[:, window])


def test_held_out_spans(model):
    writer = pii.SpanWriter(123)
    texts = [writer.text() for _ in range(300)]
    found = [{span[:3] for span in spans} for spans in pii.personal_spans([text for text, _ in texts], model)]
    wanted = [set(spans) for _, spans in texts]
    beyond = [{span for span in spans if span not in pii.base_spans(text)} for (text, _), spans in zip(texts, wanted)]
    right = sum(len(a & b) for a, b in zip(found, wanted))
    assert right / sum(map(len, wanted)) > 0.9 and right / sum(map(len, found)) > 0.95
    # Most spans that the patterns miss are found by the network.
    assert sum(len(a & b) for a, b in zip(found, beyond)) / sum(map(len, beyond)) > 0.8


def test_spans_do_not_depend_on_the_place_in_the_text(model):
    alone = pii.personal_spans(["call (743) 555-3824 now"], model)[0]
    assert [(kind, added) for kind, _, _, added in alone] == [(3, True)]
    filler = "plain words without any sign of it, again and again. "
    for shift in range(0, 400, 37):
        text = (filler * 20)[:shift] + " call (743) 555-3824 now " + filler * 20
        start = text.index("(743)")
        assert pii.personal_spans([text], model)[0] == [(3, start, start + 14, True)]


def test_windows_left_out_add_nothing(model, monkeypatch):
    writer = pii.SpanWriter(77)
    texts = [writer.text()[0] + "only words " * 40 + writer.text()[0] for _ in range(20)]
    short = pii.personal_spans(texts, model)
    monkeypatch.setattr(pii, "_TRIGGER", re.compile(r"(?s)."))
    assert pii.personal_spans(texts, model) == short


def test_overlaps_are_reconciled():
    text = "tel 555-123-4567 or 555-987-6543 end"
    pieces = [(3, 4, 12, 5.0), (3, 10, 16, 4.0), (2, 4, 10, 9.0), (3, 20, 32, 2.0)]
    assert pii.reconciled(text, [], pieces) == [(3, 4, 16), (3, 20, 32)]
    assert pii.reconciled(text, [(0, 15, 18)], pieces) == [(3, 20, 32)]
    assert pii.reconciled(text, [], [(3, 4, 16, -1.0)]) == []
    assert pii.reconciled(text[:32], [], [(3, 20, 40, 1.0)]) == [(3, 20, 32)]
    assert pii.reconciled("", [], [(3, 0, 4, 1.0)]) == []


def test_rows(spark, model):
    card, phone = "4111111111111111", "+1 (743) 555-3824"
    long = "words " * 200_000 + f"mail a.b@c.de or {phone}"
    rows = [(1, f"pay {card}, call {phone}"), (1, f"pay {card}, call {phone}"), (None, None), (2, ""), (3, "é😀 x@y.zz"), (4, long)]
    frame = spark.createDataFrame([(a, b, "s", 7) for a, b in rows], SCHEMA)
    found = pii.find_personal_data(frame, model)
    masked = found.withColumn("masked", pii.masked_text(F.col("text"), F.col("spans")))
    got = sorted(masked.collect(), key=lambda row: (row.id is None, row.id or 0))
    assert [row.masked[:30] for row in got[:2]] == ["pay [CARD], call [PHONE]"] * 2
    assert [[(s.kind, s.start, s.end) for s in row.spans] for row in got[2:4]] == [[], [("email", 3, 9)]]
    assert got[4].masked.endswith("mail [EMAIL] or [PHONE]") and got[5].spans == [] and got[5].text == ""
    assert all(row.row.spans == "s" and row.row.row == 7 for row in got)
    assert pii.find_personal_data(frame.limit(0), model).count() == 0


def test_training_sample(spark):
    texts = [f"word {at} mail u{at}@host.example.org and more" for at in range(50)] + ["no sign"] * 50 + [None, ""]
    frame = spark.createDataFrame([(at, text, "s", 7) for at, text in enumerate(texts)], SCHEMA)
    signs, tags = pii.corpus_windows(frame)
    again = pii.corpus_windows(frame)
    assert (signs == again[0]).all() and (tags == again[1]).all()
    assert 50 <= len(signs) <= pii.SAMPLE_WINDOWS and set(np.unique(tags)) == {0, 1}
    assert pii.corpus_windows(frame.limit(0))[0].shape == (0, pii.TRAIN_CHARS)
