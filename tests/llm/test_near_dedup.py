import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sessionloom.llm import near_dedup
from sessionloom.llm.components import connected_components
from sessionloom.llm.near_dedup import (
    REGISTERS,
    drop_near_duplicates,
    near_duplicate_classes,
    registers,
    similarity,
    weighted_elements,
)

SCHEMA = "doc_id bigint, text string, node string, root int"


def weights(text):
    tokens = text.split()
    runs = [tuple(tokens[at : at + 5]) for at in range(max(1, len(tokens) - 4))] if tokens else []
    return {run: 1 + math.log(count) for run, count in Counter(runs).items()}


def exact(left, right):
    keys, total = set(left) | set(right), 0.0
    for run in left.keys() & right.keys():
        total += 1 / sum(max(left.get(k, 0) / left[run], right.get(k, 0) / right[run]) for k in keys)
    return total


def edited(draw, tokens, edits):
    out = list(tokens)
    for at in draw.sample(range(len(out)), edits):
        out[at] = f"new{draw.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(5)
    texts = []
    for family in range(12):
        base = [f"w{draw.randrange(400)}" for _ in range(draw.randrange(6, 300))]
        texts += [base, base] + [edited(draw, base, max(1, len(base) // 60)) for _ in range(3)]
        texts.append(edited(draw, base, len(base) // 6 + 1))
    hub = [f"h{at}" for at in range(120)]
    texts += [edited(draw, hub, draw.randrange(1, 7)) for _ in range(60)] + [hub] * 40
    texts += [["ab"] * 30, ["ab"] * 31, ["one"], ["one"], ["one", "two"]]
    return [" ".join(text) for text in texts]


def test_similarity_and_estimate(corpus):
    sets = near_dedup._weighted_sets(pa.array(corpus))
    sketch = registers(*weighted_elements(pa.array(corpus)), len(corpus))
    errors = []
    for at in range(0, 70):
        for other in range(at + 1, 72):
            want = exact(weights(corpus[at]), weights(corpus[other]))
            assert similarity(sets[at], sets[other]) == pytest.approx(want, abs=1e-9)
            errors.append((sketch[at] == sketch[other]).mean() - want)
    assert abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 5 * 0.5 / REGISTERS**0.5


def test_sketch_does_not_depend_on_the_batch(corpus):
    alone = [registers(*weighted_elements(pa.array([text])), 1)[0] for text in corpus[:20]]
    together = registers(*weighted_elements(pa.array(corpus)), len(corpus))[:20]
    assert (np.array(alone) == together).all()


def test_classes_equal_brute_force(spark, corpus):
    rows = [(at, text, "n", 0) for at, text in enumerate(corpus)] + [(900, None, "", 0), (901, "", "", 0), (902, " \n", "", 0)]
    parents = list(range(len(corpus)))

    def top(at):
        while parents[at] != at:
            at = parents[at]
        return at

    sets = [weights(text) for text in corpus]
    for at in range(len(corpus)):
        for other in range(at):
            if exact(sets[at], sets[other]) >= 0.8:
                low, high = sorted((top(at), top(other)))
                parents[high] = low
    want = {at: top(at) for at in range(len(corpus))} | {900: 900, 901: 901, 902: 902}
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = near_duplicate_classes(frame).collect()
    assert {row.id: row.class_id for row in got} == want
    size = Counter(want.values())
    assert all(row.class_size == size[row.class_id] for row in got)
    kept = drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted(row.doc_id for row in kept.collect()) == sorted(set(want.values()))


def test_null_and_repeated_ids(spark):
    text = " ".join(f"t{at}" for at in range(30))
    rows = [(None, text, "", 0), (None, text, "", 0), (4, text, "", 0), (4, text, "", 0), (None, "alone here", "", 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted((row.id or -1, row.class_id or -1, row.class_size) for row in near_duplicate_classes(frame).collect())
    assert got == [(-1, -1, 1), (-1, 4, 4), (-1, 4, 4), (4, 4, 4), (4, 4, 4)]
    assert sorted((row.doc_id or -1) for row in drop_near_duplicates(frame).collect()) == [-1, 4]
    assert drop_near_duplicates(frame.where("false")).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (5, 4), (20, 20)] + [(at, at + 1) for at in range(100, 140)]
    got = {row.node: row.root for row in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[at] for at in range(1, 6)} == {1} and got[11] == 10
    assert {got[at] for at in range(100, 141)} == {100} and 20 not in got


def test_pairs_at_the_threshold_are_linked(spark):
    """216 of 270 shared runs are a similarity of exactly 0.8, which a sum of quotients may miss."""
    words = [f"w{at}" for at in range(248)]
    one = " ".join(words)
    other = " ".join(words[:220] + [f"x{at}" for at in range(26)])
    runs = lambda text: {tuple(text.split()[at : at + 5]) for at in range(len(text.split()) - 4)}
    assert (len(runs(one) & runs(other)), len(runs(one) | runs(other))) == (216, 270)
    frame = spark.createDataFrame([(1, one), (2, other)], "doc_id bigint, text string")
    assert [row.class_size for row in near_duplicate_classes(frame).collect()] == [2, 2]
