import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sessionloom.llm import repeats
from sessionloom.llm.repeats import RunLengthIndex, long_matches, remove_repeats, segments_of

SCHEMA = "doc_id bigint, text string, size int, spans string"


def brute(texts, least=400):
    windows = Counter()
    bodies = [(text or "").encode() for text in texts]
    for body in bodies:
        windows.update(body[at : at + least] for at in range(len(body) - least + 1))
    out = []
    for body in bodies:
        gone = np.zeros(len(body) + 2, dtype=bool)
        for at in range(len(body) - least + 1):
            if windows[body[at : at + least]] > 1:
                gone[at + 1 : at + 1 + least] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(byte for byte, out_of in zip(body, gone[1:]) if not out_of)
        out.append((len(body), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randrange(1, 9)))
    prose = lambda count: " ".join(word() for _ in range(count))
    passage, exact, short = prose(160), "q" * 0 + prose(70)[:400].encode()[:400].decode(errors="ignore"), prose(20)
    out = [None, "", "short", prose(300), prose(300)]
    out += [prose(40) + passage + prose(30) for _ in range(12)]
    out += [prose(90) + passage[at * 20 :] for at in range(8)]
    out += ["ab" * 450, "x" * 900, "x" * 399, "y" * 400, "y" * 400]
    out += [prose(5) + exact, exact, exact[:-1], short + short]
    out += [prose(200)] * 3
    long = prose(4000)
    out += [long, long[:9000] + "CHANGED" + long[9000:], long[100:3000] * 3]
    return out


@pytest.mark.parametrize("group_segments", [2000, 3])
def test_removal_equals_brute_force(spark, texts, group_segments):
    rows = [(at, text, 1, "s") for at, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {row.id: row for row in remove_repeats(frame, group_segments=group_segments).collect()}
    for at, want in enumerate(brute(texts)):
        row = got[at]
        digest = hashlib.sha256(bytes(row.kept)).hexdigest()
        assert (row.n_bytes, row.n_removed, len(row.spans), digest) == want, at
        assert row.row.spans == "s"


def test_scan_in_parts(texts, monkeypatch):
    data = np.frombuffer("".join(text or "" for text in texts).encode(), dtype=np.uint8)
    offsets = np.array([0, 10_000, 10_100, len(data)])
    whole = segments_of(data, offsets)
    monkeypatch.setattr(repeats, "SCAN_BYTES", 1000)
    parts = segments_of(data, offsets)
    for text, start, windows, *_ in (whole, parts):
        covered = sorted((t, s + w) for t, first, count in zip(text, start, windows) for s in [first] for w in range(count))
        want = [(t, at) for t in range(3) for at in range(offsets[t + 1] - offsets[t] - 399)]
        assert covered == want
    assert set(parts[3]) == set(whole[3])


def test_run_length_index_is_smaller_and_exact():
    draw = random.Random(9)
    body = bytes(draw.choice(b"acgt") for _ in range(700))
    strings = [body[at : at + 600] for at in range(0, 60, 3)] + [b"", b"a"]
    index = RunLengthIndex(strings)
    assert len(index.heads) < len(index.text) / 8
    best = index.matching_statistics()
    for number, string in enumerate(strings):
        for at in range(0, len(string), 97):
            want = 0
            for other, candidate in enumerate(strings):
                for place in range(len(candidate)):
                    if (other, place) != (number, at):
                        length = 0
                        while (
                            at + length < len(string)
                            and place + length < len(candidate)
                            and string[at + length] == candidate[place + length]
                        ):
                            length += 1
                        want = max(want, length)
            assert best[index.starts[number] + at] == want
    assert long_matches([b"abc", b"xyz"], 2) == []


def test_null_ids_and_empty_table(spark):
    text = "".join(chr(97 + (at * at) % 26) for at in range(600)) + "".join(str(at) for at in range(300))
    frame = spark.createDataFrame([(None, text, 0, ""), (None, text, 0, ""), (3, "z", 0, "")], SCHEMA)
    assert sorted(row.n_removed for row in remove_repeats(frame).collect()) == [0, len(text), len(text)]
    assert remove_repeats(frame.where("false")).count() == 0


def test_passages_of_fifty_words_go_from_400_bytes_on(spark):
    """Planted passages lose all their bytes from 400 bytes on and none below; n_bytes stays the input's size."""
    draw = random.Random(12)
    word = lambda least: "".join(draw.choice("abcdefghij") for _ in range(draw.randrange(least, least + 4)))
    prose = lambda count, least=4: " ".join(word(least) for _ in range(count))
    long, short = [prose(55, 8) for _ in range(5)], [prose(52, 3) for _ in range(5)]
    assert min(map(len, long)) >= 400 > max(map(len, short))
    texts = [f"{prose(60)} #{at} {passage} {at}# {prose(60)}" for passage in long + short for at in range(2)]
    texts += [prose(150) for _ in range(20)]
    frame = spark.createDataFrame([(at, text, 1, "s") for at, text in enumerate(texts)], SCHEMA).repartition(3)
    got = {row.id: row for row in remove_repeats(frame).collect()}
    planted = [len(passage) + 2 for passage in long for _ in range(2)]
    assert [got[at].n_removed for at in range(10)] == planted
    assert all(got[at].n_removed == 0 for at in range(10, len(texts)))
    assert all(got[at].n_bytes == len(text) for at, text in enumerate(texts))
