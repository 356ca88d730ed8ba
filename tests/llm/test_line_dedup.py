import random
from collections import Counter

import numpy as np
import pyarrow as pa

from sessionloom.llm import line_dedup
from sessionloom.llm.line_dedup import dedup_lines, line_sets, rarity, token_values
from sessionloom.llm.text import text_bytes, word_hashes

SCHEMA = "doc_id bigint, text string, node string, kept string"


def brute(rows):
    """Numbers of removed lines for each (id, text)."""
    order = sorted(set(rows), key=lambda row: (row[0] is None, row[0] or 0))
    seen, out = [], {}
    for doc_id, text in order:
        gone = set()
        for number, line in enumerate((text or "").split("\n")):
            own = set(line.split())
            if own:
                if any(len(own & other) * 180 >= (len(own) + len(other)) * 80 for other in seen):
                    gone.add(number)
                seen.append(own)
        out[doc_id, text] = gone
    return out


def rows():
    draw = random.Random(8)
    pool = [[f"w{draw.randrange(60 if at % 3 else 5000)}" for _ in range(draw.randrange(1, 40))] for at in range(40)]
    out = []
    for at in range(60):
        lines = []
        for _ in range(draw.randrange(0, 9)):
            line = list(draw.choice(pool))
            for _ in range(draw.randrange(3)):
                line[draw.randrange(len(line))] = f"e{draw.randrange(100)}"
            draw.shuffle(line)
            lines.append(" ".join(line))
        out.append((at, "\n".join([*lines, "common line of all", " "])))
    return out + [(70, None), (71, ""), (72, "\n\n"), (None, "common line of all\nnew words here")]


def test_lines_equal_brute_force(spark, monkeypatch):
    data = rows()
    want = brute(data)
    frame = spark.createDataFrame([(*row, "n", "k") for row in data], SCHEMA).repartition(3)

    def check():
        got = dedup_lines(frame).collect()
        assert len(got) == len(data)
        for row in got:
            gone = want[row.row.doc_id, row.row.text]
            lines = (row.row.text or "").split("\n")
            assert row.n_removed == len(gone)
            assert row.kept == "\n".join(line for number, line in enumerate(lines) if number not in gone)

    check()
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    check()


def test_repeated_rows_are_one_document(spark):
    data = [(1, "a b c\nd e f")] * 2 + [(2, "c b a\nother words")]
    got = dedup_lines(spark.createDataFrame([(*row, "", "") for row in data], SCHEMA)).collect()
    assert sorted((row.id, row.n_removed, row.n_lines) for row in got) == [(1, 0, 2), (1, 0, 2), (2, 1, 2)]
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def hashed(words):
    """Hash of each word."""
    data, offsets = text_bytes(pa.array(words))
    return word_hashes(data, offsets[:-1], offsets[1:])


def test_order_is_rarity_with_most_buckets_in_use(spark):
    """A word in 300 texts comes last and the others by the count of their bucket, also beyond 32,768 buckets."""
    texts = [" ".join(f"u{at}" for at in range(start, start + 1000)) for start in range(0, 150_000, 1000)]
    texts += ["often " * 40 + "u1 u2 u3"] * 300
    every = [word for text in texts for word in text.split()]
    mask = np.uint64((1 << line_dedup.BUCKET_BITS) - 1)
    counts = Counter((hashed(every) & mask).tolist())
    assert len(counts) > 40_000
    ranks, frequent = rarity(spark.createDataFrame([(text,) for text in texts], "text string"))
    line = ["often", *(f"u{at}" for at in range(1, 150_000, 500))]
    tokens = token_values(hashed(line), ranks)
    ordered = [counts[bucket] for bucket in (hashed(line) & mask)[np.argsort(tokens)].tolist()]
    assert ordered == sorted(ordered) and line[int(tokens.argmax())] == "often"
    assert len(set(token_values(hashed(every), ranks).tolist())) == len(set(every))
    assert frequent == (1 << line_dedup.BUCKET_BITS) - sum(count >= line_dedup.CROWD for count in counts.values())


def test_sets_of_lines():
    """Sets, sizes and prefixes of each line; order, repetitions and white space do not matter."""
    ranks = np.arange(1 << line_dedup.BUCKET_BITS)
    texts = ["b a c a d e f\n\n \t\n f\x0be d c b a ", None, "", "x", "g h\n\ni"]
    text, line, h1, h2, size, bits, prefix, length = line_sets(pa.array(texts), ranks)
    assert list(zip(text.tolist(), line.tolist(), size.tolist())) == [(0, 0, 6), (0, 3, 6), (3, 0, 1), (4, 0, 2), (4, 2, 1)]
    assert h1[0] == h1[1] and h2[0] == h2[1] and bits[0] == bits[1] and len(set(h1.tolist())) == 4
    assert length.tolist() == [2, 2, 0, 0, 0]
    own = sorted(token_values(hashed(["a", "b", "c", "d", "e", "f"]), ranks).tolist())
    assert prefix.tolist() == [token >> 32 for token in own[:2]] * 2


def brute_links(rows):
    """Other word sets that the lines of each (id, text) are linked to, summed over its lines."""
    lines = {row: [frozenset(line.split()) for line in (row[1] or "").split("\n") if line.split()] for row in set(rows)}
    every = {own for sets in lines.values() for own in sets}
    similar = lambda a, b: a != b and len(a & b) * 180 >= (len(a) + len(b)) * 80
    links = {own: sum(similar(own, other) for other in every) for own in every}
    return {row: sum(links[own] for own in sets) for row, sets in lines.items()}


def test_crowded_words_are_dealt_to_blocks(spark, monkeypatch):
    """A word in all lines and prefix words of many similar lines meet block by block."""
    monkeypatch.setattr(line_dedup, "CROWD", 3)
    draw = random.Random(3)
    base = [f"x{at}" for at in range(12)]
    data = [(at, " ".join(["all", *base[:11], f"y{draw.randrange(9)}"]) + "\nall " + " ".join(f"z{draw.randrange(40)}" for _ in range(5))) for at in range(40)]
    data += rows()[:30]
    want, links = brute(data), brute_links(data)
    frame = spark.createDataFrame([(*row, "n", "k") for row in data], SCHEMA).repartition(3)
    for row in dedup_lines(frame).collect():
        key = (row.row.doc_id, row.row.text)
        assert row.n_removed == len(want[key]) and row.links == links[key]
    assert sum(links.values()) > 400


def test_very_long_line_and_text(spark):
    long = " ".join(f"w{at}" for at in range(20_000))
    many = "\n".join(f"line {at} of a long text" for at in range(3_000))
    data = [(1, long), (2, long + " more"), (3, many), (4, "line 7 of a long text")]
    got = dedup_lines(spark.createDataFrame([(*row, "", "") for row in data], SCHEMA)).collect()
    assert sorted((row.id, row.n_lines, row.n_removed) for row in got) == [(1, 1, 0), (2, 1, 1), (3, 3000, 0), (4, 1, 1)]


def test_long_lines_that_differ_are_no_candidates(spark, monkeypatch):
    """Long lines with some rare words in common do not come to be verified."""
    found, plain = [], line_dedup._candidate_pairs

    def counted(*args):
        pairs = plain(*args)
        found.append(pairs.count())
        return pairs

    monkeypatch.setattr(line_dedup, "_candidate_pairs", counted)
    draw = random.Random(5)
    data = [(at, " ".join(f"v{word}" for word in draw.sample(range(3000), 160))) for at in range(80)]
    data += [(100 + at, text.replace(" v", f" c{at} v", 1)) for at, (_, text) in enumerate(data[:10])]
    links = brute_links(data)
    got = dedup_lines(spark.createDataFrame([(*row, "n", "k") for row in data], SCHEMA)).collect()
    assert {(row.row.doc_id, row.row.text): row.links for row in got} == links
    assert sum(links.values()) == 20 and 10 <= found[0] <= 30


def test_words_of_a_set_are_sent_to_few_places(spark, monkeypatch):
    """Lines of a family that share different rare words meet at one place, not at each such word."""
    met, plain = [], line_dedup._meetings

    def counted(rows, *args):
        met.append((rows.count(), rows.select("number").distinct().count()))
        return plain(rows, *args)

    monkeypatch.setattr(line_dedup, "_meetings", counted)
    draw, data = random.Random(6), []
    for family in range(6):
        base = [f"f{family}w{at}" for at in range(100)]
        for member in range(12):
            line = list(base)
            for at in draw.sample(range(100), 4):
                line[at] = f"m{family}n{member}p{at}"
            data.append((len(data), " ".join(line)))
    links = brute_links(data)
    got = dedup_lines(spark.createDataFrame([(*row, "n", "k") for row in data], SCHEMA)).collect()
    assert {(row.row.doc_id, row.row.text): row.links for row in got} == links
    rows, sets = met[-1]
    assert sets == len(data) and rows <= 1.2 * sets


def test_bitmaps_differ_in_no_more_bits_than_sets_in_words():
    draw = random.Random(7)
    texts = [" ".join(f"w{draw.randrange(300)}" for _ in range(draw.randrange(0, 250))) for _ in range(40)] + [None, ""]
    sets, size, lanes = line_dedup.word_sets(pa.array(texts))
    own = [set((text or "").split()) for text in texts]
    assert size.tolist() == [len(words) for words in own] and [len(words) for words in sets.to_pylist()] == size.tolist()
    ranks = np.arange(1 << line_dedup.BUCKET_BITS)
    filled = [at for at, words in enumerate(own) if words]
    _, _, _, _, _, bits, _, _, more = line_dedup._line_parts(pa.array(texts), ranks)
    for i, a in enumerate(filled):
        for j, b in enumerate(filled):
            apart = len(own[a] ^ own[b])
            assert len(set(sets[a].as_py()) ^ set(sets[b].as_py())) == apart
            assert sum(int(lane[a] ^ lane[b]).__and__((1 << 64) - 1).bit_count() for lane in lanes) <= apart
            second, first = int(more[i] ^ more[j]), int(bits[i] ^ bits[j])
            both = [(second & ((1 << 64) - 1)), ((first ^ second) & ((1 << 64) - 1))]
            assert sum(value.bit_count() for value in both) <= apart


def test_pairs_of_a_family_are_in_no_table(spark, monkeypatch):
    """Tables grow with the sets of a family, not with its pairs, and each pair is counted once."""
    written, plain = [], line_dedup._landed

    def counted(frame, *args, **kwargs):
        table = plain(frame, *args, **kwargs)
        written.append(table.count())
        return table

    monkeypatch.setattr(line_dedup, "_landed", counted)
    draw, data = random.Random(9), []
    base = [f"w{at}" for at in range(60)]
    for member in range(80):
        line = list(base)
        for at in draw.sample(range(60), draw.randrange(1, 5)):
            line[at] = f"m{draw.randrange(9)}p{at}"
        data.append((member, " ".join(line)))
    want, links = brute(data), brute_links(data)
    for crowd, words in ((1024, 16_384), (7, 5)):
        monkeypatch.setattr(line_dedup, "CROWD", crowd)
        monkeypatch.setattr(line_dedup, "WORD_CROWD", words, raising=False)
        written.clear()
        got = dedup_lines(spark.createDataFrame([(*row, "n", "k") for row in data], SCHEMA).repartition(3)).collect()
        assert {(row.row.doc_id, row.row.text): row.links for row in got} == links
        assert {(row.row.doc_id, row.row.text): row.n_removed for row in got} == {row: len(gone) for row, gone in want.items()}
        assert max(written) <= 4 * len(data) and sum(links.values()) > 30 * len(data)


def test_a_text_is_cut_once_and_not_for_every_line(spark):
    data = [(1, "a b c\nd e f\na b c"), (2, "c b a\nother words")]
    found = dedup_lines(spark.createDataFrame([(*row, "", "") for row in data], SCHEMA)).select("kept")
    assert "lambdafunction(split(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(row.kept for row in found.collect()) == ["a b c\nd e f", "other words"]


def test_order_by_group_and_value():
    draw = np.random.default_rng(2)
    for groups in (1, 2, 5000):
        group = np.sort(draw.integers(0, groups, 3000))
        # Values that differ in all bits, and some only in the lowest ones.
        value = draw.integers(-(1 << 63), (1 << 63) - 1, 3000, dtype=np.int64)
        for values in (value, np.where(value % 3 == 0, value >> 50, value)):
            order = line_dedup._order(group, values)
            want = np.lexsort((values, group))
            assert (group[order] == group[want]).all() and (values[order] == values[want]).all()
