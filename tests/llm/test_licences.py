import random
import re
import textwrap

from sessionloom.llm.licences import TEMPLATES, licence_lines, licence_notices, licence_passages

SCHEMA = "doc_id bigint, text string, template string, size int"


def found(spark, rows, **settings):
    frame = spark.createDataFrame([(*row, "t", 0) for row in rows], SCHEMA)
    return sorted((row.id or -1, row.line, row.licence, row.shared, row.total) for row in licence_lines(frame, **settings).collect())


def test_templates_and_variants(spark):
    mit = next(text for name, text in TEMPLATES if name == "MIT" and len(text) > 200)
    rows = [
        (1, "intro\nReleased  under THE mit license!!\nend"),
        (2, mit.upper()),
        (3, mit[:60]),
        (4, None),
        (5, ""),
        (6, " \n.\n"),
        (None, "Licensed under CC BY-NC 4.0."),
        (7, "Licensed under CC BY-NC 4.0.\n" * 2),
        (8, "under the mit license we released"),
    ]
    got = found(spark, rows)
    assert [(row[0], row[1], row[2]) for row in got] == [
        (-1, 1, "CC-BY-NC-4.0"), (1, 2, "MIT"), (2, 1, "MIT"), (7, 1, "CC-BY-NC-4.0"), (7, 2, "CC-BY-NC-4.0")
    ]
    assert next(row for row in got if row[0] == 1)[3:] == (4, 8)


def test_score_is_dice(spark):
    templates = (("T", "a b c d e"),)
    assert found(spark, [(1, "a b c d x")], templates=templates, percent=75) == [(1, 1, "T", 3, 8)]
    assert found(spark, [(1, "a b c d x")], templates=templates, percent=76) == []
    assert found(spark, [(1, "a b c d e e")], templates=templates, percent=88) == [(1, 1, "T", 4, 9)]


def test_empty_table(spark):
    assert found(spark, []) == []


def notices(spark, rows, scan=licence_notices, **settings):
    frame = spark.createDataFrame([(*row, "t", 0) for row in rows], SCHEMA)
    return sorted((row.id or -1, row.line, row.licence, row.shared, row.total) for row in scan(frame, **settings).collect())


def test_wrapped_notices_are_found(spark):
    """Every template, wrapped at header widths and with comment marks, at its full score."""
    rows, want = [], []
    for at, (name, text) in enumerate(TEMPLATES):
        for width in (40, 76):
            for mark in ("", " * ", "# "):
                body = textwrap.wrap(text, width)
                if len(body) > 1:
                    rows.append((len(rows) + 1, "\n".join(["intro words", *(mark + line for line in body), "more words"])))
                    want.append((rows[-1][0], name))
    got = notices(spark, rows)
    assert len(rows) > 40
    assert {(row[0], row[2]) for row in got if row[3] * 2 == row[4]} >= set(want)
    assert all(row[1] == 2 for row in got if row[3] * 2 == row[4] and row[3] > 20)


def test_embedded_notices_are_found(spark):
    rows = [
        (1, "Copyright 2020 X. Licensed under the MIT License. All other rights are kept by the author of it."),
        (2, "first line\nSee the file COPYING; this work is licensed under the GNU General\nPublic License, version 3, as is."),
        (3, "Licensed under the MIT License."),
        (4, "We ate a license of the kind that is not under any terms."),
        (5, "old Licensed under CC BY-NC 4.0. words and some more text " * 3),
        (6, None),
        (7, " \n.\n"),
        (8, "Copyright 2020 X. Released under the MIT License or, at your choice, licensed under the Apache License, Version 2.0."),
    ]
    assert notices(spark, rows) == [
        (1, 1, "MIT", 4, 8),
        (2, 2, "GPL-3.0", 11, 22),
        (3, 1, "MIT", 4, 8),
        (5, 1, "CC-BY-NC-4.0", 6, 12),
        (5, 1, "CC-BY-NC-4.0", 6, 12),
        (5, 1, "CC-BY-NC-4.0", 6, 12),
        (8, 1, "Apache-2.0", 7, 14),
        (8, 1, "MIT", 4, 8),
    ]
    assert notices(spark, []) == []


def test_passages_equal_brute_force(spark):
    draw = random.Random(3)
    templates = (("A", "a b c d e f"), ("A", "b c d"), ("B", "e a c e a"), ("C", "z"))
    words = lambda text: re.findall("[a-z0-9]+", text.lower())
    pairs = lambda of: {tuple(of[at : at + 2]) for at in range(max(1, len(of) - 1))}

    def brute(text, percent):
        numbered = [(word, at) for at, line in enumerate(text.split("\n"), 1) for word in words(line)]
        every = [word for word, _ in numbered]
        told = set()
        for at, line in enumerate(text.split("\n"), 1):
            for licence, body in templates:
                own, line_pairs = pairs(words(body)), pairs(words(line))
                if words(line) and 200 * len(own & line_pairs) >= percent * (len(own) + len(line_pairs)):
                    told.add((licence, at))
        ranked = []
        for number, (licence, body) in enumerate(templates):
            own = pairs(words(body))
            single = len(words(body)) == 1
            for start in range(len(every)):
                for size in range(1, len(own) * (200 - percent) // percent + 1):
                    span = every[start : start + size + (not single)]
                    if len(span) < size + (not single) or (single and size > 1):
                        continue
                    of = pairs(span)
                    shared, total = len(of & own), len(of) + len(own)
                    ends = (tuple(span),) if single else (tuple(span[:2]), tuple(span[-2:]))
                    if all(end in own for end in ends) and 200 * shared >= percent * total:
                        ranked.append((-shared / total, -shared, start, start + len(span) - 1, number, licence, total))
        kept = []
        for one in sorted(ranked):
            if all(k[5] != one[5] or k[2] > one[3] or one[2] > k[3] for k in kept):
                kept.append(one)
        out = []
        for one in kept:
            first, last = numbered[one[2]][1], numbered[one[3]][1]
            if first != last or (one[5], first) not in told:
                out.append((first, one[5], -one[1], one[6]))
        return out

    texts = ["".join(draw.choice("aabbccddeefxz") + draw.choice("    \n") for _ in range(draw.randrange(1, 60))) for _ in range(80)]
    texts += ["a b c d e f " * 4, "z", "x z\nz", "a b\nc d\ne f"]
    for percent in (60, 80):
        want = sorted((at, *row) for at, text in enumerate(texts, 1) for row in brute(text, percent))
        got = notices(spark, list(enumerate(texts, 1)), licence_passages, templates=templates, percent=percent)
        assert got == want and len(want) > 50


def test_very_long_texts_full_of_notices(spark):
    """100 kB of wrapped notices, one after the other, and a line of as many words; each is found once."""
    long = [text for _, text in TEMPLATES if len(text) > 200]
    names = [name for name, text in TEMPLATES if len(text) > 200]
    wrapped = "\n".join("\n".join(textwrap.wrap(long[at % 2], 70)) for at in range(280))
    assert len(wrapped) > 90_000
    filler = " ".join(f"word{at}" for at in range(20_000))
    got = notices(spark, [(1, wrapped), (2, filler + " " + long[0] + " " + filler)])
    whole = [row for row in got if row[0] == 1]
    assert len(whole) == 280 and {row[2] for row in whole} == set(names[:2])
    assert all(row[3] * 2 == row[4] for row in whole)
    assert [(row[0], row[2]) for row in got if row[0] == 2] == [(2, names[0])]
