import re
from collections import Counter

import pytest

from sessionloom.llm.quality import Rule, quality_columns

SCHEMA = "doc_id bigint, text string, kept string, n_words string"
CLEAN = " ".join(f"the{number} of and word{number}" for number in range(40))


def counts(text):
    text = text or ""
    tokens = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(tokens[at : at + 3]) for at in range(len(tokens) - 2)]
    often = Counter(windows)
    inside = {at + step for at, window in enumerate(windows) if often[window] > 1 for step in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return {
        "n_words": len(tokens),
        "word_chars": sum(map(len, tokens)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside),
        "n_latin_words": sum(bool(re.search("[A-Za-z]", token)) for token in tokens),
    }


TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "a b a b a b a b",
    "x y z\nx y z\n\n \nx y z",
    "Straße ünï 🙂 #$ <b>",
    "w " * 5000,
    CLEAN,
    CLEAN,
    " ".join(str(number % 700) for number in range(3000)),
]


def test_counts_equal_brute_force(spark):
    frame = spark.createDataFrame([(at, text, "mine", "x") for at, text in enumerate(TEXTS)], SCHEMA)
    rows = {row.doc_id: row for row in quality_columns(frame).collect()}
    for at, text in enumerate(TEXTS):
        for name, value in counts(text).items():
            assert rows[at][name] == value, (at, name)
    assert rows[0].base_failed and not rows[0].kept
    assert rows[7].base_failed
    assert rows[8].kept and rows[9].kept


def test_rules_and_extra_columns(spark):
    frame = spark.createDataFrame([(1, CLEAN, "a", "b"), (None, CLEAN + " #" * 60, "a", "b")], SCHEMA)
    result = quality_columns(frame)
    assert result.columns.count("kept") == 1 and result.columns.count("n_words") == 1
    assert {row.doc_id: row.kept for row in result.collect()} == {1: True, None: False}
    none = quality_columns(frame, rules=()).collect()
    assert all(row.kept for row in none)
    strict = quality_columns(frame, rules=(Rule("r", "n_words", "n_words", 101, None),)).collect()
    assert not any(row.kept for row in strict)


def test_empty_table(spark):
    assert quality_columns(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("words", [2, 3, 4])
def test_repeats_at_the_end(spark, words):
    text = "p q r s t " + " ".join("abcd"[:words]) + " k " + " ".join("abcd"[:words])
    row = quality_columns(spark.createDataFrame([(1, text, "", "")], SCHEMA)).first()
    assert row.n_repeat_words == counts(text)["n_repeat_words"]


def test_stop_words_judge_texts_in_the_latin_script(spark):
    """Texts in other scripts have no listed words and are left to the other rules."""
    letters = {"ru": "привет мир как дела друг слово", "el": "καλημέρα κόσμε λόγος φίλος", "ar": "سلام عالم كلمة صديق"}
    texts = {name: " ".join(f"{word}{at}" for at in range(15) for word in words.split()) for name, words in letters.items()}
    texts["pl"] = " ".join(f"zupa{at} nie stoi{at} na stole{at}" for at in range(15))
    texts["it"] = " ".join(f"pane{at} che non costa{at} di notte{at}" for at in range(15))
    texts["letters"] = " ".join(f"xq{at} zr{at} kt{at} bn{at}" for at in range(15))
    frame = spark.createDataFrame([(at, text, name, "") for at, (name, text) in enumerate(texts.items())], SCHEMA)
    rows = quality_columns(frame.withColumnRenamed("kept", "name")).collect()
    assert {row.name for row in rows if row.kept} == {"ru", "el", "ar", "pl", "it"}


def test_very_long_text(spark):
    text = " ".join(f"the{number} of and word{number}" for number in range(50_000))
    row = quality_columns(spark.createDataFrame([(1, text, "", "")], SCHEMA)).first()
    assert row.n_words == 200_000 and row.kept and row.n_repeat_words == 0
