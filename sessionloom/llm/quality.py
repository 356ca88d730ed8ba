"""Quality rules: a threshold table compiled into one projection.

A rule bounds a ratio of two counts of a text. All counts come from built-in functions within the
row; no user function runs and nothing is shuffled. Ratios are compared as whole numbers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.evaluate import evaluate_once
from sessionloom.llm.text import documents_table, words

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"
NOT_BLANK = r"[^\x20\x09-\x0D]"

# Frequent function words of languages in the Latin script. The first lines are English,
# German, French and Spanish, then Italian, Portuguese, Dutch, Swedish, Danish and Norwegian, Polish,
# Czech, Finnish, Hungarian, Romanian, Turkish and Indonesian.
STOP_WORDS = (
    "the be to of and that have with is in it for as "
    "der die und das von mit ist nicht den ein zu "
    "le la les de des et que un une en est pour "
    "el los las y del se con por "
    "il di che per non sono della "
    "os da do em para uma "
    "het van een niet dat op "
    "och att som det av "
    "og er til ikke "
    "na nie jest oraz "
    "je se ne "
    "ja on ei se "
    "az egy hogy nem "
    "si sa cu nu "
    "ve bir bu ile "
    "yang dan di dengan untuk"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text only if low <= 100 * numerator / denominator <= high; None is no bound."""

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 200, 1200),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 10),
    # Only words with a basic Latin letter are judged: texts in other scripts have no stop words here.
    Rule("stop_word_share", "n_stop_words", "n_latin_words", 2, None),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", None, 60),
)

INDEX_BITS = 24


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One condition over the count columns; an empty table keeps everything."""
    bounds = []
    for rule in rules:
        value, unit = F.col(rule.numerator) * 100, F.col(rule.denominator)
        if rule.low is not None:
            bounds.append(value >= unit * rule.low)
        if rule.high is not None:
            bounds.append(value <= unit * rule.high)
    return reduce(lambda left, right: left & right, bounds, F.lit(True))


def _window(at: Column) -> Column:
    return F.array_join(F.slice(F.col("_words"), at + 1, 3), " ")


def quality_columns(frame: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add the counts, ``base_failed`` and ``kept`` to every row.

    Counts (long): n_words; word_chars, code points in words; n_symbols; n_lines, lines with a
    word; n_dup_lines, those equal to an earlier one; n_repeat_words, words inside a run of three
    words that occurs twice or more in the text; n_stop_words; n_latin_words, words with a letter of
    A to Z in either case. ``base_failed`` is true below 50
    words or when more than half of the words are repeated. ``kept`` is false for those, else the
    verdict of the rules. A null or empty text has only zeros and fails. Other columns are kept;
    input columns with the names added here are replaced.

    The stop-word rule asks for two of a hundred words with a basic Latin letter. A text in another
    script is not judged by it; one in a Latin-script language that shares none of the listed words
    is rejected.

    Repeated runs: windows of three words are hashed and sorted as whole numbers together with
    their place; only windows whose hash prefix occurs twice are compared as text, so the result is
    exact while the sort stays primitive.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_latin_words"]
    keep = [f"`{name}`" for name in frame.columns if name not in (*added, "base_failed", "kept")]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    stops = sorted({form for word in STOP_WORDS for form in (word, word.capitalize(), word.upper())})
    rows = frame.select(F.struct(*keep).alias("_row"), body.alias("_body"))
    rows = evaluate_once(
        rows,
        {
            "_words": words(F.col("_body")),
            "_lines": F.filter(F.split("_body", "\n"), lambda line: line.rlike(NOT_BLANK)),
            "n_symbols": F.size(F.regexp_extract_all("_body", F.lit(SYMBOLS), F.lit(0))).cast("bigint"),
        },
    )
    place = (1 << INDEX_BITS) - 1
    hashed = lambda at: F.xxhash64(
        F.get(F.col("_words"), at), F.get(F.col("_words"), at + 1), F.get(F.col("_words"), at + 2)
    )
    packed = F.transform(
        F.sequence(F.lit(0), F.size("_words") - 3), lambda at: hashed(at).bitwiseAND(F.lit(~place)).bitwiseOR(at)
    )
    fits = F.size("_words").between(3, place)
    rows = evaluate_once(
        rows,
        {
            "_packed": F.when(fits, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")),
            "n_stop_words": F.size(F.filter("_words", lambda word: word.isin(stops))).cast("bigint"),
            "n_latin_words": F.size(F.filter("_words", lambda word: word.rlike("[A-Za-z]"))).cast("bigint"),
            "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        },
    )
    key = lambda value: F.shiftright(value, INDEX_BITS)
    twin = lambda value, at: key(value).eqNullSafe(key(F.get(F.col("_packed"), at)))
    doubtful = F.filter("_packed", lambda value, at: twin(value, at - 1) | twin(value, at + 1))
    # A text with more words than the packed place can number is compared whole.
    every = F.when(F.size("_words") > place, F.sequence(F.lit(0), F.size("_words") - 3).cast("array<bigint>"))
    candidates = F.transform(
        F.coalesce(every, F.transform(doubtful, lambda value: value.bitwiseAND(F.lit(place)))),
        lambda at: F.struct(_window(at.cast("int")).alias("run"), at.alias("at")),
    )
    rows = evaluate_once(rows, {"_runs": F.array_sort(candidates), "n_words": F.size("_words").cast("bigint")})
    run = lambda at: F.get(F.col("_runs"), at)["run"]
    repeated = F.filter("_runs", lambda item, at: item["run"].eqNullSafe(run(at - 1)) | item["run"].eqNullSafe(run(at + 1)))
    rows = evaluate_once(rows, {"_at": F.array_sort(F.transform(repeated, lambda item: item["at"]))})
    covered = F.aggregate(
        F.transform("_at", lambda at, nth: F.least(F.lit(3), F.coalesce(F.get(F.col("_at"), nth + 1) - at, F.lit(3)))),
        F.lit(0).cast("bigint"),
        lambda total, step: total + step,
    )
    rows = evaluate_once(rows, {"n_repeat_words": covered})
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT
    )
    return rows.select("_row.*", *added, failed.alias("base_failed"), (~failed & compile_rules(rules)).alias("kept"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality_columns(documents_table(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_lines",
        "n_stop_words",
        "n_latin_words",
    )


_STOPS_SQL = ", ".join(sorted({f"'{form}'" for word in STOP_WORDS for form in (word, word.capitalize(), word.upper())}))

QUALITY_SQL = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents
), tokens AS (
  SELECT row_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word,
         unnest(generate_series(1, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))) AS pos
  FROM texts
), runs AS (
  SELECT row_id, pos, word, lead(word) OVER w AS word2, lead(word, 2) OVER w AS word3
  FROM tokens WINDOW w AS (PARTITION BY row_id ORDER BY pos)
), marked AS (
  SELECT row_id, pos, word,
         word3 IS NOT NULL AND count(*) OVER (PARTITION BY row_id, word, word2, word3) > 1 AS twice
  FROM runs
), covered AS (
  SELECT row_id, word,
         twice OR coalesce(lag(twice) OVER w, false) OR coalesce(lag(twice, 2) OVER w, false) AS inside
  FROM marked WINDOW w AS (PARTITION BY row_id ORDER BY pos)
), word_counts AS (
  SELECT row_id, count(*) AS n_words, sum(length(word)) AS word_chars,
         count(*) FILTER (WHERE inside) AS n_repeat_words,
         count(*) FILTER (WHERE word IN ({_STOPS_SQL})) AS n_stop_words,
         count(*) FILTER (WHERE regexp_matches(word, '[A-Za-z]')) AS n_latin_words
  FROM covered GROUP BY row_id
), lines AS (
  SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM texts
), line_counts AS (
  SELECT row_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_id
), counts AS (
  SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words,
         CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '{SYMBOLS}')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_stop_words, 0) AS BIGINT) AS n_stop_words,
         CAST(coalesce(n_latin_words, 0) AS BIGINT) AS n_latin_words
  FROM texts LEFT JOIN word_counts USING (row_id) LEFT JOIN line_counts USING (row_id)
), judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM counts
)
SELECT *, NOT base_failed
  AND 100 * word_chars BETWEEN 200 * n_words AND 1200 * n_words
  AND 100 * n_symbols <= 10 * n_words
  AND 100 * n_stop_words >= 2 * n_latin_words
  AND 100 * n_dup_lines <= 60 * n_lines AS kept
FROM judged
"""
