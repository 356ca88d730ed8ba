"""Benchmark decontamination by size-partitioned MinHash containment search.

A text's signature is a one-permutation MinHash over its runs of five words: the hash space is cut
into bins and the smallest hash of each bin is kept. Texts are partitioned by size, and a
partition has bins in proportion to its size, eight to four for each run, so a run of a short item
survives in the signature of a long document as surely as in that of a short one. Items and
documents that share a bin minimum at the partition's bin count, and whose sizes admit the
containment, are candidates. They are verified by the exact number of shared runs.

A run that does not lead its bin is in no signature, which an item of many runs survives and one of
few runs does not. Items of few runs are therefore met by all runs of the documents, and items of
fewer than five words, where asked for, by all runs of their own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.evaluate import evaluate_once
from sessionloom.llm.text import SHINGLE_WORDS, documents_table, shingles, words, written

CONTAINMENT_PERCENT = 80
BIN_BITS = 2
# Items of fewer runs are met by all runs of the documents instead of their signatures.
FEW_RUNS = 12
# Rows of item signatures (about 40 bytes each) that may be broadcast; more are joined by a shuffle.
# There is one for each distinct run of a distinct item, so they also bound the items' own runs.
BROADCAST_ROWS = 1_000_000


def _run_hashes(of_words: Column) -> Column:
    """Hashes of all runs of five words; a shorter text is one run."""
    run = lambda at: F.xxhash64(*[F.get(of_words, at + step) for step in range(5)])
    return (
        F.when(F.size(of_words) >= 5, F.transform(F.sequence(F.lit(0), F.size(of_words) - 5), run))
        .when(F.size(of_words) > 0, F.array(F.xxhash64(F.array_join(of_words, " "))))
        .otherwise(F.array().cast("array<bigint>"))
    )


def _hashed(texts: DataFrame) -> DataFrame:
    """Rows (node, runs): a text's hash and its distinct run hashes in order; only texts with words."""
    hashed = evaluate_once(texts.select("node", "text"), {"_words": words(F.col("text"))})
    hashed = evaluate_once(hashed.select("node", "_words"), {"_all": _run_hashes(F.col("_words"))})
    hashed = evaluate_once(hashed.select("node", "_all"), {"runs": F.sort_array(F.array_distinct("_all"))})
    return hashed.select("node", "runs").where(F.size("runs") > 0)


def document_runs(texts: DataFrame) -> DataFrame:
    """Rows (node, size, bits, value, leads): all runs of each document and which are minima of its 2**bits bins."""
    bits = F.ceil(F.log2(F.size("runs").cast("double"))).cast("int") + BIN_BITS
    sized = evaluate_once(_hashed(texts), {"bits": bits})
    bin_of = lambda value: F.call_function("shiftright", value, 64 - F.col("bits"))
    leads = lambda value, at: ~bin_of(value).eqNullSafe(bin_of(F.get(F.col("runs"), at - 1)))
    marked = F.transform("runs", lambda value, at: F.struct(value.alias("value"), leads(value, at).alias("leads")))
    return sized.select("node", F.size("runs").alias("size"), "bits", F.inline(marked).alias("value", "leads"))


def document_signatures(texts: DataFrame) -> DataFrame:
    """Rows (node, size, bits, value): the bin minima of each document with 2**bits bins."""
    return document_runs(texts).where("leads").drop("leads")


def _short_runs(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """Rows (node, value): the distinct run hashes of each text for runs of so many words, under five."""
    of_words = F.col("_words")
    hashed = lambda length: F.when(
        F.size(of_words) >= length,
        F.transform(
            F.sequence(F.lit(1), F.size(of_words) - (length - 1)),
            lambda at: F.xxhash64(F.array_join(F.slice(of_words, at, length), " ")),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    split = evaluate_once(texts.select("node", "text"), {"_words": words(F.col("text"))})
    every = F.array_distinct(F.concat(*[hashed(length) for length in lengths]))
    return split.select("node", F.explode(every).alias("value"))


def item_signatures(texts: DataFrame) -> DataFrame:
    """Rows (item, item_size, bits_from, value): each run hash and the fewest bits at which it leads its bin.

    A hash that leads its bin also leads the smaller bin of any finer cut, so one row serves all
    partitions: it is in the signature from one bit more than it shares with the hash before it.
    """
    shared = lambda value, before: 64 - F.length(F.bin(value.bitwiseXOR(before)))
    entry = F.transform(
        "runs",
        lambda value, at: F.struct(
            value.alias("value"),
            F.when(at == 0, 0).otherwise(shared(value, F.get(F.col("runs"), at - 1)) + 1).alias("bits_from"),
        ),
    )
    return _hashed(texts).select(
        F.col("node").alias("item"), F.size("runs").alias("item_size"), F.inline(entry).alias("value", "bits_from")
    )


def contained_items(
    frame: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    item_text: str = "text",
    percent: int = CONTAINMENT_PERCENT,
    short_inside: bool = False,
) -> DataFrame:
    """One row per document row and item that it contains: id, item_id, node, item_runs, shared_runs.

    A document contains an item if it has at least ``percent`` of the item's distinct runs of five
    words; a text of fewer words is one run of all its words. Texts without words (null, empty,
    blank) contain nothing and are not contained. Rows with equal text, ids that are null or
    repeated and repeated rows each give their own result rows; ``node`` is a hash of the text. An
    empty table on either side gives no rows. Other columns are ignored.

    With ``short_inside`` an item of fewer than five words is one run of its own length, and a
    document contains it if its words stand in the document one after the other.

    Items of fewer than ``FEW_RUNS`` runs are found without fail. For the others a shared run is missed
    only if a smaller hash falls into its bin, which has a chance of at most about an eighth per side
    and run; a pair is missed only if that happens to all its shared runs, ten or more.
    """
    body = lambda column: F.coalesce(F.col(f"`{column}`"), F.lit(""))
    documents = frame.select(F.col(f"`{doc_id}`").alias("id"), body(text).alias("text"))
    documents = documents.select("id", F.xxhash64("text").alias("node"), "text")
    queries = items.select(F.col(f"`{item_id}`").alias("item_id"), body(item_text).alias("text"))
    queries = queries.select("item_id", F.xxhash64("text").alias("node"), "text")
    signatures = written(item_signatures(queries.select("node", "text").distinct()), "item-signatures")
    small = signatures.count() <= BROADCAST_ROWS
    near = lambda table: F.broadcast(table) if small else table
    few = F.col("item_size") < FEW_RUNS
    met = document_runs(documents).join(near(signatures), "value")
    met = met.where(few | (F.col("leads") & (F.col("bits") >= F.col("bits_from"))))
    # For an item of few runs the number of met runs is that of shared ones, or more where texts repeat.
    pairs = (
        met.where(F.col("size") * 100 >= F.col("item_size") * percent)
        .groupBy("node", "item", "item_size")
        .agg(F.count("*").alias("met"))
        .where(~few | (F.col("met") * 100 >= F.col("item_size") * percent))
        .select("node", "item")
    )
    if short_inside:
        size = F.size(words(F.col("text"))).alias("size")
        lengths = sorted(row["size"] for row in queries.select(size).where("size between 1 and 4").distinct().collect())
        if lengths:
            single = signatures.where("item_size = 1")
            inside = _short_runs(documents, lengths).join(near(single), "value").select("node", "item")
            pairs = pairs.union(inside).distinct()
    candidates = written(pairs, "candidates")
    # Repeated items are verified once; their ids are joined to what was found.
    of_items = evaluate_once(
        queries.select(F.col("node").alias("item"), "text").distinct(), {"item_words": words(F.col("text"))}
    )
    of_items = of_items.select("item", "item_words", shingles(F.col("item_words")).alias("item_runs"))
    # Only candidate documents are cut into runs again; each with all its candidate items.
    of_documents = evaluate_once(documents.join(candidates, "node"), {"doc_words": words(F.col("text"))})
    both = of_documents.select("id", "node", "item", "doc_words").join(near(of_items), "item")
    doc_runs = shingles(F.col("doc_words"))
    if short_inside:
        length = F.size("item_words")
        starts = F.sequence(F.lit(1), F.size("doc_words") - length + 1)
        follows = (F.size("doc_words") >= length) & F.exists(
            starts, lambda at: F.slice("doc_words", at, length) == F.col("item_words")
        )
        own = F.when(follows, F.col("item_runs")).otherwise(F.array().cast("array<string>"))
        doc_runs = F.when(length < SHINGLE_WORDS, own).otherwise(doc_runs)
    both = evaluate_once(both, {"doc_runs": doc_runs})
    counted = evaluate_once(
        both.select("id", "node", "item", "item_runs", "doc_runs"),
        {
            "found": F.struct(
                F.size("item_runs").cast("bigint").alias("item_runs"),
                F.size(F.array_intersect("item_runs", "doc_runs")).cast("bigint").alias("shared_runs"),
            )
        },
    )
    found = counted.select("id", "item", "node", "found.*").where(
        F.col("shared_runs") * 100 >= F.col("item_runs") * percent
    )
    ids = queries.select("item_id", F.col("node").alias("item"))
    return found.join(ids, "item").select("id", "item_id", "node", "item_runs", "shared_runs")


def drop_contaminated(
    frame: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item_text: str = "text",
    least_words: int = 1,
    **names: str | bool,
) -> DataFrame:
    """The rows whose text contains no item of ``least_words`` or more words, with all columns.

    With ``short_inside`` a one-word item drops every document with that word; ``least_words`` keeps
    such items out. Where they are, and in which documents, ``contained_items`` tells.
    """
    telling = items.where(F.size(words(F.col(f"`{item_text}`"))) >= least_words)
    found = contained_items(frame, telling, text=text, item_text=item_text, **names).select("node").distinct()
    rows = frame.select(
        F.struct(*[f"`{name}`" for name in frame.columns]).alias("_row"),
        F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("node"),
    )
    return rows.join(found, "node", "left_anti").select("_row.*")


def op7_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items inside the documents."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contained_items(documents_table(spark, sf_dir), items, short_inside=True).select(
        F.col("id").alias("doc_id"), "item_id", "item_runs", "shared_runs"
    )


CONTAINMENT_SQL = rf"""
WITH texts AS (
  SELECT 'doc' AS kind, row_number() OVER () AS row_id, doc_id AS id, coalesce(text, '') AS text FROM documents
  UNION ALL
  SELECT 'item', row_number() OVER (), item_id, coalesce(text, '') FROM benchmark
), split AS (
  SELECT kind, row_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS parts FROM texts
), tokens AS (
  SELECT kind, row_id, unnest(parts) AS w1, unnest(generate_series(1, len(parts))) AS pos FROM split WHERE len(parts) >= 1
), grams AS (
  SELECT kind, row_id, w1, w1 || ' ' || lead(w1) OVER w AS g2,
         w1 || ' ' || lead(w1) OVER w || ' ' || lead(w1, 2) OVER w AS g3,
         w1 || ' ' || lead(w1) OVER w || ' ' || lead(w1, 2) OVER w || ' ' || lead(w1, 3) OVER w AS g4,
         w1 || ' ' || lead(w1) OVER w || ' ' || lead(w1, 2) OVER w || ' ' || lead(w1, 3) OVER w || ' ' ||
         lead(w1, 4) OVER w AS g5
  FROM tokens WINDOW w AS (PARTITION BY kind, row_id ORDER BY pos)
), items AS (
  SELECT row_id, run, count(*) OVER (PARTITION BY row_id) AS size FROM (
    SELECT DISTINCT row_id, g5 AS run FROM grams WHERE kind = 'item' AND g5 IS NOT NULL
    UNION ALL SELECT row_id, array_to_string(parts, ' ') FROM split WHERE kind = 'item' AND len(parts) BETWEEN 1 AND 4)
), runs AS (
  -- An item of fewer than five words is one run of its own length.
  SELECT row_id, unnest([w1, g2, g3, g4, g5]) AS run FROM grams WHERE kind = 'doc'
), met AS (
  SELECT d.row_id AS doc_row, i.row_id AS item_row, any_value(i.size) AS item_runs, count(*) AS shared_runs
  FROM (SELECT DISTINCT row_id, run FROM runs WHERE run IN (SELECT run FROM items)) d JOIN items i ON d.run = i.run
  GROUP BY d.row_id, i.row_id
)
SELECT d.id AS doc_id, i.id AS item_id, CAST(met.item_runs AS BIGINT) AS item_runs,
       CAST(met.shared_runs AS BIGINT) AS shared_runs
FROM met JOIN texts d ON d.kind = 'doc' AND d.row_id = met.doc_row
JOIN texts i ON i.kind = 'item' AND i.row_id = met.item_row
WHERE 100 * met.shared_runs >= {CONTAINMENT_PERCENT} * met.item_runs
"""
