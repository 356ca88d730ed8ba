"""Toxicity severity by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(threshold_k - w.x), with one weight vector for all thresholds. The features
are the presence of hashed words. The weights are fitted on a bounded sample of labelled rows
for the words whose share differs clearly between toxic and other rows, and every text is scored by
Spark tasks that share the fixed-size weight vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.text import documents_table, steps, text_bytes, word_hashes, word_spans

FEATURE_BITS = 18
GRADES = 4
# The only bound on training rows: labelled rows in the order of a hash of their id.
SAMPLE_ROWS = 12_000
LEAST_ROWS = 5
PENALTY = 0.2
ITERATIONS = 300
STEP = 0.1
SCREEN_ERRORS = 4.0
# Probability of a grade above 0 from which a text is called toxic.
TOXIC_FROM = 0.4
SIGNAL_ODDS = 8.0

_SEPARATOR = np.ones(256, dtype=bool)
_SEPARATOR[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
for _first, _last in ((b"0", b"9"), (b"a", b"z"), (b"A", b"Z")):
    _SEPARATOR[_first[0] : _last[0] + 1] = False
_LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray


def word_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Owner and feature of every word: letters, digits and non-ASCII, ASCII letters in lower case."""
    data, offsets = text_bytes(column)
    data = _LOWER[data]
    starts, ends, owner = word_spans(data, offsets, _SEPARATOR)
    return owner, (word_hashes(data, starts, ends) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def _distinct(owner: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    packed = np.unique((owner.astype(np.int64) << FEATURE_BITS) | feature)
    return packed >> FEATURE_BITS, packed & ((1 << FEATURE_BITS) - 1)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch, "text"):
            owner, feature = _distinct(*word_features(part.column("text")))
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=part.num_rows))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("toxic"), lists], ["toxic", "features"])


def severity_grades(toxic: np.ndarray, owner: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """Grade 0 for rows that are not toxic; for toxic ones the number of their telling words, 1 to 3.

    The labels say only whether a text is toxic. A word is telling if the odds of its presence are
    at least eight times as high in toxic rows and it occurs in at least five of them.
    """
    size = 1 << FEATURE_BITS
    bad = np.bincount(feature[toxic[owner] == 1], minlength=size)
    good = np.bincount(feature[toxic[owner] == 0], minlength=size)
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((toxic == 0).sum()))
    odds = ((bad + 0.5) / (n_bad - bad + 0.5)) / ((good + 0.5) / (n_good - good + 0.5))
    telling = (odds >= SIGNAL_ODDS) & (bad >= LEAST_ROWS)
    kinds = np.bincount(owner[telling[feature]], minlength=len(toxic))
    return np.where(toxic == 1, np.clip(kinds, 1, GRADES - 1), 0)


def _sigmoid(value: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * value))


def _screened(grades: np.ndarray, owner: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """Features whose share differs between graded and other rows by several standard errors."""
    size, rows = 1 << FEATURE_BITS, len(grades)
    marked = grades > 0
    n_bad, n_good = max(1, int(marked.sum())), max(1, int((~marked).sum()))
    bad = np.bincount(feature[marked[owner]], minlength=size)
    seen = np.bincount(feature, minlength=size)
    share = seen / rows
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_bad + 1 / n_good))
    apart = np.abs(bad / n_bad - (seen - bad) / n_good) / error
    return (seen >= LEAST_ROWS) & (apart >= SCREEN_ERRORS)


def ordinal_slopes(free: np.ndarray, grades: np.ndarray, owner: np.ndarray, feature: np.ndarray) -> tuple[float, np.ndarray]:
    """Penalised mean negative log-likelihood of the grades, and its gradient.

    ``free`` holds the weights, the first threshold and the logarithms of the gaps between thresholds;
    ``owner`` and ``feature`` list the features present in each row.
    """
    rows, used = len(grades), len(free) - (GRADES - 1)
    own, gaps = free[:used], np.exp(free[used + 1 :])
    edges = np.concatenate([[-np.inf], free[used] + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
    score = np.bincount(owner, weights=own[feature], minlength=rows)
    upper, lower = _sigmoid(edges[grades + 1] - score), _sigmoid(edges[grades] - score)
    mass = np.maximum(upper - lower, 1e-12)
    up, low = upper * (1 - upper) / mass, lower * (1 - lower) / mass
    pull = np.array([up[grades == k].sum() - low[grades == k + 1].sum() for k in range(GRADES - 1)])
    slope_w = np.bincount(feature, weights=(up - low)[owner], minlength=used) + PENALTY * own
    later = np.cumsum(pull[::-1])[::-1]
    loss = (PENALTY * float(own @ own) / 2 - float(np.log(mass).sum())) / rows
    return loss, np.concatenate([slope_w, -later[:1], -later[1:] * gaps]) / rows


def fit_ordinal(grades: np.ndarray, owner: np.ndarray, feature: np.ndarray, iterations: int = ITERATIONS) -> Model:
    """Cumulative-link model with a ridge penalty, fitted by Adam steps.

    The first threshold and the logarithms of the gaps between thresholds are free, so the
    thresholds stay in order. Without features they are the smoothed shares of the grades.
    """
    counts = np.bincount(grades, minlength=GRADES) + 0.5
    below = np.cumsum(counts)[:-1] / counts.sum()
    start = np.log(below / (1 - below))
    weights = np.zeros(1 << FEATURE_BITS)
    if not len(owner):
        return Model(weights, start)
    used = np.flatnonzero(_screened(grades, owner, feature))
    kept = np.isin(feature, used)
    owner, feature = owner[kept], np.searchsorted(used, feature[kept])
    free = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    first, second = np.zeros_like(free), np.zeros_like(free)
    for turn in range(1, iterations + 1):
        _, slope = ordinal_slopes(free, grades, owner, feature)
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        free = free - STEP * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-6)
    weights[used] = free[: len(used)]
    gaps = np.exp(free[len(used) + 1 :])
    return Model(weights, free[len(used)] + np.concatenate([[0.0], np.cumsum(gaps)]))


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit the model on at most ``sample_rows`` labelled rows, chosen by a hash of their id.

    Rows whose label or id is null are left out; of repeated ids the highest label and the smallest
    text count, so that no table gives more rows than that.
    """
    chosen = (
        labels.where("toxic is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    labelled = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = labelled.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text")
    sample = rows.mapInArrow(_feature_batches, "toxic int, features array<int>").toArrow()
    toxic = sample.column("toxic").to_numpy().astype(np.int64)
    lists = sample.column("features").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    feature = lists.flatten().to_numpy().astype(np.int64)
    return fit_ordinal(severity_grades(toxic, owner, feature), owner, feature)


def score_documents(frame: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, severity, grade, toxic): expected grade, most likely grade, P(grade > 0) >= 0.4.

    Null, empty and blank texts get the score of a text without features. Ids may be null or
    repeated; each row is scored alone. Other columns are ignored.
    """
    session = frame.sparkSession
    shared = session.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = shared.value
        for batch in batches:
            for part in steps(batch, "text"):
                owner, feature = word_features(part.column("text"))
                heavy = weights[feature] != 0
                owner, feature = _distinct(owner[heavy], feature[heavy])
                score = np.bincount(owner, weights=weights[feature], minlength=part.num_rows)
                above = 1.0 - _sigmoid(thresholds[None, :] - score[:, None])
                edges = np.concatenate([np.ones((len(score), 1)), above, np.zeros((len(score), 1))], axis=1)
                grade = np.argmax(edges[:, :-1] - edges[:, 1:], axis=1).astype(np.int32)
                columns = [part.column("id"), above.sum(axis=1), grade, above[:, 0] >= TOXIC_FROM]
                yield pa.RecordBatch.from_arrays(
                    [columns[0], *[pa.array(values) for values in columns[1:]]], ["id", "severity", "grade", "toxic"]
                )

    rows = frame.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "id bigint, severity double, grade int, toxic boolean")


def op5_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document, from a model fitted on the labelled ones."""
    documents = documents_table(spark, sf_dir)
    model = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(documents, model).withColumnRenamed("id", "doc_id")
