"""Centroid clustering with an incremental distance matrix, in exact whole numbers.

Vectors are scaled to whole numbers, and the dot products of each vector with all centroids are
kept in a written table next to the vector. When centroids move, a dot product changes only by the
components in which its centroid changed: those changes, a table of bounded size, are sent to the
tasks, the dot products are updated and the nearest centroid is recomputed from them. Centroid sums
are partial per task. Each round's table is written to the shared folder and the one before it is
removed, so a lost executor costs a re-read of the last round and the disk holds two rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm.text import removed, written
from sessionloom.session import work_dir

CLUSTERS = 40
ROUNDS = 5
DIMENSIONS = 64
SCALE = 256
START_PREFIX = "2:"
# Larger whole numbers could make a squared distance overflow 64 bits: 64 * (2 * 2^27)^2 = 2^62.
LARGEST = 1 << 27

STATE_TYPE = (
    T.StructType()
    .add("id", T.LongType())
    .add("parts", T.ArrayType(T.IntegerType()))
    .add("dots", T.ArrayType(T.LongType()))
    .add("cluster", T.IntegerType())
    .add("distance", T.LongType())
)


def whole_vectors(frame: DataFrame, vec_id: str, embedding: str, dimensions: int) -> DataFrame:
    """Rows (id, parts): vectors of the right length without null or non-finite components, scaled.

    Also left out are components beyond 2^27 after scaling, whose distances could not be exact.
    """

    def sound(value: Column) -> Column:
        scaled = F.floor(value.cast("double") * SCALE)
        return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")) & (F.abs(scaled) <= LARGEST)

    vectors = frame.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{embedding}`").alias("values"))
    kept = vectors.where((F.size("values") == dimensions) & F.forall("values", sound))
    whole = F.transform("values", lambda value: F.floor(value.cast("double") * SCALE).cast("int"))
    return kept.select("id", whole.alias("parts"))


def first_centroids(vectors: DataFrame, clusters: int) -> np.ndarray:
    """The vectors with the smallest digests of their ids; of equal ids the smaller vector comes first."""
    digest = F.sha2(F.concat(F.lit(START_PREFIX), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(digest.alias("digest"), "parts").orderBy("digest", "parts").limit(clusters).collect()
    return np.array([row.parts for row in rows], dtype=np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), width)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel(), kind))


def changed_dots(parts: np.ndarray, dots: np.ndarray, changes: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Dot products after each centroid changed by the given components (places, amounts)."""
    for at, (places, amounts) in enumerate(changes):
        if len(places):
            dots[:, at] += parts[:, places] @ amounts
    return dots


def nearest(parts: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid, of equal distances the first, and its squared distance."""
    squares = (centroids * centroids).sum(axis=1) - 2 * dots
    cluster = squares.argmin(axis=1)
    own = (parts * parts).sum(axis=1)
    return cluster, own + squares[np.arange(len(parts)), cluster]


def _assigner(before: np.ndarray, after: np.ndarray):
    """Task function that moves the dot products from one set of centroids to the next and assigns."""
    changes = [(np.flatnonzero(row), row[row != 0]) for row in after - before]
    clusters, dimensions = after.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = _matrix(batch.column("parts"), dimensions)
            if "dots" in batch.schema.names:
                dots = _matrix(batch.column("dots"), clusters)
            else:
                dots = np.zeros((batch.num_rows, clusters), dtype=np.int64)
            dots = changed_dots(parts, dots, changes)
            cluster, distance = nearest(parts, dots, after)
            columns = [
                batch.column("id"),
                batch.column("parts"),
                _lists(dots, pa.int64()),
                pa.array(cluster.astype(np.int32)),
                pa.array(distance),
            ]
            yield pa.RecordBatch.from_arrays(columns, STATE_TYPE.names)

    return run


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each cluster; an empty cluster keeps its centroid."""
    sums = [F.sum(F.get("parts", F.lit(at)).cast("bigint")).alias(f"s{at}") for at in range(centroids.shape[1])]
    # One row per cluster reaches the driver.
    rows = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), *sums).collect()
    after = centroids.copy()
    for row in rows:
        after[row.cluster] = [row[f"s{at}"] // row.members for at in range(centroids.shape[1])]
    return after


def cluster_vectors(
    frame: DataFrame,
    *,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
) -> DataFrame:
    """Rows (id, cluster, distance, cluster_inertia, inertia, centroid), one per kept vector.

    Vectors that are null, of another length, or have a null, non-finite or (beyond 2^27 after
    scaling) too large component are left out. Repeated rows are vectors of their own; ids may be
    null (as a start they count as empty) or repeated. With fewer vectors than ``clusters`` every
    vector is a start; equal starts are kept, and the later one stays empty. An empty table gives an
    empty result. Other columns are ignored. ``centroid`` is the final centroid of the cluster.
    """
    spark = frame.sparkSession
    folder = work_dir(spark, "vectors")
    vectors = written(whole_vectors(frame, vec_id, embedding, dimensions), "vectors", folder=folder)
    centroids = first_centroids(vectors, clusters)
    if not len(centroids):
        return spark.createDataFrame(
            [], "id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>"
        )
    state, before = vectors, np.zeros_like(centroids)
    for turn in range(rounds + 1):
        former, folder = folder, work_dir(spark, "dots")
        state = written(state.mapInArrow(_assigner(before, centroids), STATE_TYPE), "dots", folder=folder)
        removed(spark, former)
        before = centroids
        if turn < rounds:
            centroids = moved_centroids(state, centroids)
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    totals = {row.cluster: int(row.inertia) for row in state.groupBy("cluster").agg(whole.alias("inertia")).collect()}
    summary = spark.createDataFrame(
        [(at, totals[at], sum(totals.values()), centroids[at].tolist()) for at in sorted(totals)],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>",
    )
    # One row per cluster, so the side that is sent to all tasks is bounded by ``clusters``.
    return state.select("id", "cluster", "distance").join(F.broadcast(summary), "cluster").select(
        "id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )


def centroid_digest(components: list[int]) -> str:
    return hashlib.sha256(",".join(str(value) for value in components).encode()).hexdigest()


def op13_incremental_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, exact distances and inertia of every embedding, and the digest of its centroid."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    return cluster_vectors(vectors).select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256")
    )


def _assign_sql(turn: int) -> str:
    return f"""
, a{turn} AS MATERIALIZED (
    SELECT nr, vec_id, v, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (
        SELECT k.nr, k.vec_id, k.v, c{turn}.c,
               list_sum([(k.v[i] - c{turn}.w[i]) * (k.v[i] - c{turn}.w[i]) for i in range(1, {DIMENSIONS + 1})])::BIGINT AS d
        FROM k, c{turn})
    GROUP BY nr, vec_id, v
)"""


def _move_sql(turn: int) -> str:
    return f"""
, m{turn} AS MATERIALIZED (
    SELECT cluster, list(mean ORDER BY i) AS w FROM (
        SELECT cluster, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS mean FROM (
            SELECT cluster, i, sum(v[i]) AS s, count(*) AS n
            FROM a{turn}, (SELECT unnest(range(1, {DIMENSIONS + 1})) AS i) GROUP BY cluster, i))
    GROUP BY cluster
), c{turn + 1} AS MATERIALIZED (
    SELECT c, coalesce(m{turn}.w, c{turn}.w) AS w FROM c{turn} LEFT JOIN m{turn} ON c = cluster
)"""


CLUSTERING_SQL = (
    f"""
WITH k AS MATERIALIZED (
    SELECT row_number() OVER () AS nr, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
    WHERE len(embedding) = {DIMENSIONS} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {DIMENSIONS}
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS w
    FROM (SELECT sha256('{START_PREFIX}' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM k ORDER BY h, v LIMIT {CLUSTERS})
)"""
    + "".join(_assign_sql(turn) + _move_sql(turn) for turn in range(ROUNDS))
    + _assign_sql(ROUNDS)
    + f"""
SELECT vec_id, a{ROUNDS}.cluster::INT AS cluster, distance,
       sum(distance) OVER (PARTITION BY a{ROUNDS}.cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON cluster = c
"""
)
