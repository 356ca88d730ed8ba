import hashlib
import math

import numpy as np
import pytest

from sessionloom.llm import clustering

SCHEMA = "vec_id bigint, embedding array<float>, distance string, dots int"


def plain_rule(rows, clusters, rounds, dimensions):
    """Clustering with whole numbers of any size, one vector at a time."""
    kept = []
    for vec_id, vector in rows:
        if vector is None or len(vector) != dimensions or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector]))
    digest = lambda vec_id: hashlib.sha256(f"2:{'' if vec_id is None else vec_id}".encode()).hexdigest()
    centroids = [vector for _, vector in sorted(((digest(a), b) for a, b in kept))[:clusters]]

    def assign():
        distances = [[sum((x - y) ** 2 for x, y in zip(vector, c)) for c in centroids] for _, vector in kept]
        return [(min(range(len(row)), key=lambda at: (row[at], at)), min(row)) for row in distances]

    for _ in range(rounds):
        own = assign()
        for at in range(len(centroids)):
            members = [vector for (_, vector), (cluster, _) in zip(kept, own) if cluster == at]
            if members:
                centroids[at] = [sum(part) // len(members) for part in zip(*members)]
    own = assign()
    inertia = [sum(d for c, d in own if c == at) for at in range(len(centroids))]
    return sorted(
        (str(vec_id), cluster, distance, inertia[cluster], sum(inertia), tuple(centroids[cluster]))
        for (vec_id, _), (cluster, distance) in zip(kept, own)
    )


def compare(spark, rows, clusters, rounds, dimensions):
    frame = spark.createDataFrame([(a, b, "d", 1) for a, b in rows], SCHEMA)
    found = clustering.cluster_vectors(frame, clusters=clusters, rounds=rounds, dimensions=dimensions)
    got = sorted((str(r.id), r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in found.collect())
    assert got == plain_rule(rows, clusters, rounds, dimensions)
    return got


def test_equals_the_plain_rule(spark):
    draw = np.random.default_rng(3)
    rows = [(at, [float(x) for x in draw.normal(0, 1, 6)]) for at in range(300)]
    compare(spark, rows, 7, 5, 6)


def test_ties_copies_and_one_hot_vector(spark):
    # Half of all rows are one vector; others lie halfway between two starts; equal starts stay empty.
    rows = [(at, [1.0, 0.0]) for at in range(200)] + [(200 + at, [float(at % 3), 0.0]) for at in range(100)]
    rows += [(None, [5.0, 5.0]), (None, [5.0, 5.0]), (3, [1.0, 0.0]), (3, [-4.0, 2.0])]
    got = compare(spark, rows, 12, 3, 2)
    assert len(got) == len(rows)


def test_vectors_left_out(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [1.0], [1.0, None], [nan, 1.0], [1.0, -inf], [1.0, 2.0, 3.0]]
    compare(spark, [(at, vector) for at, vector in enumerate(odd)] + [(50, [-0.001, 0.999]), (51, [2.0, 3.0])], 4, 2, 2)
    large = spark.createDataFrame([(1, [1e30, 0.0], "d", 1), (2, [524288.0, -524288.0], "d", 1)], SCHEMA)
    found = clustering.cluster_vectors(large, clusters=3, dimensions=2).collect()
    assert [row.id for row in found] == [2]


def test_empty_table(spark):
    found = clustering.cluster_vectors(spark.createDataFrame([], SCHEMA))
    assert found.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"] and found.count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_dots_change_by_the_changed_components(seed):
    draw = np.random.default_rng(seed)
    parts, before = draw.integers(-300, 300, (50, 8)), draw.integers(-300, 300, (5, 8))
    after = before.copy()
    after[1, [2, 7]] += [5, -9]
    after[4] = 0
    changes = [(np.flatnonzero(row), row[row != 0]) for row in after - before]
    assert [len(places) for places, _ in changes][:4] == [0, 2, 0, 0]
    assert (clustering.changed_dots(parts, parts @ before.T, changes) == parts @ after.T).all()
    cluster, distance = clustering.nearest(parts, parts @ after.T, after)
    exact = ((parts[:, None, :] - after) ** 2).sum(axis=2)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()


def test_former_tables_are_removed(spark, tmp_path, monkeypatch):
    folders = iter(tmp_path / str(at) for at in range(100))
    monkeypatch.setattr(clustering, "work_dir", lambda spark, purpose: str(next(folders)))
    rows = [(at, [float(at), 1.0], "d", 1) for at in range(20)]
    clustering.cluster_vectors(spark.createDataFrame(rows, SCHEMA), clusters=3, dimensions=2).collect()
    assert len(list(tmp_path.iterdir())) == 1
