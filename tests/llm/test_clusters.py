"""Centroid clustering against its DuckDB twin and a plain k-means in Python integers."""

import hashlib
import math

import duck
import numpy as np
import pyarrow.parquet as pq
import small

from panelift.llm import clusters
from panelift.llm.queries import ORACLES, QUERIES


def plain_kmeans(rows, k=clusters.CLUSTERS, rounds=clusters.ROUNDS, dimension=clusters.DIMENSION):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) by the contract, all pairs compared."""
    kept = [
        (i, [math.floor(256 * float(x)) for x in e])
        for i, e in rows
        if i is not None and e is not None and len(e) == dimension and all(x is not None and math.isfinite(x) for x in e)
    ]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in first]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            j = min(range(len(d)), key=lambda j: (d[j], j))
            out.append((j, d[j]))
        return out

    for _ in range(rounds):
        got = assign()
        for j in range(len(centroids)):
            members = [kept[i][1] for i, (c, _) in enumerate(got) if c == j]
            if members:
                centroids[j] = [sum(x) // len(members) for x in zip(*members)]
    got = assign()
    per = {}
    for c, d in got:
        per[c] = per.get(c, 0) + d
    total = sum(per.values())
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, c, d, per[c], total, sha[c]) for (i, _), (c, d) in zip(kept, got))


def awkward_vectors(rng, n=300, dimension=64):
    rows = [(i, rng.normal(size=dimension).round(3).tolist()) for i in range(n)]
    hot = rng.normal(size=dimension).round(3).tolist()
    rows += [(1000 + i, hot) for i in range(n // 2)]  # a third of all rows are one vector
    rows += [(5, rows[5][1]), (5, rows[5][1])]  # repeated rows
    rows += [(2000, None), (2001, [1.0] * 63), (2002, [1.0] * 63 + [None]), (2003, [float("nan")] + [0.0] * 63),
             (2004, [float("inf")] + [0.0] * 63), (2005, []), (None, [1.0] * 64)]
    return rows


def spark_rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_twin_and_plain_kmeans_agree(spark, tmp_path):
    folder = small.write(str(tmp_path), embeddings=[(*r, 1) for r in awkward_vectors(np.random.default_rng(3))])
    got = QUERIES["op13_centroid_clustering"](spark, folder)
    assert duck.compare(got, duck.connect(folder), ORACLES["op13_centroid_clustering"]) == []
    stored = pq.read_table(f"{folder}/embeddings.parquet").to_pydict()
    assert spark_rows(got) == plain_kmeans(list(zip(stored["vec_id"], stored["embedding"])))


def test_fewer_vectors_than_centroids_and_ties(spark):
    rows = [(i, [float(i % 3)] * 64) for i in range(12)]  # four copies of three vectors: every distance ties
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = spark_rows(clusters.kmeans(clusters.kept_vectors(frame)).drop("n_exact"))
    assert got == plain_kmeans(rows)
    assert {r[2] for r in got} == {0}


def test_huge_components_stay_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=64) * 1e9).round().tolist()) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = spark_rows(clusters.kmeans(clusters.kept_vectors(frame)).drop("n_exact"))
    want = plain_kmeans(rows)
    assert [r[:2] for r in found] == [r[:2] for r in want]
    assert [r[5] for r in found] == [r[5] for r in want]
    assert all(f[2] == (w[2] if w[2] < 1 << 63 else None) for f, w in zip(found, want))


def test_empty_table(spark, empty):
    assert QUERIES["op13_centroid_clustering"](spark, empty).collect() == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (400, 64))
    centroids = rng.integers(-300, 300, (40, 64))
    simplex = clusters.Simplex(clusters._spread(centroids, clusters.PIVOTS))
    a, b = simplex.apex(x), simplex.apex(centroids)
    true = np.sqrt(((x[:, None, :] - centroids[None]) ** 2).sum(2))
    head = ((a[:, None, :-1] - b[None, :, :-1]) ** 2).sum(2)
    lower = np.sqrt(head + (a[:, None, -1] - b[None, :, -1]) ** 2)
    upper = np.sqrt(head + (a[:, None, -1] + b[None, :, -1]) ** 2)
    assert (lower <= true + 1e-6).all() and (true <= upper + 1e-6).all()
    cluster, distance, exact = clusters.nearest(x, a, centroids, b)
    d2 = (true**2).round().astype(np.int64)
    assert (cluster == d2.argmin(1)).all() and (distance == d2.min(1)).all()
    assert exact.mean() < 40
