"""Centroid clustering: k-means whose assignment step prunes centroids by n-simplex projection.

Every vector's exact distances to a few fixed pivots are computed once and stored with it. Those
distances place the vector as the apex of a simplex over the pivots: a point in n dimensions whose
distance to another apex is a lower bound of the true distance, and whose distance to the other apex
mirrored in the last coordinate is an upper bound. In each round the centroids get apexes too (k of
them, on the driver); a vector compares exactly, in integers, only with the centroids whose lower bound
does not exceed the smallest upper bound. Centroid sums are combined per batch before the shuffle, so a
cluster that holds a third of all vectors is one small row per batch, not a hot task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelift.llm.catalog import query, table
from panelift.session import spill

DIMENSION, CLUSTERS, ROUNDS = 64, 40, 5
#: Pivots of the projection: the first initial centroids that are affinely independent.
PIVOTS = 32
#: Beyond this magnitude of a scaled component, distances are summed as Python integers.
EXACT_INT64 = 1 << 26


def kept_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dimension: int = DIMENSION) -> DataFrame:
    """(vec_id, v): floor(256 * x) of each component, for vectors of exactly ``dimension`` finite components.

    Null vectors, vectors of another length, vectors with a null, NaN or infinite component and rows with
    a null id take no part. Repeated rows stay: each is a vector of its own.
    """
    bad = F.exists(F.col("x"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("x") == dimension) & ~bad)
    return rows.select("vec_id", F.transform("x", lambda x: F.floor(x * 256)).cast("array<long>").alias("v"))


class Simplex:
    """Base simplex of the pivots; ``apex`` places points by their distances to them."""

    def __init__(self, pivots: np.ndarray):
        chosen, base = [], []
        for p in pivots:
            trial = chosen + [p]
            if len(trial) == 1:
                chosen, base = trial, [np.zeros(0)]
                continue
            d = np.sqrt(np.array([_squared(p, q) for q in chosen], float))
            point = self._place(base, d)
            if point[-1] > 1e-6 * (1 + np.abs(point).max()):  # affinely independent of those before
                chosen.append(p)
                base.append(point)
        self.pivots = np.array(chosen, dtype=np.int64).reshape(len(chosen), -1)
        n = max(1, len(base))
        self.base = np.zeros((n, n))
        for i, point in enumerate(base):
            self.base[i, : len(point)] = point

    @staticmethod
    def _place(base: list[np.ndarray], d: np.ndarray) -> np.ndarray:
        """Apex in len(d) dimensions of a point at distances ``d`` from the points of ``base``."""
        n = len(d)
        x = np.zeros(n)
        for k in range(1, n):
            sigma = np.zeros(n)
            sigma[: len(base[k])] = base[k]
            x[k - 1] = ((d[0] ** 2 - d[k] ** 2 + sigma @ sigma) / 2 - x[: k - 1] @ sigma[: k - 1]) / sigma[k - 1]
        x[n - 1] = np.sqrt(max(0.0, d[0] ** 2 - x[: n - 1] @ x[: n - 1]))
        return x

    def apex(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, n) apexes of integer vectors, from their exact distances to the pivots."""
        n = len(self.pivots)
        d2 = np.stack([_squared_rows(vectors, p) for p in self.pivots], 1).astype(float) if n else np.zeros((len(vectors), 0))
        x = np.zeros((len(vectors), max(1, n)))
        for k in range(1, n):
            sigma = self.base[k]
            x[:, k - 1] = ((d2[:, 0] - d2[:, k] + sigma @ sigma) / 2 - x[:, : k - 1] @ sigma[: k - 1]) / sigma[k - 1]
        if n:
            x[:, n - 1] = np.sqrt(np.maximum(0.0, d2[:, 0] - (x[:, : n - 1] ** 2).sum(1)))
        return x


def _squared(a: np.ndarray, b: np.ndarray) -> int:
    diff = a.astype(object) - b.astype(object)
    return int((diff * diff).sum())


def _squared_rows(rows: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to ``c``: int64 where that cannot overflow, else Python integers."""
    if len(rows) == 0 or max(np.abs(rows).max(), np.abs(c).max()) < EXACT_INT64:
        diff = rows - c
        return np.einsum("ij,ij->i", diff, diff)
    diff = rows.astype(object) - c.astype(object)
    return (diff * diff).sum(1)


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, centroid_apexes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, exact comparisons) of each vector; ties go to the smaller cluster.

    A centroid is compared exactly only if the lower bound of its distance is at most the least upper
    bound over all centroids (with a margin for rounding), so the answer is that of comparing all.
    """
    rows, k = len(vectors), len(centroids)
    head = apexes[:, None, :-1] - centroid_apexes[None, :, :-1]
    flat = (head**2).sum(2)
    lower = np.sqrt(flat + (apexes[:, None, -1] - centroid_apexes[None, :, -1]) ** 2)
    upper = np.sqrt(flat + (apexes[:, None, -1] + centroid_apexes[None, :, -1]) ** 2)
    reach = upper.min(1, initial=np.inf)
    candidates = lower <= reach[:, None] * (1 + 1e-6) + 1e-2
    r, c = np.nonzero(candidates)
    big = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) >= EXACT_INT64
    if big:
        distances = np.full((rows, k), None, dtype=object)
        for i, j in zip(r, c):
            distances[i, j] = _squared(vectors[i], centroids[j])
        cluster = np.array([min((d, j) for j, d in enumerate(row) if d is not None)[1] for row in distances], np.int64)
        distance = np.array([distances[i, j] for i, j in enumerate(cluster)], dtype=object)
    else:
        distances = np.full((rows, k), np.iinfo(np.int64).max, np.int64)
        diff = vectors[r] - centroids[c]
        distances[r, c] = np.einsum("ij,ij->i", diff, diff)
        cluster = distances.argmin(1)  # the first of equal minima: the smaller cluster number
        distance = distances[np.arange(rows), cluster]
    return cluster, distance, candidates.sum(1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), width)


def _apexes(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch["apex"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _long(values: np.ndarray) -> pa.Array:
    """Longs; a Python integer beyond the long range (only from huge components) becomes null."""
    if values.dtype != object:
        return pa.array(values, pa.int64())
    return pa.array([int(x) if -(1 << 63) <= x < (1 << 63) else None for x in values], pa.int64())


def kmeans(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, pivots: int = PIVOTS, dimension: int = DIMENSION) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_exact) of (vec_id, v) vectors.

    Centroids start as the k vectors with the smallest lowercase-hex sha256 of ``2:<vec_id>`` (equal hashes,
    from repeated ids, by vector), in that order; fewer vectors give fewer centroids. Each round assigns
    every vector to the nearest centroid (squared distance, ties to the smaller number) and moves every
    centroid that got vectors to floor(sum / count) of each component; then vectors are assigned once
    more. ``n_exact`` counts the centroids a vector was compared with exactly in that last assignment.
    Distances are exact integers; one beyond the long range (components above about 2**28 after scaling) is null,
    and the inertias leave it out.
    Only the k centroids pass through the driver. An empty input gives an empty result.
    """
    spark = vectors.sparkSession
    first = (
        vectors.select(F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
        .orderBy("h", "v")
        .limit(k)
        .collect()
    )
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_exact int"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([row["v"] for row in first], np.int64).reshape(len(first), dimension)
    simplex = Simplex(_spread(centroids, pivots))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch["v"], dimension)
            apex = simplex.apex(v)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["v"], pa.ListArray.from_arrays(pa.array(np.arange(0, apex.size + 1, apex.shape[1]), pa.int32()), pa.array(apex.ravel(), pa.float64()))],
                names=["vec_id", "v", "apex"],
            )

    width = max(1, len(simplex.pivots))
    placed = spill(
        vectors.select("vec_id", "v").mapInArrow(place, "vec_id long, v array<long>, apex array<double>"),
        "apexes",
    )

    def sums(current: np.ndarray):
        centre_apex = simplex.apex(current)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _matrix(batch["v"], dimension)
                cluster, _, _ = nearest(v, _apexes(batch, width), current, centre_apex)
                exact = v.astype(object) if np.abs(v).max(initial=0) >= EXACT_INT64 else v
                names = np.unique(cluster)
                totals = [[str(int(t)) for t in exact[cluster == c].sum(0)] for c in names]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int32()), pa.array([int((cluster == c).sum()) for c in names], pa.int64()), pa.array(totals, pa.list_(pa.string()))],
                    names=["cluster", "n", "total"],
                )

        return step

    for _ in range(rounds):
        partial = placed.mapInArrow(sums(centroids), "cluster int, n long, total array<string>")
        parts = partial.select("cluster", "n", F.posexplode("total").alias("i", "t"))
        merged = parts.groupBy("cluster", "i").agg(
            F.sum(F.col("t").cast("decimal(38,0)")).alias("s"), F.sum("n").cast("decimal(38,0)").alias("n")
        )
        floor = ((F.col("s") - F.pmod(F.col("s"), F.col("n"))) / F.col("n")).cast("decimal(38,0)").cast("string")
        moved = merged.select("cluster", "i", floor.alias("c")).collect()  # k x dimension values
        centroids = centroids.copy()
        for row in moved:
            centroids[row["cluster"], row["i"]] = int(row["c"])

    centre_apex = simplex.apex(centroids)
    current = centroids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch["v"], dimension)
            cluster, distance, exact = nearest(v, _apexes(batch, width), current, centre_apex)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], pa.array(cluster, pa.int32()), _long(distance), pa.array(exact, pa.int32())],
                names=["vec_id", "cluster", "distance", "n_exact"],
            )

    assigned = spill(placed.mapInArrow(assign, "vec_id long, cluster int, distance long, n_exact int"), "assigned")
    digests = [(i, hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()) for i, c in enumerate(centroids)]
    per_cluster = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string").join(per_cluster, "cluster", "left")
    named = named.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0))))
    return assigned.join(F.broadcast(named), "cluster", "left").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_exact"
    )


def _spread(centroids: np.ndarray, pivots: int) -> np.ndarray:
    """``pivots`` of the initial centroids, each the farthest from those already taken (first: number 0)."""
    taken = [0]
    far = _squared_rows(centroids, centroids[0]).astype(float)
    while len(taken) < min(pivots, len(centroids)):
        nxt = int(np.argmax(far))
        if far[nxt] <= 0:
            break
        taken.append(nxt)
        far = np.minimum(far, _squared_rows(centroids, centroids[nxt]).astype(float))
    return centroids[taken]


def _sql(k: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION) -> str:
    parts = [
        f"""with v as materialized (
  select row_number() over (order by vec_id, x) as rid, vec_id, x as v from (
    select vec_id, list_transform(embedding, lambda e: floor(256 * e::double)::bigint) as x from embeddings
    where vec_id is not null and len(embedding) = {dimension}
      and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0)),
c0 as materialized (
  select (row_number() over (order by sha256('2:' || vec_id), v) - 1)::integer as cluster, v as c from v
  qualify row_number() over (order by sha256('2:' || vec_id), v) <= {k})"""
    ]
    dist = "(list_dot_product(v.v::double[], v.v::double[]) + list_dot_product(c.c::double[], c.c::double[]) - 2 * list_dot_product(v.v::double[], c.c::double[]))::bigint"
    for r in range(1, rounds + 2):
        parts.append(
            f"""a{r} as materialized (
  select rid, vec_id, v, cluster, d from (
    select v.rid, v.vec_id, v.v, c.cluster, {dist} as d,
      row_number() over (partition by v.rid order by {dist}, c.cluster) as o
    from v join c{r - 1} c on true) where o = 1)"""
        )
        if r <= rounds:
            parts.append(
                f"""s{r} as (
  select cluster, i, sum(x::hugeint) as s, count(*) as n from (
    select cluster, unnest(generate_series(1, {dimension})) as i, unnest(v) as x from a{r}) group by cluster, i),
c{r} as materialized (
  select c.cluster, coalesce(u.c, c.c) as c from c{r - 1} c left join (
    select cluster, list(((s - (((s % n) + n) % n)) // n)::bigint order by i) as c from s{r} group by cluster) u
  on c.cluster = u.cluster)"""
            )
    last = rounds + 1
    body = ",\n".join(parts)
    return f"""{body}
select a.vec_id, a.cluster, a.d as distance,
  (sum(a.d) over (partition by a.cluster))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia,
  sha256(array_to_string(c.c, ',')) as centroid_sha256
from a{last} a join c{rounds} c on a.cluster = c.cluster
"""


SQL = _sql()


@query("op13_centroid_clustering", SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Every 64-component embedding with its cluster after five rounds of k-means from 40 hashed seeds."""
    found = kmeans(kept_vectors(table(spark, folder, "embeddings")))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
