"""Exact top-k inner products, pruned by segment means and deviations from coarse to fine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelift.llm.catalog import query, table

#: Segments per resolution (those beyond the dimension are skipped).
RESOLUTIONS = (1, 4, 16)
QUERY_BLOCK, ROW_BLOCK = 1024, 4096


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row: sqrt(length) * mean, then sqrt(length) * deviation, of each segment.

    For two rows q and c the dot product of their statistics is never below q . c: within a segment,
    sum(q c) = length * (mean_q mean_c + covariance), and the covariance is at most the product of the
    deviations. |q|^2 + |c|^2 - 2 times it is the lower bound of their squared distance.
    """
    means, deviations = [], []
    for part in np.array_split(x, segments, axis=1):
        root = np.sqrt(part.shape[1])
        means.append(part.mean(1) * root)
        deviations.append(part.std(1) * root)
    return np.column_stack(means + deviations)


class _Best:
    """The k best (score, id) so far of each query of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.levels = [s for s in RESOLUTIONS if s <= max(1, vectors.shape[1])]
        self.statistics = [segment_statistics(vectors, s) for s in self.levels]
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]

    def _merge(self, q: int, ids: np.ndarray, scores: np.ndarray) -> float:
        """Keeps the k best; returns the score that others must reach."""
        have_ids, have = self.found[q]
        ids, scores = np.concatenate([have_ids, ids]), np.concatenate([have, scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.found[q] = ids[order], scores[order]
        return float(scores[order[-1]]) if len(order) == self.k else -np.inf

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        bounds = [segment_statistics(vectors, s) for s in self.levels]
        coarse = self.statistics[0] @ bounds[0].T
        for q in range(len(self.ids)):
            reach = self._merge(q, ids[:0], ids[:0])
            left = np.flatnonzero(ids != self.ids[q])
            if reach == -np.inf and len(left) > self.k:  # the likeliest rows set the first limit
                at = np.argpartition(-coarse[q][left], self.k)[: self.k]
                reach = self._merge(q, ids[left[at]], self._exact(q, vectors[left[at]]))
                left = np.delete(left, at)
            left = left[coarse[q][left] >= self._slack(reach)]
            for mine, theirs in zip(self.statistics[1:], bounds[1:]):
                left = left[theirs[left] @ mine[q] >= self._slack(reach)]
            if len(left):
                self._merge(q, ids[left], self._exact(q, vectors[left]))

    @staticmethod
    def _slack(reach: float) -> float:
        return reach - 1e-6 * (abs(reach) + 1) if np.isfinite(reach) else reach

    def _exact(self, q: int, rows: np.ndarray) -> np.ndarray:
        mine = self.vectors[q]
        if np.abs(rows).max(initial=0) * np.abs(mine).max(initial=0) * max(1, len(mine)) < 2**52:
            return np.rint(rows.astype(float) @ mine.astype(float)).astype(np.int64)
        return (rows * mine).sum(1)

    def rows(self) -> pa.RecordBatch:
        n = [len(x[0]) for x in self.found]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(self.ids, n), pa.int64()),
                pa.array(np.concatenate([x[0] for x in self.found]) if n else [], pa.int64()),
                pa.array(np.concatenate([x[1] for x in self.found]) if n else [], pa.int64()),
            ],
            names=["query_id", "vec_id", "score"],
        )


def _block(values: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    rows = values.values
    ids = rows.field("id").to_numpy()
    flat = rows.field("v").flatten().to_numpy()
    return ids, flat.reshape(len(ids), -1)


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v, n): floor(256 * x) per component. Null, empty or non-finite vectors and null ids take no part.

    Rows that share an id count once (the smallest vector).
    """
    bad = F.exists(F.col("v"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & ~bad)
    ints = rows.select("id", F.transform("v", lambda x: F.floor(x * 256)).cast("array<long>").alias("v"))
    return ints.groupBy("id").agg(F.min("v").alias("v")).select("id", "v", F.size("v").alias("n"))


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products with ``rows`` of other ids.

    Both frames are (id, v, n) as ``integer_vectors`` gives; vectors of different length do not meet.
    Ties go to the smaller id. Queries and rows are dealt into blocks of bounded size; every pair of
    blocks meets in a join on both block numbers, and only the k best of a pair of blocks leave it.
    """
    total, asked = rows.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-total // ROW_BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    pack = F.collect_list(F.struct("id", "v"))
    dealt = lambda df, n: df.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(n)))
    left = dealt(rows, row_blocks).groupBy("n", F.col("_b").alias("row_block")).agg(pack.alias("rows"))
    right = dealt(queries, query_blocks).groupBy("n", F.col("_b").alias("query_block")).agg(pack.alias("queries"))
    left = left.withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    right = right.withColumn("row_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))))
    met = left.hint("merge").join(right, ["n", "query_block", "row_block"]).select("rows", "queries")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                best = _Best(*_block(batch["queries"][i]), k)
                best.add(*_block(batch["rows"][i]))
                yield best.rows()

    found = met.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
r as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank, vec_id, score from s)
select * from r where rank <= 5
"""


@query("op9_exact_top_k", SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """The five best rows of every query (ids divisible by 50)."""
    rows = integer_vectors(table(spark, folder, "embeddings"))
    return top_k(rows.where("id % 50 = 0"), rows)
