"""Near-duplicate join of word n-grams: MinHash LSH forest for candidates, exact Jaccard for links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelift.llm.catalog import query, table
from panelift.llm.components import connected_components
from panelift.llm.text import mix, shingles, slices
from panelift.session import spill

WORDS, SIMILARITY = 5, 0.8
#: Trees of the forest, longest prefix, and the part of links exactly at the threshold that must be met.
TREES, DEEPEST, RECALL = 24, 8, 0.99999
#: Texts of one block that are compared with each other.
BLOCK = 200


def prefix_depth(similarity: float, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL) -> int:
    """The longest prefix by which the forest still meets its recall.

    Two texts of Jaccard s share a prefix of length d in some of the sorted tries with probability
    1 - (1 - s^d)^trees. The prefix is shortened from ``deepest`` until that reaches ``recall`` for the
    least similar link; closer pairs are met with higher probability.
    """
    for depth in range(deepest, 1, -1):
        if 1 - (1 - similarity**depth) ** trees >= recall:
            return depth
    return 1


def _minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of every hash function (a x + b) over ``values``, in pieces of bounded size."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 2048):
        np.minimum(low, (values[None, at : at + 2048] * a[:, None] + b[:, None]).min(1), out=low)
    return low


def forest_rows(docs: DataFrame, doc_id: str, text: str, size: int, depth: int, trees: int) -> DataFrame:
    """(doc_id, text_key, digest, nodes): digest of the shingle set and the trie node of each tree; null without words."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    rows = rows.withColumn("text_key", F.unhex(F.md5("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    seeds = mix(np.arange(1, 2 * trees * depth + 1, dtype=np.uint64))
    a, b = seeds[: trees * depth] | np.uint64(1), seeds[trees * depth :]
    fold = mix(np.arange(1001, 1001 + depth, dtype=np.uint64)) | np.uint64(1)
    number = mix(np.arange(5001, 5001 + trees, dtype=np.uint64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, nodes, ends = [], [], [0]
            for _, data, offsets in slices(batch.column("text")):
                for values in shingles(data, offsets, size):
                    if len(values):
                        digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                        low = _minima(values, a, b).reshape(trees, depth)
                        nodes.append(mix((low * fold).sum(1, dtype=np.uint64) + number))
                    else:
                        digests.append(None)
                    ends.append(len(nodes) * trees)
            flat = np.concatenate(nodes).view(np.int64) if nodes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_key"), pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                ],
                names=["doc_id", "text_key", "digest", "nodes"],
            )

    return rows.mapInArrow(sign, f"doc_id {kind}, text_key binary, digest binary, nodes array<long>")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted distinct arrays, by products of blocks of 0/1 columns."""
    sizes = [len(x) for x in left + right]
    values, column = np.unique(np.concatenate(left + right), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    shared = np.zeros((2, len(values)), bool)
    split = len(left)
    shared[0, column[row < split]] = True
    shared[1, column[row >= split]] = True
    use = np.flatnonzero(shared.all(0))
    place = np.full(len(values), -1)
    place[use] = np.arange(len(use))
    column = place[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((split, len(right)), np.float32)
    step = 4096
    for low in range(0, len(use), step):
        a, b = np.searchsorted(column, [low, low + step])
        part = np.zeros((len(sizes), min(step, len(use) - low)), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        out += part[:split] @ part[split:].T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    """Boolean matrix of pairs whose Jaccard similarity reaches the threshold."""
    common = common_counts(left, right).astype(float)
    total = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - common
    return common >= similarity * total - 1e-9


def _verify(frame: pd.DataFrame, size: int, similarity: float) -> pd.DataFrame:
    """Per text of each block: the documents linked to it there, and the first text of its linked group."""
    out = []
    for _, block in frame.groupby(["label", "low", "high"], sort=False):
        block = block.drop_duplicates("digest")
        sets = []
        for _, data, offsets in slices(pa.array(block.text, pa.large_string())):
            sets += shingles(data, offsets, size)
        inner = block.low.iat[0] == block.high.iat[0]
        side = np.zeros(len(block), bool) if inner else (block.chunk == block.high).to_numpy()
        first, second = np.flatnonzero(~side), np.flatnonzero(~side if inner else side)
        if not len(first) or not len(second):
            continue
        links = linked([sets[i] for i in first], [sets[i] for i in second], similarity)
        if inner:
            np.fill_diagonal(links, False)
        weight, count = block.copies.to_numpy(float), np.zeros(len(block))
        count[first] += links @ weight[second]
        if not inner:
            count[second] += links.T @ weight[first]
        root = np.arange(len(block))

        def top(i: int) -> int:
            while root[i] != i:  # noqa: B023
                root[i] = root[root[i]]  # noqa: B023
                i = root[i]  # noqa: B023
            return i

        for i, j in zip(*np.nonzero(links)):
            x, y = top(first[i]), top(second[j])
            if x != y:
                root[max(x, y)] = min(x, y)
        digests = block.digest.to_numpy()
        out.append(pd.DataFrame({"digest": digests, "links": count.astype(np.int64), "mate": [digests[top(i)] for i in range(len(block))]}))
    return pd.concat(out) if out else pd.DataFrame({"digest": [], "links": np.zeros(0, np.int64), "mate": []})


def _joined(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, similarity: float = SIMILARITY,
    trees: int = TREES, recall: float = RECALL,
) -> DataFrame:
    """(doc_id, text_key, class_id, copy_id, n_links, first) per row; first: it is its class's smallest (doc_id, text_key).

    Copies are folded into their set first. Sets that share a trie node form candidate components; each
    is compared in blocks of about ``BLOCK`` texts, and only those pairs of blocks meet that share a node,
    so a group of any size is spread over tasks and no list of pairs is ever made.
    """
    depth = prefix_depth(similarity, trees, DEEPEST, recall)
    rows = spill(forest_rows(docs, doc_id, text, size, depth, trees), "forest")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    classes = rows.where("digest is not null").groupBy("digest").agg(
        F.min(rank).alias("pick"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("copy_id"), F.first("nodes").alias("nodes")
    )
    classes = spill(classes, "classes")
    nodes = classes.select("digest", F.explode("nodes").alias("node"))
    shared = nodes.groupBy("node").agg(F.min("digest").alias("root"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = spill(nodes.join(shared, "node"), "members")
    labels = connected_components(members.where("digest <> root"), "digest", "root")

    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    placed = labels.join(sizes.select("label", F.ceil(F.col("n") / BLOCK).alias("chunks")), "label")
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks"))).withColumnRenamed("node", "digest")
    placed = spill(placed, "placed")
    ends = members.join(placed.where("chunks > 1"), "digest").select("node", "label", "chunk").distinct()
    other = ends.select("node", F.col("chunk").alias("high"))
    pairs = ends.withColumnRenamed("chunk", "low").join(other, "node").where("low <= high").select("label", "low", "high").distinct()
    sides = pairs.select("label", "low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("chunk"))
    groups = max(1, placed.count() // BLOCK)
    one = F.lit(0).cast("long")
    small = placed.where("chunks = 1").select("digest", "label", one.alias("low"), one.alias("high"), "chunk", F.pmod(F.xxhash64("label"), F.lit(groups)).alias("task"))
    large = placed.where("chunks > 1").join(sides, ["label", "chunk"])
    large = large.select("digest", "label", "low", "high", "chunk", F.xxhash64("label", "low", "high").alias("task"))

    picked = placed.select("digest").join(classes, "digest").select("digest", "copies", "pick.doc_id", "pick.text_key")
    texts = docs.select(F.col(doc_id).alias("_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    texts = texts.withColumn("_key", F.unhex(F.md5("text")))
    texts = texts.join(picked, (texts._key == picked.text_key) & texts._id.eqNullSafe(picked.doc_id))
    compared = small.unionByName(large).join(texts.select("digest", "copies", "text"), "digest")
    found = compared.groupBy("task").applyInPandas(
        lambda frame: _verify(frame, size, similarity), "digest binary, links long, mate binary"
    )
    found = spill(found, "links")

    counts = found.groupBy("digest").agg(F.sum("links").alias("links"))
    joined = connected_components(found.where("digest <> mate"), "digest", "mate").withColumnRenamed("node", "digest")
    named = classes.select("digest", "copy_id", "copies", "pick").join(counts, "digest", "left").join(joined, "digest", "left")
    named = spill(named.withColumn("label", F.coalesce("label", "digest")), "named")
    least = named.groupBy("label").agg(F.min("copy_id").alias("class_id"), F.min("pick").alias("least"))
    named = named.join(least, "label").select("digest", "copy_id", "class_id", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.drop("nodes").join(named, "digest", "left")
    alone = F.col("digest").isNull()
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key"))
    return out.select(
        "doc_id", "text_key", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (alone | first).alias("first"),
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, similarity: float = SIMILARITY, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, copy_id, n_links.

    Words are runs of letters, digits and non-ASCII characters, lower-cased; a text below ``size`` words
    is one shingle. ``copy_id``: the smallest id among texts of the same shingle set; ``n_links``: other
    documents whose sets have Jaccard >= ``similarity``; ``class_id``: the smallest id of the
    component of links. Texts without words (null, empty) have no links and are their own class. Null ids count
    as documents but never name a class. Repeated rows are copies of each other.
    """
    return _joined(docs, doc_id, text, size, similarity, trees, recall).drop("text_key", "first")


def _row_key(doc_id, text_key):
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("none")), F.hex(text_key))))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the document of the smallest id (null last) stays.

    Ids that are alike are told apart by their lower-cased text. Rows alike in both are one document: the smallest row stays.
    """
    first = _joined(docs, doc_id, text, **settings).where("first").select(_row_key(F.col("doc_id"), F.col("text_key")).alias("_row")).distinct()
    text_key = F.unhex(F.md5(F.lower(F.coalesce(F.col(text), F.lit("")))))
    kept = docs.withColumn("_row", _row_key(F.col(doc_id), text_key)).join(first, "_row", "left_semi")
    return kept.groupBy("_row").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")


SQL = r"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from documents),
s as (
  select r, doc_id, list_sort(list_distinct(case when len(w) >= 5
    then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as sh from d),
c as (select sh, min(doc_id) as copy_id, count(*) as copies, row_number() over () as k from s where len(sh) > 0 group by sh),
g as (select k, len(sh) as n, unnest(sh) as x from c),
p as (
  select a.k as i, b.k as j from g a join g b on a.x = b.x and a.k <> b.k
  group by a.k, b.k, a.n, b.n having count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
l as (select i, sum(copies)::bigint as links from p join c on c.k = p.j group by i),
walk(i, j) as (select k, k from c union select walk.i, p.j from walk join p on p.i = walk.j),
m as (select i, min(copy_id) as class_id from walk join c on c.k = walk.j group by i)
select s.doc_id, case when c.k is null then s.doc_id else class_id end as class_id, case when c.k is null then s.doc_id else copy_id end as copy_id,
  coalesce(copies - 1, 0) + coalesce(links, 0) as n_links
from s left join c on c.sh = s.sh left join l on l.i = c.k left join m on m.i = c.k
"""


@query("op2_ngram_jaccard_join", SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, class_id, copy_id and n_links of every document."""
    return near_duplicates(table(spark, folder, "documents"))
