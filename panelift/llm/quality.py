"""Compression classifier: which of two zstandard dictionaries shortens a text more."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelift.llm.catalog import query, table
from panelift.session import spill

#: Characters of one training block, bytes of one compressed block.
BLOCK = 2000
SMOOTH = 100


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the logistic map from sizes to a probability."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def sizes(texts, good: bytes, bad: bytes, level: int = 3) -> np.ndarray:
    """Per text: bytes, compressed bytes with the good dictionary, and with the bad one.

    Every text is compressed whole, block by block, so that a long text cannot outgrow the dictionary.
    Null and empty texts give zeros.
    """
    packers = []
    for content in (good, bad):
        words = zstandard.ZstdCompressionDict(content)
        words.precompute_compress(level=level)
        packers.append(zstandard.ZstdCompressor(dict_data=words, write_content_size=False, write_dict_id=False))
    out = np.zeros((len(texts), 3))
    for i, text in enumerate(texts):
        if not isinstance(text, str) or not text:
            continue
        data = text.encode("utf-8", "surrogatepass")
        blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
        out[i] = (len(data), *(sum(len(p.compress(x)) for x in blocks) for p in packers))
    return out


def features(measured: np.ndarray) -> np.ndarray:
    """Normalised size difference, and how far the text shrinks at all, with its square.

    ``SMOOTH`` bytes are added to every size, so a short text says less and an empty one nothing.
    """
    n, good, bad = (measured + SMOOTH).T
    ratio = np.log((good + bad) / (2 * n))
    return np.column_stack([(bad - good) / (bad + good), ratio, ratio**2, np.ones(len(n))])


def _logistic(a: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Newton steps of a weighted logistic regression with a small ridge, on scaled columns."""
    scale = np.where(a.std(0) > 0, a.std(0), 1.0)
    a = a / scale
    w = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weights * (p - y)) + 1e-2 * w
        hess = (a * (weights * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w / scale


def fit(labelled: DataFrame, text: str = "text", label: str = "label", blocks: int = 3000, share: float | None = None, dictionary: int = 1 << 16) -> Model:
    """Train on ``labelled``, a bounded sample (label 1 good, 0 bad; other rows are ignored).

    ``blocks``: text blocks of each class from which its dictionary is built, those of lowest hash;
    ``share``: part of good rows among all labelled rows, if the sample has another; ``dictionary``:
    bytes of a dictionary. Rows whose text hash is even build the dictionaries, odd ones calibrate, so
    calibration never sees a text it was built from. Without rows of both classes every score is 0.5.
    """
    rank = F.xxhash64(F.col(text), F.lit(8))
    known = labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"), rank.alias("h"))
    known = known.where("label in (0, 1) and length(text) > 0")
    parts = known.where("h % 2 = 0").select(
        "label", "h", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / BLOCK).cast("int"))).alias("at"), "text"
    )
    parts = parts.select("label", F.substring("text", F.col("at") * BLOCK + 1, F.lit(BLOCK)).alias("block"), F.xxhash64("h", "at").alias("r"))
    samples = []
    for value in (1, 0):
        found = parts.where(F.col("label") == value).orderBy("r", "block").limit(blocks).collect()
        samples.append([r.block.split("\n") for r in found])
    both = {x for block in samples[0] for x in block} & {x for block in samples[1] for x in block}
    contents = []
    for sample in samples:  # lines of both classes say nothing about either
        data = ["\n".join(x for x in block if x not in both).encode("utf-8", "surrogatepass") for block in sample]
        data = [x for x in data if x]
        try:
            contents.append(zstandard.train_dictionary(dictionary, data).as_bytes() if data else b"")
        except zstandard.ZstdError:  # too little to train from: the raw text is a dictionary too
            contents.append(b"".join(data)[-dictionary:])
    good, bad = contents
    if not good or not bad:
        return Model(good or b" ", bad or b" ", (0.0,) * 4)
    sample = known.where("h % 2 <> 0")

    @F.pandas_udf("array<double>")
    def measured(column: pd.Series) -> pd.Series:
        return pd.Series(list(sizes(column.tolist(), good, bad)))

    found = sample.select("label", measured("text").alias("x")).toPandas()
    if found.label.nunique() < 2:
        return Model(good, bad, (20.0, 0.0, 0.0, 0.0))
    y = found.label.to_numpy(float)
    share = y.mean() if share is None else share
    weights = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(good, bad, tuple(_logistic(features(np.vstack(found.x)), y, weights).tolist()))


def score(docs: DataFrame, model: Model, text: str = "text", output: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is good. Null and empty texts get the score of no evidence.

    An existing column named ``output`` is replaced; all others stay as they are.
    """
    weights = np.array(model.weights)

    @F.pandas_udf("double")
    def probability(column: pd.Series) -> pd.Series:
        z = features(sizes(column.tolist(), model.good, model.bad)) @ weights
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -700, 700))))

    return docs.withColumn(output, probability(F.col(text)))


def held_out(doc_id: Column) -> Column:
    """Rows that training must not see: crc32 of the id as text leaves 1 modulo 3 (a null id is not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit_on_labels(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = 4000) -> Model:
    """Train on at most ``rows`` labelled documents of each class: those of lowest id hash, never held-out ones.

    The sampled ids are bounded by ``rows``, so they are broadcast to the documents instead of
    shuffling texts. Class shares are counted over all labels.
    """
    marks = labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("label"))
    marks = spill(marks.where("label in (0, 1) and doc_id is not null"), "marks")
    share = marks.agg(F.avg("label")).first()[0]
    order = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = marks.where("label = 1").orderBy(*order).limit(rows).unionByName(marks.where("label = 0").orderBy(*order).limit(rows))
    sample = spill(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "sample")
    return fit(sample, share=share)


@query("op8_quality_classifier")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    docs = table(spark, folder, "documents")
    model = fit_on_labels(spark, docs, table(spark, folder, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
