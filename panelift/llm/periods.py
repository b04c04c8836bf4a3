"""Periodic run detection by seeding diagonals with word k-grams and extending them.

A run of period q and length L >= max(6, 4q) has L - q >= 5 positions x with word x = word x + q, in a
row. So every run holds a k-gram (k = 5 words) that occurs again q words later. Each document's k-grams
are indexed; pairs of occurrences of one k-gram at a lag d are seeds of the diagonal d. A seed whose left
neighbours differ starts a maximal stretch, which is extended to the right once; the furthest point
reached on each lag is kept, so no later seed inside it is extended again. A stretch is a run if it is
long enough and its block of d words is no power of a shorter block (then the shorter period has found
it). Lags beyond a quarter of the words left cannot make a run and are not paired.

Documents are independent, so the work is a map over partitions: no shuffle, and a hot source or a
very long document costs one task the time of that document only.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelift.llm.catalog import query, table

#: Fixed values of the contract: words, least length and exponent of a run, and the seed size.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHORTEST, EXPONENT = 6, 4
SEED = 5
SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """The words with the contract's periodic tail planted where crc32 of the decimal id ends in 0.

    h = crc32(str(doc_id)), g = h // 10; if h % 10 == 0 and there are n > 0 words, word i >= a becomes
    word a + (i - a) % p, with a = g % n and p = 1 + (n - a) // (3 + g % 8). A null id plants nothing.
    """
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _primes(d: int) -> list[int]:
    out, f = [], 2
    while f * f <= d:
        if d % f == 0:
            out.append(f)
            while d % f == 0:
                d //= f
        f += 1
    return out + ([d] if d > 1 else [])


def _extend(w: np.ndarray, i: int, d: int) -> int:
    """First x >= i with w[x] != w[x + d] (or n - d): the end of the matches on diagonal d from i."""
    n, x, step = len(w), i, 16
    while x + d < n:
        top = min(x + step, n - d)
        differ = np.flatnonzero(w[x:top] != w[x + d : top + d])
        if len(differ):
            return x + int(differ[0])
        x, step = top, step * 2
    return n - d


def runs(w: np.ndarray, seed: int = SEED) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the word-id sequence ``w``, by start, then period."""
    n = len(w)
    if n < SHORTEST:
        return []
    m = n - seed + 1
    gram = np.zeros(m, np.uint64)
    for t in range(seed):
        gram = gram * np.uint64(0x100000001B3) + w[t : t + m].astype(np.uint64) + np.uint64(1)
    order = np.argsort(gram, kind="stable")  # within a k-gram, positions ascend
    sorted_gram = gram[order]
    seeds = []
    alive = np.arange(m - 1)
    r = 1
    while len(alive):
        alive = alive[alive + r < m]
        alive = alive[sorted_gram[alive] == sorted_gram[alive + r]]
        i, j = order[alive], order[alive + r]
        d = j - i
        alive = alive[EXPONENT * d <= n - i]  # farther partners of these occurrences lie farther still
        keep = (EXPONENT * d <= n - i) & ((i == 0) | (w[np.maximum(i - 1, 0)] != w[np.maximum(j - 1, 0)]))
        seeds.append(np.stack([d[keep], i[keep]], 1))
        r += 1
    found = []
    if not seeds:
        return found
    seeds = np.concatenate(seeds)
    seeds = seeds[np.lexsort((seeds[:, 1], seeds[:, 0]))]
    covered: dict[int, int] = {}
    for d, i in seeds.tolist():
        if i < covered.get(d, -1):
            continue
        e = _extend(w, i, d)
        covered[d] = e
        length = e - i + d
        if length < max(SHORTEST, EXPONENT * d):
            continue
        block = w[i : i + d]
        if any((block == w[i + d // f : i + d + d // f]).all() for f in _primes(d)):
            continue  # a power of a shorter block: found under that period
        found.append((i, length, d))
    found.sort(key=lambda x: (x[0], x[2]))
    return found


def describe(doc_id: int | None, text: str | None) -> tuple:
    """One output row of a document (see ``periodic_runs``)."""
    words = planted(doc_id, WORD.findall(text or ""))
    index: dict[str, int] = {}
    w = np.fromiter((index.setdefault(x, len(index)) for x in words), np.int64, len(words))
    found = runs(w)
    dropped = np.zeros(len(words) + 1, np.int64)
    for s, length, q in found:
        dropped[s + q] += 1
        dropped[s + length] -= 1
    kept = np.cumsum(dropped[:-1]) == 0
    collapsed = " ".join(x for x, k in zip(words, kept.tolist()) if k)
    listing = "".join(f"{s},{length},{q}\n" for s, length, q in found).encode()
    best = (None,) * 4
    if found:
        s, length, q = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]))
        best = (s, length, q, 1000 * length // q)
    return (doc_id, len(found), *best, hashlib.sha256(listing).hexdigest(), hashlib.sha256(collapsed.encode()).hexdigest())


def _describe_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    for batch in batches:
        rows = [describe(i, t) for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist())]
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def periodic_runs(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_runs, the run of greatest length / period, and digests of all runs and of
    the text without repeats.

    Words are the runs of ``[^\\x20\\x09-\\x0D]+`` (a null text has none), with the contract's periodic tail
    planted first. A run is a maximal stretch of smallest period q and length >= max(6, 4q); a word after
    the first q words of any run is dropped. For the best run (greatest exact length / period, then
    smallest start, then period) come start, length, period and exponent_milli = floor(1000 * length /
    period), all null without runs. runs_sha256 digests every run's ``start,length,period`` and a line feed,
    by start then period; collapsed_sha256 the kept words joined by one space (both of the empty string
    for an empty text). Rows are kept as they are: repeated rows give repeated results, a null id plants
    nothing and stays null. Other columns of ``documents`` are not read.
    """
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_describe_batches, SCHEMA)


@query("op11_periodic_runs")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of repeated words in every whole document."""
    return periodic_runs(table(spark, folder, "documents"))
