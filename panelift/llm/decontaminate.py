"""Benchmark decontamination: exact pieces point to places, bit-parallel edit distance verifies them."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from panelift.llm.catalog import query, table

#: Edits allowed per character of an item; items below so many normalised characters must stand exactly, as whole words.
ERROR_RATE, SHORTEST = 0.05, 30
#: Characters of items searched in one pass over the documents.
PASS_CHARS = 4_000_000


def normalised(text: Column) -> Column:
    """Lower-cased letters and digits; runs of anything else become one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): the item cut into errors + 1 parts; at most ``errors`` edits leave one untouched."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_match(pattern: str, text: str, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """(distance, end) of the part of ``text`` nearest to ``pattern``, first end among equals (Myers 1999).

    One machine word (here a Python integer) holds a whole column of the edit matrix as vertical
    differences; a match may begin anywhere.
    """
    m = len(pattern)
    masks = char_masks(pattern) if masks is None else masks
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, where = m, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        rise = down | ~(diagonal | up)
        fall = up & diagonal
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise = (rise << 1) & full
        fall = (fall << 1) & full
        up = (fall | ~(diagonal | rise)) & full
        down = rise & diagonal
        if score < best:
            best, where = score, at
    return best, where


def char_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


class Searcher:
    """All pieces of all items in one Aho-Corasick automaton; items below ``shortest`` characters whole, with a space on either side."""

    def __init__(self, items: list[tuple[object, str]], rate: float, shortest: int = 0):
        self.items = [(key, text, int(len(text) * rate), char_masks(text)) for key, text in items]
        self.exact = {number for number, (_, text) in enumerate(items) if len(text) < shortest}
        places: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, errors, _) in enumerate(self.items):
            for offset, piece in [(-1, f" {text} ")] if number in self.exact else pieces(text, errors):
                places.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[object, int, int]]:
        """(item, distance, end in the normalised text) of every item within its error budget."""
        if not self.items or not text:
            return []
        spans: dict[int, list[list[int]]] = {}
        exact: dict[int, int] = {}
        for last, (size, found) in self.automaton.iter(f" {text} "):
            for number, offset in found:
                _, item, errors, _ = self.items[number]
                begin = last - size - offset  # in the text without the space before it
                if number in self.exact:
                    exact.setdefault(number, begin + len(item))
                    continue
                low, high = max(0, begin - errors), begin + len(item) + errors
                known = spans.setdefault(number, [])
                if known and low <= known[-1][1]:
                    known[-1][0] = min(known[-1][0], low)
                    known[-1][1] = max(known[-1][1], high)
                else:
                    known.append([low, high])
        out = [(self.items[number][0], 0, end) for number, end in exact.items()]
        for number, known in sorted(spans.items()):
            key, item, errors, masks = self.items[number]
            best = None
            for low, high in known:
                distance, end = best_match(item, text[low:high], masks)
                if distance <= errors and (best is None or distance < best[0]):
                    best = distance, low + end
            if best:
                out.append((key, *best))
        return out


def find_items(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    rate: float = ERROR_RATE, shortest: int = SHORTEST, output: str = "hits",
) -> DataFrame:
    """``docs`` with an array of (item_id, distance, end): the items that stand in the text with at most
    ``rate`` edits per character, counted on normalised text; the nearest place of each item.

    Texts are searched whole. Items below ``shortest`` characters must stand without edits, as whole words.
    Null and empty texts have no hits, items without a letter or digit are not searched (``wordless_items``
    lists them), repeated items are found under the smallest id. Items are
    sent to the executors in passes of at most ``PASS_CHARS`` characters; more items mean more passes over
    the documents, not larger ones. A column named ``output`` is replaced.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), normalised(F.col(item_text)).alias("item"))
    items = items.where(F.length("item") > 0).groupBy("item").agg(F.min("item_id").alias("item_id"))
    kind: DataType = items.schema["item_id"].dataType
    chars = items.agg(F.sum(F.length("item"))).first()[0] or 0
    passes = max(1, -(-chars // PASS_CHARS))
    shape = f"array<struct<item_id:{kind.simpleString()},distance:int,end:int>>"
    out = docs.withColumn("_searched", normalised(F.col(text))).withColumn(output, F.array().cast(shape))
    for turn in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == turn).orderBy("item").collect()
        found = _search_column([(r.item_id, r.item) for r in rows], rate, shortest, shape)
        out = out.withColumn(output, F.concat(F.col(output), found("_searched")))
    return out.drop("_searched")


def wordless_items(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, text) of the items that normalise to nothing, and so cannot be searched."""
    return benchmark.where(normalised(F.col(item_text)) == "").select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))


def _search_column(items: list[tuple[object, str]], rate: float, shortest: int, shape: str):
    @F.pandas_udf(shape)
    def search(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        searcher = Searcher(items, rate, shortest)
        for texts in columns:
            yield pd.Series([[{"item_id": k, "distance": d, "end": e} for k, d, e in searcher.find(t)] for t in texts])

    return search


@query("op5_benchmark_decontamination")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, item_id, distance and end of every benchmark item found in a document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    hits = find_items(docs, table(spark, folder, "benchmark"))
    return hits.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", "h.distance", "h.end")
