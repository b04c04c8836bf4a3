"""Substring dedup: lines or paragraphs that stand elsewhere earlier are removed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelift.llm.catalog import query, table

#: Shorter units (normalised words) always stay.
LEAST_WORDS = 5
#: Parts that the units of one digest are dealt into; a power of two.
PARTS = 256


def dedup_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", separator: str = "\n", least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_units, n_removed, kept_text, kept, removed.

    Units are the pieces of a text between ``separator`` (a plain string). Two units are equal if
    their normalised words are (A-Z and other letters lower-cased, runs of anything but letters and digits
    one space); units below ``least_words`` words always stay. Of equal units the one of the smallest
    (doc_id, text digest, place) stays, wherever the others are; null ids rank last. ``kept`` and
    ``removed`` are character spans "start-end" of the original text, comma-joined, neighbours of one kind
    not merged; kept_text joins the kept units with the separator.
    Null texts count as empty: one empty unit. Rows alike in id and text are one document: they get the same result.

    A digest's units are dealt by their rank into up to ``PARTS`` parts, so a line that a third of all
    documents hold is no hot task: ranks are compared within a part, then one row per part within a digest,
    and the first rank goes back to the parts the digest has. Both uses of the units share one exchange.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("key", _digest("text"))
    units = docs.select("doc_id", "key", F.posexplode(F.split("text", f"\\Q{separator}\\E", -1)).alias("place", "unit"))
    words = F.trim(F.regexp_replace(F.lower("unit"), r"[^\p{L}\p{N}]+", " "))
    units = units.withColumn("unit", words).where(F.length("unit") - F.length(F.replace("unit", F.lit(" "), F.lit(""))) >= least_words - 1)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "place")
    units = deal(units.where("unit <> ''").select(_digest("unit").alias("digest"), rank.alias("rank")))
    parts = units.groupBy("digest", "part").agg(F.min("rank").alias("first"), (F.min("rank") != F.max("rank")).alias("several"))
    first = parts.groupBy("digest").agg(F.min("first").alias("first"), F.max("several").alias("several"), F.collect_list("part").alias("parts"))
    first = first.where("several or size(parts) > 1").select("digest", F.explode("parts").alias("part"), "first")
    gone = units.join(first, ["digest", "part"]).where("rank <> first").select("rank.*").distinct()
    gone = gone.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_list("place").alias("gone"))
    both = docs.join(gone, docs.doc_id.eqNullSafe(gone._id) & (docs.key == gone._key), "left").select("doc_id", "text", "gone")

    @F.pandas_udf("n_units long, n_removed long, kept_text string, kept string, removed string")
    def cut(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        rows = [_cut(t, g, separator) for t, g in zip(texts, gone)]
        return pd.DataFrame(rows, columns=["n_units", "n_removed", "kept_text", "kept", "removed"])

    return both.select("doc_id", cut("text", "gone").alias("c")).select("doc_id", "c.*")


def _digest(text: str) -> Column:
    """Never null, also for the optimiser: null filters on one use of the units would part their exchange."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def deal(units: DataFrame) -> DataFrame:
    """``units`` (digest, rank) with a ``part`` from 0 to PARTS - 1, dealt by digest and part; equal ranks share a part."""
    return units.withColumn("part", F.xxhash64("rank").bitwiseAND(PARTS - 1).cast("int")).repartition("digest", "part")


def _cut(text: str, gone, separator: str):
    units = text.split(separator)
    drop = set() if gone is None else set(gone)
    spans, at = ([], []), 0
    for i, unit in enumerate(units):
        spans[i in drop].append(f"{at}-{at + len(unit)}")
        at += len(unit) + len(separator)
    left = separator.join(u for i, u in enumerate(units) if i not in drop)
    return len(units), len(drop), left, ",".join(spans[0]), ",".join(spans[1])


SQL = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
u as (select r, doc_id, text, unnest(string_split(text, chr(10))) as unit, generate_subscripts(string_split(text, chr(10)), 1) - 1 as place from d),
n as (
  select *, trim(regexp_replace(lower(unit), '[^\pL\pN]+', ' ', 'g')) as norm,
    coalesce(sum(length(unit) + 1) over (partition by r order by place rows between unbounded preceding and 1 preceding), 0) as start from u),
m as (
  select *, len(string_split(norm, ' ')) >= {LEAST_WORDS} and rank() over (partition by norm order by doc_id nulls last, md5(text), place) > 1 as gone from n)
select doc_id, count(*) as n_units, count(*) filter (gone) as n_removed,
  coalesce(string_agg(unit, chr(10) order by place) filter (not gone), '') as kept_text,
  coalesce(string_agg(start::bigint || '-' || (start + length(unit))::bigint, ',' order by place) filter (not gone), '') as kept,
  coalesce(string_agg(start::bigint || '-' || (start + length(unit))::bigint, ',' order by place) filter (gone), '') as removed
from m group by r, doc_id
"""


@query("op3_substring_dedup", SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that stand earlier elsewhere."""
    return dedup_units(table(spark, folder, "documents"))
