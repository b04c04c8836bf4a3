"""License scan: phrases at word positions, and an exact containment join of text blocks and word runs with templates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelift.llm.catalog import query, table
from panelift.llm.urls import LOWER, UPPER

#: Everything between words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label and words of each template; several templates may share a label.
TEMPLATES = (
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-3.0", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
CONTAINMENT = 0.9


def _lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _tokens(text: Column) -> Column:
    """Distinct lower-cased words."""
    return F.array_remove(F.array_distinct(F.split(F.regexp_replace(_lower(text), BETWEEN, " "), " ")), "")


def _spaces(x: Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("long")


def phrase_places(docs: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word and base (array of labels), case of A-Z ignored.

    Phrases must not overlap themselves. Null texts count as empty. Columns of these names are replaced.
    """
    joined = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BETWEEN, " ")), F.lit(" "))
    out = docs.withColumn("_joined", joined)
    out = out.withColumn("n_words", F.when(F.col("_joined") == "  ", F.lit(0).cast("long")).otherwise(_spaces(F.col("_joined")) - 1))
    found = []
    for phrase, label in phrases.items():
        parts = F.split("_joined", f"(?i)(?<= ){phrase}(?= )", -1)
        n = len(phrase.split(" "))
        x = F.struct(
            F.lit(label).alias("label"),
            (F.size(parts) - 1).cast("long").alias("places"),
            (_spaces(F.element_at(parts, 1)) - 1).alias("first"),
            (F.col("n_words") - n - (_spaces(F.element_at(parts, -1)) - 1)).alias("last"),
        )
        found.append(F.when(F.col("_joined").rlike(f"(?i) {phrase} "), x))
    out = out.withColumn("_found", F.filter(F.array(*found), lambda x: x.isNotNull()))
    return out.withColumns(
        {
            "n_base": F.aggregate("_found", F.lit(0).cast("long"), lambda a, x: a + x["places"]),
            "first_word": F.array_min(F.col("_found.first")),
            "last_word": F.array_max(F.col("_found.last")),
            "base": F.col("_found.label"),
        }
    ).drop("_joined", "_found")


def token_order(docs: DataFrame, text: str, vocabulary: list[str]) -> list[str]:
    """Template words by the number of documents that hold them, rarest first (ties by word).

    Counted over all documents; the result has one row per template word, so it is bounded by the templates.
    """
    words = F.array(*[F.lit(w) for w in vocabulary])
    counted = docs.select(F.explode(F.array_intersect(words, _tokens(F.col(text)))).alias("w")).groupBy("w").count()
    counts = {r.w: r["count"] for r in counted.collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def template_blocks(
    docs: DataFrame, keys: list[str], text: str = "text", templates=TEMPLATES, threshold: float = CONTAINMENT, separator: str = "\n"
) -> DataFrame:
    """(keys, block, label, containment) of every block that holds at least ``threshold`` of a template's words.

    Blocks are the pieces of a text between ``separator`` (a regular expression). Words are ordered by
    global frequency. A block with enough words of a template must hold one of its rarest ones
    (prefix filter), enough template words at all (length filter), and enough of them around the
    shared one in that order (positional filter); what passes is counted exactly. The prefix index is as
    small as the templates given, so it is broadcast.
    """
    sets = [(label, sorted(set(words.split(" ")))) for label, words in templates]
    order = token_order(docs, text, sorted({w for _, words in sets for w in words}))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for number, (label, words) in enumerate(sets):
        words = sorted(words, key=rank.get)
        need = math.ceil(threshold * len(words) - 1e-9)
        for at, word in enumerate(words[: len(words) - need + 1]):
            index.append((word, number, label, words, at, need, len(words)))
    prefix = docs.sparkSession.createDataFrame(
        index, "word string, template int, label string, words array<string>, at int, need int, n int"
    )
    rare = F.array(*[F.lit(w) for w in sorted({x[0] for x in index}, key=rank.get)])
    blocks = docs.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), separator, -1)).alias("block", "_text"))
    blocks = blocks.select(*keys, "block", F.array_intersect(F.array(*[F.lit(w) for w in order]), _tokens(F.col("_text"))).alias("_held"))
    hits = blocks.where(F.size("_held") > 0).select(*keys, "block", "_held", F.explode(F.array_intersect(rare, F.col("_held"))).alias("word"))
    hits = hits.join(F.broadcast(prefix), "word")
    q, m = F.array_position("_held", F.col("word")).cast("int") - 1, F.size("_held")
    around = F.least(F.col("at"), q) + 1 + F.least(F.col("n") - F.col("at") - 1, m - q - 1)
    close = hits.where(m >= F.col("need")).where(around >= F.col("need"))
    overlap = F.size(F.array_intersect("_held", "words"))
    kept = close.select(*keys, "block", "label", "need", overlap.alias("_overlap"), (overlap.cast("double") / F.col("n")).alias("containment"))
    return kept.where("_overlap >= need").drop("need", "_overlap")


def template_windows(docs: DataFrame, keys: list[str], text: str = "text", templates=TEMPLATES, threshold: float = CONTAINMENT) -> DataFrame:
    """(keys, label, containment) of every template of whose words some run of words holds at least ``threshold``.

    Runs go over line ends, so wrapped notices count; they are a quarter and two words longer than the
    template, for the words of comment signs. Containment is the largest of all runs of the text. Only texts with enough
    template words at all are looked at by place: each run begins with a template word, and counts are exact.
    """
    sets = []
    for label, words in templates:
        distinct = sorted(set(words.split(" ")))
        n = len(words.split(" "))
        sets.append((label, distinct, math.ceil(threshold * len(distinct) - 1e-9), n + n // 4 + 2))
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for _, words, _, _ in sets for w in words})])
    words = F.split(F.regexp_replace(_lower(F.col(text)), BETWEEN, " "), " ")
    out = docs.select(*keys, words.alias("_words")).withColumn("_held", F.array_intersect(vocabulary, F.array_distinct("_words")))
    possible = []
    for label, own, need, run in sets:
        own = F.array(*[F.lit(w) for w in own])
        x = F.struct(F.lit(label).alias("label"), own.alias("own"), F.lit(need).alias("need"), F.lit(run).alias("run"))
        possible.append(F.when(F.size(F.array_intersect("_held", own)) >= need, x))
    out = out.where(F.size("_held") > 0).select(*keys, "_words", F.explode(F.filter(F.array(*possible), lambda x: x.isNotNull())).alias("_t"))
    # exploding single arrays keeps later steps from computing them again for each element
    full = F.filter("_words", lambda w: w != "")
    placed = F.transform(full, lambda w, i: F.struct(i.alias("at"), w.alias("w")))
    hits = F.filter(placed, lambda x: F.array_contains(F.col("_t.own"), x["w"]))
    out = out.select(*keys, "_t", F.explode(F.array(hits)).alias("_hits"))

    def held(x: Column, k: Column) -> Column:
        run = F.filter(F.slice("_hits", k + 1, F.col("_t.run")), lambda y: y["at"] < x["at"] + F.col("_t.run"))
        return F.size(F.array_distinct(F.transform(run, lambda y: y["w"])))

    out = out.select(*keys, "_t", F.explode(F.array(F.array_max(F.transform("_hits", held)))).alias("_most"))
    out = out.where(F.col("_most") >= F.col("_t.need"))
    return out.select(*keys, "_t.label", (F.col("_most").cast("double") / F.size("_t.own")).alias("containment"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``labels`` adds the labels of templates that match a line or a run of words over line ends; ``score`` is 1 with a base phrase, else the
    largest containment of a matching template, else 0. Documents are told apart by id and text, so
    repeated ids are safe and repeated rows get the same result each.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_text_key"))
    keys = ["doc_id", "_text_key"]
    found = template_blocks(docs, keys).drop("block").unionByName(template_windows(docs, keys))
    found = found.groupBy(F.col("doc_id").alias("_id"), F.col("_text_key").alias("_key")).agg(
        F.collect_set("label").alias("_more"), F.max("containment").alias("_best")
    )
    base = phrase_places(docs).drop("text")
    both = base.join(found, base.doc_id.eqNullSafe(found._id) & (base._text_key == found._key), "left")
    none = F.array().cast("array<string>")
    labels = F.array_union("base", F.coalesce("_more", none))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, {_WORDS.format("text")} as words from d),
phrases(phrase, label) as (values {", ".join(f"({p.split(' ')}, '{x}')" for p, x in PHRASES.items())}),
places as (select r, label, unnest(list_filter(range(1, len(words) + 1), lambda i: words[i:i + len(phrase) - 1] = phrase)) - 1 as pos from w, phrases),
base as (select r, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list_distinct(list(label)) as base from places group by r),
templates(label, words) as (values {", ".join(f"('{x}', {sorted(set(t.split(' ')))})" for x, t in TEMPLATES)}),
blocks as (select r, list_distinct({_WORDS.format("line")}) as held from (select r, unnest(string_split(text, chr(10))) as line from d)),
hits as (select r, label, len(list_intersect(held, words)) / len(words) as share from blocks, templates),
method as (select r, list_distinct(list(label)) as more, max(share) as best from hits where share >= {CONTAINMENT} group by r)
select doc_id, len(words) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') as labels,
  case when n_base > 0 then 1.0::double else coalesce(best, 0)::double end as score
from w left join base using (r) left join method using (r)
"""


@query("op1_license_scans", SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """The license scan of every document."""
    return scan(table(spark, folder, "documents"))
