"""Line dedup: a line that most documents hold is spread over tasks, and the units are cut once."""

import re

import pyspark.sql.functions as F

from panelift.llm import lines


def brute(rows):
    """{(doc_id, text): removed places} by the definition, ranks (null last, id, text digest, place)."""
    import hashlib

    units = {}
    for i, t in rows:
        for place, unit in enumerate((t or "").split("\n")):
            words = re.sub(r"[^a-z0-9]+", " ", unit.lower()).strip()
            if len(words.split(" ")) >= lines.LEAST_WORDS:
                units.setdefault(words, set()).add((i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest(), place, i, t or ""))
    gone = {(i, t or ""): set() for i, t in rows}
    for ranks in units.values():
        for *_, place, i, t in sorted(ranks, key=lambda r: r[:4])[1:]:
            gone[i, t].add(place)
    return gone


def hot_rows():
    common = "this very common line stands almost everywhere"
    rows = [(i, f"own words of document number {i}\n{common}\n" + (common.upper() + "!" if i % 3 else f"short {i}")) for i in range(1500)]
    return rows + [(None, common), (None, common), (None, "x\n" + common), (7, rows[7][1]), (8, common), (2000, None), (2001, "")]


def test_common_line_is_spread(spark):
    units = spark.range(20000).select(F.expr("unhex(md5('hot'))").alias("digest"), F.struct(F.lit(False).alias("none"), F.col("id").alias("doc_id"), F.lit(b"k").alias("key"), F.lit(1).alias("place")).alias("rank"))
    dealt = lines.deal(units.union(units))
    assert dealt.groupBy("rank").agg(F.count_distinct("part").alias("n")).where("n <> 1").count() == 0
    sizes = [r["count"] for r in dealt.groupBy("digest", "part").count().collect()]
    assert sum(sizes) == 40000 and len(sizes) == lines.PARTS and max(sizes) < 3 * 40000 / lines.PARTS


def test_common_line_removed_as_defined(spark):
    rows = hot_rows()
    frame = lines.dedup_units(spark.createDataFrame(rows, "doc_id long, text string"))
    got = frame.collect()
    gone = brute(rows)
    want = [(i, len((t or "").split("\n")), len(gone[i, t or ""]), "\n".join(u for p, u in enumerate((t or "").split("\n")) if p not in gone[i, t or ""])) for i, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r.n_units, r.n_removed, r.kept_text) for r in got), key=key) == sorted(want, key=key)
    assert sum(r.n_removed for r in got) > 2400


def test_units_are_cut_once_and_joined_by_part(spark, awkward):
    frame = lines.dedup_units(spark.read.parquet(f"{awkward}/documents.parquet"))
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"Generate posexplode", plan)) == 1 and "ReusedExchange" in plan
    assert re.search(r"Join \[digest#\d+, part#\d+\]", plan)
