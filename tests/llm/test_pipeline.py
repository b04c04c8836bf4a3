"""The pipeline stage by stage."""

import small
from pyspark.sql import functions as F

import corpus_pipeline
from panelift.llm import decontaminate, nearjoin, secrets, tokenize


def test_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, docs, folder).write.parquet(path)
        seen[name] = (docs, spark.read.parquet(path))
        docs = seen[name][1]
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
        assert docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    before, after = seen["quality classifier"]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = labels.join(after.select("doc_id", F.lit(True).alias("kept")), "doc_id", "left").toPandas()
    assert kept[kept.quality == 1].kept.eq(True).mean() > 0.99
    assert kept[kept.quality == 0].kept.eq(True).mean() < 0.1
    before, after = seen["n-gram Jaccard join"]
    assert nearjoin.near_duplicates(after).where("n_links > 0").isEmpty()
    assert after.count() == nearjoin.near_duplicates(before).select("class_id").distinct().count()
    before, after = seen["benchmark decontamination"]
    leaks = decontaminate.find_items(before, spark.read.parquet(f"{folder}/benchmark.parquet")).where("size(hits) > 0")
    assert before.count() - after.count() == leaks.count() > 0
    before, after = seen["secret scans"]
    assert before.count() == after.count()
    assert not secrets.find(before).isEmpty()
    assert after.where(F.col("text").rlike("AKIA[0-9A-Z]{16}|password=[0-9a-f]{18}")).isEmpty()
    assert after.where("n_chars <> length(text)").join(before.where("n_chars <> length(text)"), "doc_id", "left_anti").isEmpty()
    with open(tokenize.MODEL, "rb") as f:
        machine = tokenize.Transducer.read(f.read())
    for r in docs.select("text", "ids", "n_tokens").collect():
        assert machine.decode(r.ids) == r.text and r.n_tokens == len(r.ids)


def test_awkward_rows_pass(spark, awkward):
    out = corpus_pipeline.run(spark, awkward)
    assert out.columns[: len(small.SCHEMAS["documents"])] == [f for f, _ in small.SCHEMAS["documents"]]
    rows = [(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()]
    kept = [i for i, _ in rows]
    assert {10, 11, 13} <= set(kept)  # no labels: nothing is rejected
    assert kept.count(5) == kept.count(-3) == 1 and not {6, 7, 8, 14, None} & set(kept)  # the smallest id of each group stays
    assert [t for i, t in rows if i == 9] == [small.prose(3, 30)]  # of two rows alike in id, the one that is no copy
