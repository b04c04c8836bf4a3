"""Byte removal against a direct reading of its definition."""

import hashlib

import numpy as np
import pytest
import small

from panelift.llm import suffixes


def brute(rows, length=100):
    rows = [(i, (t or "").encode()) for i, t in rows]
    order = sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0, hashlib.md5(x[1]).digest()))
    seen, out = set(), {}
    for key in order:
        data = key[1]
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - length + 1):
            part = data[at : at + length]
            if part in seen:
                gone[at : at + length] = True
            seen.add(part)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out[key] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return sorted(((i, *out[i, d]) for i, d in rows), key=repr)


def result(spark, rows, length=100):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in suffixes.remove_repeats(docs, length=length).collect()), key=repr)


def test_cover_has_every_difference():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))


def test_generated_documents(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert result(spark, rows) == brute(rows)


def test_awkward_documents(spark):
    rows = [(r[0], r[1]) for r in small.documents()]
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("length", [30, 100, 150])
def test_shared_passages_and_periods(spark, length):
    passages = [small.prose(50 + i, 30) for i in range(6)]
    rows = [(i, small.prose(i, 5) + passages[i % 6] + "-" * (i * 7) + passages[(i * 5 + 1) % 6][: 40 + 9 * i]) for i in range(24)]
    rows += [(100, "abc" * 150), (101, "bca" * 150), (102, "zz" + "abc" * 60), (50, passages[0]), (3, passages[0])]
    assert result(spark, rows, length) == brute(rows, length)


def test_many_batches_and_small_sorts(spark, data, monkeypatch):
    monkeypatch.setattr(suffixes, "SORT_BYTES", 2000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
        assert result(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_chunks_keep_grams_whole():
    grams = np.array([1, 1, 2, 3, 3, 3, 9])
    parts = list(suffixes._chunks(grams, [suffixes.SORT_BYTES // 2] * 7))
    assert [i for p in parts for i in range(p.start, p.stop)] == list(range(7))
    assert all(p.stop == 7 or grams[p.stop - 1] != grams[p.stop] for p in parts) and len(parts) > 2
    assert list(suffixes._chunks(grams[:0], [])) == []


def test_suffixes_come_sorted():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, 700).astype(np.uint8)
    starts = np.arange(0, 600)
    order = suffixes.sorted_suffixes(text, starts)
    for residue in range(suffixes.PERIOD):
        mine = [i for i in order if starts[i] % suffixes.PERIOD == residue]
        heads = [text.tobytes()[starts[i] : starts[i] + 4 * suffixes.PERIOD].ljust(124, b"\0") for i in mine]
        assert heads == sorted(heads)


def test_long_text_in_pieces(spark, monkeypatch):
    text = small.prose(9, 150_000)
    rows = [(1, text), (2, "head " + text[300_000:900_000])]
    assert result(spark, rows) == brute(rows)
