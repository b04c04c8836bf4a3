"""Every query with a SQL twin gives the twin's rows, on generated tables and on awkward ones; all bear empty tables."""

import duck
import pytest

from panelift.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, data, name):
    assert duck.compare(QUERIES[name](spark, data), duck.connect(data), ORACLES[name]) == []


@pytest.mark.parametrize("name", ["op1_license_scans", "op2_ngram_jaccard_join", "op3_substring_dedup"])
def test_matches_sql_on_awkward_rows(spark, awkward, name):
    assert duck.compare(QUERIES[name](spark, awkward), duck.connect(awkward), ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, data, name):
    frame = QUERIES[name](spark, empty)
    assert frame.count() == 0
    assert frame.dtypes == QUERIES[name](spark, data).dtypes


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.split("_")[0] in ("op1", "op2", "op3", "op4", "op6", "op8")))
def test_one_row_per_document(spark, awkward, name):
    ids = [r.doc_id for r in QUERIES[name](spark, awkward).collect()]
    want = [r.doc_id for r in spark.read.parquet(f"{awkward}/documents.parquet").collect()]
    key = lambda x: (x is None, x or 0)
    assert sorted(ids, key=key) == sorted(want, key=key)


def test_eleven_queries():
    from __spark_entry__ import queries

    assert [n for n in range(1, 11) if sum(q.startswith(f"op{n}_") for q in queries()) != 1] == []
    assert "pipeline" in queries()
