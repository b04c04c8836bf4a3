"""Personal data: base kinds by hand-checked cases and against DuckDB's matches, names by EM."""

import hashlib

import duck
import numpy as np
import small

from panelift.llm import private
from panelift.llm.queries import QUERIES


def test_base_kinds_by_hand():
    text = (
        "mail ann.lee+x@mail.example.org or bad@host, ip 10.0.0.255 and 10.0.0.256, "
        "card 4111 1111 1111 1111 and 4111 1111 1111 1112, call +1 (555) 010-9999 or +12 345, né +44 20 7946 0958"
    )
    spans = private.base_spans(text)
    found = {(k, text[s:e]) for k, s, e in spans}
    assert found == {
        ("email", "ann.lee+x@mail.example.org"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"),
        ("phone", "+1 (555) 010-9999"), ("phone", "+44 20 7946 0958"),
    }
    start = text.index("+44")
    assert ("phone", start, start + len("+44 20 7946 0958")) in spans  # code points, not bytes


def test_failing_matches_are_not_retried():
    # the card expression takes all 20 digits; a 20-digit run fails and no shorter part is tried
    assert private.base_spans("4111111111111111" + "0000") == []
    assert private.base_spans("1.2.3.4.5") == [("ip", 0, 7)]
    assert private.base_spans("300.1.1.1") == []


def test_em_recovers_reliabilities():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.3
    accuracy = np.array([0.9, 0.8, 0.7, 0.95, 0.6, 0.85, 0.75, 0.65])
    votes = np.where(rng.random((20000, 8)) < accuracy, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random((20000, 8)) < 0.4] = -1
    patterns = {}
    for row in map(tuple, votes):
        patterns[row] = patterns.get(row, 0) + 1
    prior, found = private.estimate(list(patterns.items()))
    assert abs(prior - 0.3) < 0.03
    assert np.abs(found - accuracy).max() < 0.05


def test_against_duckdb_matches(spark, data):
    con = duck.connect(data)
    sql = "select doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')) as n from documents"
    want = dict(con.execute(sql).fetchall())
    got = {r["doc_id"]: r["n_email"] for r in QUERIES["op12_pii"](spark, data).collect()}
    assert got == want and sum(want.values()) > 0


def test_names_and_awkward_tables(spark, tmp_path):
    texts = ["Please contact Dr. Maria Lopez at maria.lopez@example.com today.", "The Old Bank Road is closed.",
             None, "", "x" * 100000 + " reach +1 555 010 9999", "Mr. John Smith said yes. Mary Jones wrote back."]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[5])]
    folder = small.write(str(tmp_path), documents=rows)
    got = QUERIES["op12_pii"](spark, folder).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["spans"]) for r in got}
    first = [r for r in got if r["doc_id"] == 0]
    assert len(first) == 2 and first[0]["spans"] == first[1]["spans"]
    assert "name:19:30" in first[0]["spans"] and first[0]["n_email"] == 1
    assert all(r["base_sha256"] == hashlib.sha256(",".join(s for s in r["spans"].split(",") if s and not s.startswith("name")).encode()).hexdigest() for r in got)
    assert next(r for r in got if r["doc_id"] == 2)["spans"] == "" and len(by) >= 5
    assert next(r for r in got if r["doc_id"] == 4)["n_phone"] == 1


def test_empty_table(spark, empty):
    assert QUERIES["op12_pii"](spark, empty).collect() == []
