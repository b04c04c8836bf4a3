"""Periodic runs against a plain scan of every lag, and the contract's planting."""

import hashlib
import zlib

import pyarrow.dataset as ds
import small

from panelift.llm import periods
from panelift.llm.queries import QUERIES


def smallest_period(r):
    return next(q for q in range(1, len(r) + 1) if all(r[i] == r[i + q] for i in range(len(r) - q)))


def plain_runs(w):
    """Every maximal stretch at every lag, kept if long enough and of that smallest period."""
    n, out = len(w), []
    for p in range(1, n // 4 + 1):
        x = 0
        while x + p < n:
            if w[x] != w[x + p]:
                x += 1
                continue
            s = x
            while x + p < n and w[x] == w[x + p]:
                x += 1
            region = w[s : x + p]
            if len(region) >= max(6, 4 * p) and smallest_period(region) == p:
                out.append((s, len(region), p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def ids(words):
    index = {}
    return [index.setdefault(x, len(index)) for x in words]


def check(words):
    import numpy as np

    w = ids(words)
    assert periods.runs(np.array(w, np.int64)) == plain_runs(w), words


def test_small_sequences():
    check("a a a a a a".split())
    check("a a a a a".split())
    check("a b a b a b a b".split())
    check("x a b c a b c a b c a b c y".split())
    check("a a b a a b a a b a a b a a b a a".split())
    check("a b b a a b b a a b b a a b b a a b b a".split())
    check(("x y z x y z w " * 6).split())
    check(("p q " * 10 + "r " + "s t u " * 5 + "s t").split())
    check([])


def test_random_sequences():
    import random

    rng = random.Random(7)
    for _ in range(300):
        alphabet = rng.randint(1, 4)
        n = rng.randint(0, 60)
        words = [str(rng.randrange(alphabet)) for _ in range(n)]
        if rng.random() < 0.5 and n > 8:
            a, p = rng.randrange(n // 2), rng.randint(1, 6)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        check(words)


def test_given_documents_match_plain_scan():
    texts = ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table(columns=["doc_id", "text"]).to_pydict()
    planted = 0
    for doc_id, text in list(zip(texts["doc_id"], texts["text"]))[:300]:
        words = periods.planted(doc_id, periods.WORD.findall(text or ""))
        planted += words != periods.WORD.findall(text or "")
        check(words)
    assert planted > 5


def test_planting_follows_the_contract():
    doc_id = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    words = [f"w{i}" for i in range(50)]
    a = g % 50
    p = 1 + (50 - a) // (3 + g % 8)
    assert periods.planted(doc_id, words) == words[:a] + [f"w{a + (i - a) % p}" for i in range(a, 50)]
    assert periods.planted(doc_id + 1 if zlib.crc32(str(doc_id + 1).encode()) % 10 else doc_id + 2, words) == words
    assert periods.planted(None, words) == words and periods.planted(doc_id, []) == []


def test_describe_row():
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    doc_id = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10)
    row = periods.describe(doc_id, "x a b a b a b a b y\tq q q q q q q")
    assert row == (doc_id, 2, 10, 7, 1, 7000, sha("1,8,2\n10,7,1\n"), sha("x a b y q"))
    assert periods.describe(doc_id, None) == (doc_id, 0, None, None, None, None, sha(""), sha(""))
    tie = periods.describe(doc_id, "a b a b a b a b c c c c c c c c")  # 8/2 against 8/1
    assert tie[2:6] == (8, 8, 1, 8000)


def test_awkward_and_empty_tables(spark, awkward, empty):
    got = QUERIES["op11_periodic_runs"](spark, awkward)
    assert got.columns[:2] == ["doc_id", "n_runs"]
    rows = got.collect()
    assert len(rows) == len(small.documents())
    assert all(r["runs_sha256"] and r["collapsed_sha256"] for r in rows)
    assert QUERIES["op11_periodic_runs"](spark, empty).collect() == []
