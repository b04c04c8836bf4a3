"""Components, near duplicates and top-k beyond what the twins show."""

import random

import duck
import numpy as np
import small

from panelift.llm import nearjoin, topk
from panelift.llm.components import connected_components
from panelift.llm.queries import ORACLES, QUERIES


def roots(edges):
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[top(a)] = top(b)
    return {x: top(x) for x in list(root)}


def groups(pairs):
    out = {}
    for node, label in pairs:
        out.setdefault(label, set()).add(node)
    return sorted(map(sorted, out.values()))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(100)] + [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(300)]
    frame = spark.createDataFrame([*edges, edges[0], (None, 3), (4, None)], "a long, b long")
    assert groups(tuple(r) for r in connected_components(frame).collect()) == groups(roots(edges).items())
    assert connected_components(frame.limit(0)).count() == 0


def test_large_near_group_meets_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nearjoin, "BLOCK", 7)
    base = small.prose(11, 120).split(" ")
    rows = []
    for i in range(60):
        text = list(base)
        text[(i * 3) % 120] = f"edit{i}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, rows[i % 4][1]) for i in range(12)] + [(200 + i, small.prose(300 + i, 50)) for i in range(20)]
    folder = small.write(str(tmp_path), documents=[(*r, "en", "s", 1) for r in rows])
    assert duck.compare(QUERIES["op2_ngram_jaccard_join"](spark, folder), duck.connect(folder), ORACLES["op2_ngram_jaccard_join"]) == []


def test_prefix_shortens_until_recall():
    for similarity in (0.6, 0.8, 0.95):
        depth = nearjoin.prefix_depth(similarity, 24, 8, 0.999)
        met = lambda d: 1 - (1 - similarity**d) ** 24  # noqa: E731, B023
        assert depth == 1 or met(depth) >= 0.999
        assert depth == 8 or met(depth + 1) < 0.999


def test_common_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (0, 1, 50, 4000, 6000, 6000)]
    got = nearjoin.common_counts(sets[:3], sets)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:3]]


VECTORS = [(0, [1.0, 0.5]), (50, [1.0, 0.5]), (100, [-1.0, 2.0, 3.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]),
           (5, []), (6, [0.0039, -0.0001]), (7, [1.0, 0.5]), (8, [3e5, -2e5]), (None, [1.0, 1.0]), (9, [2.0, 2.0, 2.0])]


def test_top_k_on_awkward_vectors(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    rows = VECTORS + [(200 + i, rng.normal(size=16).round(2).tolist()) for i in range(400)]
    folder = small.write(str(tmp_path), embeddings=[(*r, 1) for r in rows])
    monkeypatch.setattr(topk, "ROW_BLOCK", 37)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    assert duck.compare(QUERIES["op9_exact_top_k"](spark, folder), duck.connect(folder), ORACLES["op9_exact_top_k"]) == []


def test_repeated_ids_count_once(spark):
    frame = spark.createDataFrame([(50, [1.0]), (50, [1.0]), (1, [2.0]), (1, [1.0])], "vec_id long, embedding array<float>")
    rows = topk.integer_vectors(frame)
    assert [tuple(r) for r in topk.top_k(rows.where("id = 50"), rows).collect()] == [(50, 1, 1, 256 * 256)]


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.integers(-300, 300, (50, 37)).astype(float)
    exact = x @ x.T
    for segments in topk.RESOLUTIONS:
        s = topk.segment_statistics(x, segments)
        assert (s @ s.T >= exact - 1e-6).all()
