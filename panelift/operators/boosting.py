"""Gradient boosting that learns where missing values go, from second-order histograms.

Squared loss: every row has gradient g = prediction - target and hessian h = 1. A tree grows one level
per pass over the rows: the sums of g and h per (node, feature, bin) come from one grouped aggregation,
with missing values in a bin of their own. For each node, feature and threshold the gain is worked out
twice, once with the missing values on the left and once on the right; the best split keeps its
direction, so rows with a gap follow the side that fits them better. Leaf weights are -G / (H + lambda).

Thresholds are the distinct values of a feature when it has at most ``max_bins`` of them, else its
approximate quantiles; both come from one aggregation over all rows. The driver holds the histograms of
one level (nodes x features x bins, bounded by the parameters) and the trees. The rows with their
running prediction are written to the shared folder every few trees, so lineage stays short.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelift.session import spill

TREES, DEPTH, RATE = 100, 6, 0.3
LAMBDA, MIN_CHILD_WEIGHT = 1.0, 1.0
MAX_BINS = 64
SPILL_EVERY = 5


@dataclass
class Tree:
    """Splits {node: (feature index, threshold, missing goes left)}, leaves {node: weight}, gains {node: gain}.

    A row goes left when its value is at most the threshold, or when it is missing and the split says so.
    Node n has children 2n + 1 (left) and 2n + 2 (right).
    """

    splits: dict[int, tuple[int, float, bool]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)
    gains: dict[int, float] = field(default_factory=dict)


@dataclass
class Booster:
    features: list[str]
    base: float
    rate: float
    trees: list[Tree]
    thresholds: list[list[float]]

    def expression(self) -> Column:
        """The model's prediction as one Spark expression (NaN counts as missing)."""
        x = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in self.features]
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + F.lit(self.rate) * _walk(tree, 0, x)
        return total


def _walk(tree: Tree, node: int, x: list[Column]) -> Column:
    if node in tree.leaves:
        return F.lit(tree.leaves[node])
    f, at, left_missing = tree.splits[node]
    goes_left = x[f] <= F.lit(at)
    goes_left = F.coalesce(goes_left, F.lit(left_missing))
    return F.when(goes_left, _walk(tree, 2 * node + 1, x)).otherwise(_walk(tree, 2 * node + 2, x))


def thresholds(df: DataFrame, features: Sequence[str], max_bins: int = MAX_BINS) -> list[list[float]]:
    """Per feature: its distinct values if at most ``max_bins``, else ``max_bins`` approximate quantiles."""
    counts = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in features]).first()
    wanted = [F.array_sort(F.collect_set(c)).alias(c) if counts[c] <= max_bins else
              F.percentile_approx(c, [i / max_bins for i in range(1, max_bins)], 10_000).alias(c) for c in features]
    row = df.agg(*wanted).first()
    return [sorted({float(v) for v in (row[c] or [])}) for c in features]


def best_split(hist: dict[int, tuple[np.ndarray, np.ndarray, float, float]], lam: float, min_child: float):
    """(gain, feature, bin, missing left) of the best split of one node, or None.

    ``hist`` maps feature -> (g per bin, h per bin, g of missing, h of missing); a split at bin k sends
    bins 0..k left. Ties go to the smaller feature, then the smaller bin, then missing on the right.
    """
    best = None
    for f in sorted(hist):
        g, h, gm, hm = hist[f]
        gt, ht = g.sum() + gm, h.sum() + hm
        parent = gt * gt / (ht + lam)
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        for left_missing in (False, True):
            a_g, a_h = (gl + gm, hl + hm) if left_missing else (gl, hl)
            b_g, b_h = gt - a_g, ht - a_h
            ok = (a_h >= min_child) & (b_h >= min_child)
            gain = a_g * a_g / (a_h + lam) + b_g * b_g / (b_h + lam) - parent
            gain = np.where(ok, gain, -np.inf)
            if len(gain) == 0:
                continue
            k = int(np.argmax(gain))
            if gain[k] > 1e-12 * (abs(parent) + 1) and (best is None or gain[k] > best[0] + 1e-12 * abs(best[0])):
                best = (float(gain[k]), f, k, left_missing)
    return best


def fit(df: DataFrame, target: str, features: Sequence[str], trees: int = TREES, depth: int = DEPTH, rate: float = RATE,
        lam: float = LAMBDA, min_child: float = MIN_CHILD_WEIGHT, max_bins: int = MAX_BINS) -> Booster:
    """Boosted regression trees with learnt directions for missing values.

    Rows without a target are left out; NaN features count as missing. The first prediction is the mean
    target. A node splits while its best gain is positive and both sides keep ``min_child`` rows.
    """
    features = list(features)
    width = len(features)
    rows = df.select(
        *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"_x{i}") for i, c in enumerate(features)],
        F.col(target).cast("double").alias("_y"),
    ).where(F.col("_y").isNotNull() & ~F.isnan("_y"))
    cuts = thresholds(rows, [f"_x{i}" for i in range(width)], max_bins)

    def bin_of(i: int) -> Column:
        below = F.size(F.filter(F.array(*[F.lit(t) for t in cuts[i]]), lambda t: t < F.col(f"_x{i}"))) if cuts[i] else F.lit(0)
        return F.when(F.col(f"_x{i}").isNull(), -1).otherwise(below)

    base = float(rows.agg(F.avg("_y")).first()[0] or 0.0)
    state = spill(rows.select("_y", *[bin_of(i).alias(f"_b{i}") for i in range(width)]).withColumn("_p", F.lit(base)), "boost")
    model = Booster(features, base, rate, [], cuts)
    for t in range(trees):
        grown = _grow(state, width, cuts, depth, lam, min_child)
        state = state.withColumn("_p", F.col("_p") + F.lit(rate) * _leaf_of(grown))
        if (t + 1) % SPILL_EVERY == 0:
            state = spill(state, "boost")
        splits = {n: (f, cuts[f][int(k)], left) for n, (f, k, left) in grown.splits.items()}
        model.trees.append(Tree(splits, dict(grown.leaves), dict(grown.gains)))
    return model


def _route(tree: Tree, n: int, at_leaf) -> Column:
    """Walk binned rows (columns _b*) down ``tree``; ``at_leaf(n)`` is the value where a row stops."""
    if n not in tree.splits:
        return at_leaf(n)
    f, k, left_missing = tree.splits[n]
    b = F.col(f"_b{f}")
    left = F.when(b == -1, F.lit(left_missing)).otherwise(b <= F.lit(int(k)))
    return F.when(left, _route(tree, 2 * n + 1, at_leaf)).otherwise(_route(tree, 2 * n + 2, at_leaf))


def _leaf_of(tree: Tree) -> Column:
    return _route(tree, 0, lambda n: F.lit(tree.leaves.get(n, 0.0)))


def _grow(state: DataFrame, width: int, cuts: list[list[float]], depth: int, lam: float, min_child: float) -> Tree:
    """One tree over binned rows, a level per pass; its splits hold bin numbers."""
    tree = Tree()
    open_nodes = {0}
    g = F.col("_p") - F.col("_y")
    for level in range(depth + 1):
        node = _route(tree, 0, F.lit)
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"_b{i}").alias("b")) for i in range(width)]))
        stacked = state.select(node.alias("_node"), g.alias("_g"), pairs.alias("_fb")).where(F.col("_node").isin(sorted(open_nodes)))
        hist = stacked.groupBy("_node", "_fb.f", "_fb.b").agg(F.sum("_g").alias("g"), F.count(F.lit(1)).cast("double").alias("h"))
        table: dict[int, dict[int, list]] = {}
        for r in hist.collect():  # nodes x features x bins of one level: bounded by the parameters
            table.setdefault(r["_node"], {}).setdefault(r["f"], []).append((r["b"], r["g"], r["h"]))
        nxt = set()
        for n in sorted(open_nodes):
            per = table.get(n)
            if not per:
                continue
            found = None
            if level < depth:
                hists = {}
                for f, cells in per.items():
                    gb, hb = np.zeros(len(cuts[f]) + 1), np.zeros(len(cuts[f]) + 1)
                    gm = hm = 0.0
                    for b, gv, hv in cells:
                        if b == -1:
                            gm, hm = gv, hv
                        else:
                            gb[b], hb[b] = gv, hv
                    hists[f] = (gb, hb, gm, hm)
                found = best_split(hists, lam, min_child)
            if found is None:
                cells = per[min(per)]
                gt, ht = sum(c[1] for c in cells), sum(c[2] for c in cells)
                tree.leaves[n] = -gt / (ht + lam)
            else:
                gain, f, k, left_missing = found
                tree.splits[n], tree.gains[n] = (f, float(k), left_missing), gain
                nxt |= {2 * n + 1, 2 * n + 2}
        if not nxt:
            break
        open_nodes = nxt
    return tree
