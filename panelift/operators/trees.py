"""Boosted trees and additive tree attributions."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache
from math import factorial, lgamma, log
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from panelift.functions.columns import label_encode
from panelift.session import ensure_checkpoint_dir, remove, scratch_path, spill

TREES = 200
RATE = 0.05
DEPTH = 6
FOREST_TREES = 100
FOREST_DEPTH = 10
SEED = 42
MISSING = 1e300


def encode_features(df: DataFrame, features: Sequence[str], labels: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Text features become {name}_code by sorted label order; numbers stay."""
    kinds = dict(df.dtypes)
    text = [c for c in features if kinds[c] == "string"]
    out = label_encode(df, text, labels) if text else df
    return out, [f"{c}_code" if c in text else c for c in features]


def gaps_filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A missing value counts as greater than every other, so that a tree can split gaps off at its last threshold."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(MISSING)) for c in columns})


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    """One vector of the columns; fill gaps first (``gaps_filled``)."""
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid="error").transform(df)


#: Bins of a feature, as Spark ML's trees have them; value counts up to EXACT_VALUES are taken one by one, others by SKETCH quantiles.
BINS, EXACT_VALUES, SKETCH = 32, 20_000, 2_048
#: Lets the learner look at up to SPLIT_BINS ** 2 folded rows for its splits, so that it meets every bin.
SPLIT_BINS = 1_024
CELLS_PER_TASK, MOST_PER_TASK = 10_000, 1_000_000
#: Combinations of bins x trees whose samples are stored at a time (about 9 bytes each), trees grown at a time, and combinations in a task of one.
BLOCK_VALUES, FITS, TREE_CELLS_PER_TASK = 50_000_000, 8, 100_000
#: Samples of so few combinations of bins may be empty (a sample of more than 100 rows is so with probability e^-100).
FEW_CELLS = 100
#: Folded rows that ``bootstrap_cells`` collects before it hands them on (16 bytes a tree each).
HAND_ON = 2_000


def bin_cuts(rows: DataFrame, columns: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Per column the thresholds between its bins: all midpoints if few values, else about equal shares of the rows.

    The rule is that of Spark ML's trees on value counts, but over all rows instead of a sample of 10,000. Columns of
    more than about EXACT_VALUES values are counted by SKETCH quantiles. ``rows`` holds numbers without gaps.
    """
    figures = rows.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(c).alias(f"_d{i}") for i, c in enumerate(columns)]).first()
    n = figures["n"]
    exact = [i for i in range(len(columns)) if figures[f"_d{i}"] <= EXACT_VALUES]
    counts: dict[int, list[tuple[float, float]]] = {i: [] for i in range(len(columns))}
    if exact:
        long = rows.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(columns[i]).alias("v")) for i in exact])))
        for r in long.groupBy("i", "v").count().collect():  # columns x EXACT_VALUES at most
            counts[r["i"]].append((r["v"], float(r["count"])))
    wide = [i for i in range(len(columns)) if i not in exact]
    if wide:
        shares = [k / SKETCH for k in range(SKETCH + 1)]
        row = rows.agg(*[F.percentile_approx(columns[i], shares, 100_000).alias(f"_q{i}") for i in wide]).first()
        for i in wide:
            values, times = np.unique(np.array(row[f"_q{i}"], float), return_counts=True)
            counts[i] = [(v, t * n / (SKETCH + 1)) for v, t in zip(values.tolist(), times.tolist())]
    return [_cuts(sorted(counts[i]), min(bins, n) - 1, n) for i in range(len(columns))]


def _cuts(counts: list[tuple[float, float]], most: int, n: int) -> np.ndarray:
    between = [(a + b) / 2 for (a, _), (b, _) in zip(counts, counts[1:])]
    if len(between) <= most:
        return np.unique(between)
    stride = n / (most + 1)
    found, seen, target = [], counts[0][1], stride
    for k in range(1, len(counts)):
        before, seen = seen, seen + counts[k][1]
        if abs(before - target) < abs(seen - target):
            found.append(between[k - 1])
            target += stride
    return np.unique(found)


def with_bins(df: DataFrame, columns: Sequence[str], cuts: Sequence[np.ndarray]) -> DataFrame:
    """``df`` with _b0, _b1, ...: the number of thresholds below each column's value (missing values: above all)."""
    values = [f"_x_b{i}" for i in range(len(columns))]
    filled = gaps_filled(df.select("*", *[F.col(c).alias(v) for c, v in zip(columns, values)]), values)
    # a bucket begins at its least value, and a value above a threshold is at least the next number
    starts = [np.nextafter(c[c < np.inf], np.inf).tolist() for c in map(np.asarray, cuts)]
    cut = [i for i, s in enumerate(starts) if s]
    if cut:
        buckets = Bucketizer(
            splitsArray=[[-np.inf, *starts[i], np.inf] for i in cut], inputCols=[values[i] for i in cut], outputCols=[f"{values[i]}_at" for i in cut],
            handleInvalid="keep",
        )
        filled = buckets.transform(filled)
    number = lambda i: F.col(f"{values[i]}_at").cast("int") if i in cut else F.lit(0)
    return filled.select(*df.columns, *[number(i).alias(f"_b{i}") for i in range(len(columns))])


def fold(rows: DataFrame, target: str, columns: Sequence[str], cuts: list[np.ndarray] | None = None) -> tuple[DataFrame, list[np.ndarray]]:
    """(one row per combination of bins with "features", the mean target and "_weight", its number of rows; cuts).

    A split of squared loss only sees a bin's number of rows and sum of targets, so trees grown on these rows are the
    trees of all rows. "features" holds bin numbers from 1 on; ``unfold`` gives the fitted model its thresholds.
    """
    cuts = cuts or bin_cuts(rows, columns)
    bins = [f"_b{i}" for i in range(len(columns))]
    cells = with_bins(rows, columns, cuts).groupBy(*bins).agg(F.avg(target).alias(target), F.count(F.lit(1)).cast("double").alias("_weight"))
    cells = cells.select(target, "_weight", *[(F.col(b) + 1).cast("double").alias(b) for b in bins])
    stored = spill(cells, "cells")
    count, cores = stored.count(), rows.sparkSession.sparkContext.defaultParallelism
    # each level is one pass over these rows: few of them make few tasks, many use every core
    parts = max(1, min(cores, -(-count // CELLS_PER_TASK)), -(-count // MOST_PER_TASK))
    return assemble(stored, bins).select("features", target, "_weight").repartition(parts), cuts


def unfold(spark, paths: Sequence[str], cuts: Sequence[np.ndarray]):
    """Models fitted on folded rows and stored under ``paths`` as one on the columns' own values: thresholds of values, counts of rows.

    Several one-tree forests become one forest, its trees in the order of ``paths``.
    """
    whole = scratch_path(spark, "unfolded")
    table = F.array(*[F.array(*[F.lit(float(v)) for v in c]).cast("array<double>") for c in cuts])
    node, split = F.col("nodeData"), F.col("nodeData.split")
    at = F.get(F.get(table, split["featureIndex"]), (F.floor(F.get(split["leftCategoriesOrThreshold"], F.lit(0))) - 1).cast("int"))
    inner = F.when(node["leftChild"] >= 0, F.array(at)).otherwise(split["leftCategoriesOrThreshold"])
    rows = F.get(node["impurityStats"], F.lit(0)).cast("long")
    changed = node.withField("split", split.withField("leftCategoriesOrThreshold", inner)).withField("rawCount", rows)
    data, trees = spark.read.parquet(*[f"{p}/data" for p in paths]), spark.read.parquet(*[f"{p}/treesMetadata" for p in paths])
    metadata = spark.read.text(f"{paths[0]}/metadata")
    if len(paths) > 1:
        place = F.element_at(F.split("_metadata.file_path", "/"), -3).cast("int")  # {tree}/data/{file}
        data, trees = data.withColumn("treeID", place), trees.withColumn(trees.columns[0], place)
        counted = F.regexp_replace("value", r'"numTrees":1\b', f'"numTrees":{len(paths)}')
        metadata = metadata.withColumn("value", counted)
    data.withColumn("nodeData", changed).write.parquet(f"{whole}/data")
    trees.write.parquet(f"{whole}/treesMetadata")
    metadata.coalesce(1).write.text(f"{whole}/metadata")
    return DefaultParamsReader.loadParamsInstance(whole, spark)


def training_rows(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Columns and target as numbers; rows without a target are left out, gaps filled."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*columns, target])]).na.drop(subset=[target])
    return gaps_filled(rows, columns)


def fit_gbt(
    df: DataFrame, target: str, columns: Sequence[str], trees: int = TREES, rate: float = RATE, depth: int = DEPTH, seed: int = SEED,
    cuts: list[np.ndarray] | None = None,
):
    """Gradient-boosted regression trees on numeric columns, grown on the folded rows (``fold``).

    ``cuts`` gives the ``bin_cuts`` of ``df``'s training rows where they are known already.
    """
    ensure_checkpoint_dir(df.sparkSession)
    cells, cuts = fold(training_rows(df, target, columns), target, columns, cuts)
    learner = GBTRegressor(
        featuresCol="features", labelCol=target, weightCol="_weight", maxIter=trees, stepSize=rate, maxDepth=depth, seed=seed,
        maxBins=SPLIT_BINS, checkpointInterval=10,
    )
    path = scratch_path(df.sparkSession, "binned")
    learner.fit(cells).write().save(path)
    return unfold(df.sparkSession, [path], cuts)


def fit_forest(
    df: DataFrame, target: str, columns: Sequence[str], trees: int = FOREST_TREES, depth: int = FOREST_DEPTH, seed: int = SEED, bootstrap: bool = True,
    cuts: list[np.ndarray] | None = None,
):
    """Random forest regression trees on numeric columns, at most ``depth`` levels deep (10 unless given).

    Fully grown trees have as many leaves as training rows; at depth 10 a tree has at most 1,024 leaves, so the model
    that scoring broadcasts holds at most trees x 2,047 nodes whatever the input size.
    Each tree is grown by Spark ML on its own bootstrap sample, folded to one weighted row per combination of bins
    (``bootstrap_cells``), with a third of the features tried at each split; a single tree tries all. No row is kept
    once for all trees: what is stored grows with the combinations of bins. ``cuts`` as in ``fit_gbt``.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    alike, cuts = alike_rows(training_rows(df, target, columns), target, columns, cuts)
    bins = [f"_b{i}" for i in range(len(columns))]
    count, cores = alike.select(*bins).distinct().count(), spark.sparkContext.defaultParallelism
    parts = max(1, min(cores, -(-count // TREE_CELLS_PER_TASK)), -(-count // MOST_PER_TASK))  # trees grow side by side
    learner = RandomForestRegressor(
        featuresCol="features", labelCol=target, weightCol="_weight", numTrees=1, maxDepth=depth, bootstrap=False, maxBins=SPLIT_BINS,
        featureSubsetStrategy="all" if trees == 1 else "onethird", cacheNodeIds=depth > FOREST_DEPTH, checkpointInterval=10,
    )
    folder = scratch_path(spark, "forest")

    def grow(tree: int, sample: DataFrame) -> None:
        mine = sample.where(F.col(f"_w{tree}") > 0).select(*bins, F.col(f"_m{tree}").alias(target), F.col(f"_w{tree}").alias("_weight"))
        if count <= FEW_CELLS and mine.isEmpty():  # none of a few rows was drawn: the tree takes each once
            mine = alike.select(*bins, target, F.col("_n").cast("double").alias("_weight"))
        data = assemble(mine, bins).select("features", target, "_weight").coalesce(parts)
        learner.copy({learner.seed: seed + tree}).fit(data).write().save(f"{folder}/{tree}")

    block = max(1, min(trees, BLOCK_VALUES // max(count, 1)))
    with ThreadPool(FITS) as pool:
        for first in range(0, trees, block):
            numbers = range(first, min(first + block, trees))
            path = scratch_path(spark, "bootstrap")
            bootstrap_cells(alike, target, bins, numbers, seed if bootstrap else None).write.parquet(path)
            sample = spark.read.parquet(path)
            run = inheritable_thread_target(spark)(lambda tree, sample=sample: grow(tree, sample))
            for _ in pool.imap_unordered(run, numbers):
                pass
            remove(spark, path)
    model = unfold(spark, [f"{folder}/{tree}" for tree in range(trees)], cuts)
    model.set(model.bootstrap, bootstrap)
    model.set(model.featureSubsetStrategy, "auto")
    return model


def alike_rows(rows: DataFrame, target: str, columns: Sequence[str], cuts: list[np.ndarray] | None = None) -> tuple[DataFrame, list[np.ndarray]]:
    """(one row per combination of bins and target value with "_n", its number of rows, stored by combination; cuts).

    ``rows`` holds numbers without gaps. "_b0", ... are bin numbers from 1 on, "_hash" tells the rows apart. Slices of
    the order share the rows evenly, so a combination of bins that very many rows have fills several. Bin numbers are
    packed while rows are dealt out, ordered and stored: one short key to compare, and little to move.
    """
    cuts = cuts or bin_cuts(rows, columns)
    width = (BINS - 1).bit_length()
    each = 63 // width
    packs = [f"_p{k}" for k in range(-(-len(columns) // each))]
    at = [width * (each - 1 - i % each) for i in range(len(columns))]  # the order by packs is the order by bins
    packed = [F.lit(0).cast("long") for _ in packs]
    for i in range(len(columns)):
        packed[i // each] += F.shiftleft(F.col(f"_b{i}").cast("long"), at[i])
    alike = with_bins(rows, columns, cuts).select(*[c.alias(p) for c, p in zip(packed, packs)], target).groupBy(*packs, target).agg(F.count(F.lit(1)).alias("_n"))
    stored = spill(alike.repartitionByRange(*packs, target).sortWithinPartitions(*packs, target), "alike")
    bare = [F.shiftright(packs[i // each], at[i]).bitwiseAND(F.lit(2**width - 1).cast("long")).cast("int") for i in range(len(columns))]
    numbers = [(c + 1).cast("double").alias(f"_b{i}") for i, c in enumerate(bare)]
    return stored.select(*numbers, target, "_n", F.xxhash64(*bare, target).alias("_hash")), cuts


def bootstrap_cells(alike: DataFrame, target: str, bins: Sequence[str], trees: Sequence[int], seed: int | None) -> DataFrame:
    """Bootstrap samples of ``alike_rows``, folded: bins, and per tree its drawn rows "_w{tree}" and their mean target "_m{tree}".

    Each row is drawn a Poisson(1) number of times, as Spark ML draws; c rows alike in bins and target together Poisson(c)
    times. The draws depend on the rows and the tree's number only, not on partitions. Without ``seed`` every row is drawn
    once. A combination of bins may come in several rows; a split of squared loss sees their sums.
    """
    numbers = np.array(list(trees), np.uint64)
    schema = ", ".join([*[f"{b} double" for b in bins], *[f"_w{t} double, _m{t} double" for t in trees]])

    def borders(at: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(axis=1)])

    def folded(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
        """One row per combination of bins that follow each other, whatever the batches they came in."""
        at, weight, total = np.concatenate([h[0] for h in held]), np.hstack([h[1] for h in held]), np.hstack([h[2] for h in held])
        starts = borders(at)
        weight, total = np.add.reduceat(weight, starts, axis=1), np.add.reduceat(total, starts, axis=1)
        mean = np.divide(total, weight, out=np.zeros_like(total), where=weight > 0)
        found = dict(zip(bins, at[starts].T))
        for k, t in enumerate(numbers.tolist()):
            found[f"_w{t}"], found[f"_m{t}"] = weight[k], mean[k]
        return pd.DataFrame(found)

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for part in batches:
            if part.empty:
                continue
            at, n, y = part[list(bins)].to_numpy(float), part["_n"].to_numpy(np.int64), part[target].to_numpy(float)
            starts = borders(at)
            weight, total, product = np.empty((len(numbers), len(starts))), np.empty((len(numbers), len(starts))), np.empty(len(y))
            keys = part["_hash"].to_numpy(np.int64).view(np.uint64)
            draws = enumerate(n.astype(float) for _ in numbers) if seed is None else _draws(keys, n, numbers, seed)
            for k, times in draws:
                np.add.reduceat(times, starts, out=weight[k])
                np.add.reduceat(np.multiply(times, y, out=product), starts, out=total[k])
            held.append((at[starts], weight, total))
            if sum(len(h[0]) for h in held) >= HAND_ON:
                yield folded(held)
                held = []
        if held:
            yield folded(held)

    return alike.select(*bins, target, "_n", "_hash").mapInPandas(drawn, schema)


def poisson_draws(keys: np.ndarray, means: np.ndarray, streams: np.ndarray, seed: int) -> np.ndarray:
    """(rows, streams) Poisson numbers by inversion: a row's means[row], from a uniform hash of its key, the stream and the seed."""
    out = np.empty((len(streams), len(means)))
    for k, times in _draws(keys.ravel(), means, streams, seed):
        out[k] = times
    return out.T


#: Streams drawn at a time: few stay in the processor's cache; where many means differ, each step should be long.
STREAMS, FEW_MEANS = 4, 16


def _draws(keys: np.ndarray, means: np.ndarray, streams: np.ndarray, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the stream, its Poisson number for every key) for all streams, hashes worked out in place."""
    salts = _scrambled(streams * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & (2**64 - 1)))
    alone = means.min() == means.max()
    order = slice(None) if alone else np.argsort(means, kind="stable")
    keys, given = keys[order], means[order]
    starts = np.flatnonzero(np.r_[True, given[1:] != given[:-1]])
    ends = [*starts[1:].tolist(), len(given)]
    step = STREAMS if len(starts) <= FEW_MEANS else len(streams)
    for first in range(0, len(streams), step):
        h = keys ^ salts[first : first + step, None]
        spare, times = np.empty_like(h), np.empty(h.shape)
        for _ in range(2):
            _scramble(h, spare)
        for start, end in zip(starts.tolist(), ends):
            times[:, start:end] = _inverted(h[:, start:end], float(given[start]))
        if not alone:
            sorted_, times = times, np.empty(h.shape)
            times[:, order] = sorted_
        yield from enumerate(times, first)


#: The top bits of a hash by which most draws are looked up, and draws at a time from which that is worth the table.
LOOKUP_BITS, LOOKUP_FROM = 14, 5_000


@lru_cache(maxsize=256)
def _poisson_steps(mean: float) -> tuple[int, np.ndarray]:
    """(least number, shares below each next one)."""
    width = int(12 * mean**0.5) + 25  # beyond, less than 1e-20 is left
    low = max(0, int(mean) - width)
    logs = [k * log(mean) - mean - lgamma(k + 1) for k in range(low, int(mean) + width)]
    return low, np.cumsum(np.exp(logs))


@lru_cache(maxsize=32)
def _poisson_lookup(mean: float) -> tuple[np.ndarray, np.ndarray]:
    """(number, whether others occur too) for all hashes with the same top bits."""
    low, steps = _poisson_steps(mean)
    first = np.arange(1 << LOOKUP_BITS) * 2.0**-LOOKUP_BITS
    least = np.searchsorted(steps, first, side="right")
    return (low + least).astype(float), least != np.searchsorted(steps, first + (2.0**-LOOKUP_BITS - 2.0**-53), side="right")


def _inverted(h: np.ndarray, mean: float) -> np.ndarray:
    """Poisson numbers of one mean for hashes: the number of steps up to each one's share of 2^64."""
    low, steps = _poisson_steps(mean)
    whole = lambda part: low + np.searchsorted(steps, (part >> np.uint64(11)).astype(float) * 2.0**-53, side="right").astype(float)
    if h.size < LOOKUP_FROM:
        return whole(h)
    number, several = _poisson_lookup(mean)
    top = (h >> np.uint64(64 - LOOKUP_BITS)).astype(np.intp)
    out, other = number.take(top), several.take(top)
    out[other] = whole(h[other])
    return out


def _scramble(h: np.ndarray, spare: np.ndarray) -> None:
    """``_scrambled`` in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
        np.bitwise_xor(h, np.right_shift(h, np.uint64(shift), out=spare), out=h)
        if factor:
            np.multiply(h, np.uint64(factor), out=h)


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def predict_trees(df: DataFrame, model, columns: Sequence[str], name: str = "prediction") -> DataFrame:
    scorer = model.copy({model.featuresCol: "_features", model.predictionCol: name})
    filled = gaps_filled(df.select(*[F.col(c).alias(f"_x_{c}") for c in columns], *df.columns), [f"_x_{c}" for c in columns])
    names = [f"_x_{c}" for c in columns]
    return scorer.transform(assemble(filled, names, "_features")).drop("_features", *names)


def tree_nodes(spark, model) -> tuple[pd.DataFrame, list[float]]:
    """Node table and tree weights. Its size is fixed by the model: at most trees x 2^(depth + 1) rows."""
    return model_nodes(spark, model).toPandas().sort_values(["treeID", "id"]), [float(w) for w in model.treeWeights]


class Attribution:
    """Exact path-dependent Shapley attributions of a tree ensemble.

    A leaf's contribution depends on a row only through which of the (few) features on its path
    agree with the path. For every leaf the attributions of all agreement patterns are worked out
    once. A row is reduced to its bin per feature (its place among the thresholds in use), and a
    leaf needs one look-up per feature for the pattern and one for the attributions.
    """

    def __init__(self, nodes: pd.DataFrame, weights: Sequence[float], width: int, normalize: bool = False):
        if (nodes.loc[nodes["leftChild"] >= 0, "categories"] >= 0).any():
            raise ValueError("categorical splits are not supported: encode categories as numbers")
        self.width = width
        self.base = 0.0
        inner = nodes[nodes["leftChild"] >= 0]
        thresholds = inner["at"].map(lambda v: float(v[0]))
        self.cuts = [np.unique(thresholds[inner["feature"] == f].to_numpy(dtype=float)) for f in range(width)]
        self.leaves: list[tuple[list[tuple[int, np.ndarray]], np.ndarray]] = []
        total = sum(weights) if normalize else 1.0
        for tree, part in nodes.groupby("treeID"):
            self._walk(part.set_index("id").to_dict("index"), 0, [], 1.0, float(weights[int(tree)]) / total)

    def _walk(self, rows: dict, at: int, path: list[tuple], share: float, weight: float) -> None:
        """``path`` holds (feature, bins that agree, share of training rows) per split."""
        node = rows[at]
        if node["leftChild"] < 0:
            self._leaf(path, share, float(node["prediction"]) * weight)
            return
        f, cover = int(node["feature"]), float(node["rawCount"])
        cut = int(np.searchsorted(self.cuts[f], float(node["at"][0])))
        low = np.arange(len(self.cuts[f]) + 1) <= cut
        for child, agrees in ((int(node["leftChild"]), low), (int(node["rightChild"]), ~low)):
            part = float(rows[child]["rawCount"]) / cover if cover > 0 else 0.5
            self._walk(rows, child, [*path, (f, agrees, part)], share * part, weight)

    def _leaf(self, path: list[tuple], share: float, value: float) -> None:
        self.base += share * value
        features = list(dict.fromkeys(f for f, _, _ in path))
        if not features:
            return
        d = len(features)
        zero = [float(np.prod([part for g, _, part in path if g == f])) for f in features]
        lookups = [
            (f, np.logical_and.reduce([agrees for g, agrees, _ in path if g == f]).astype(np.int64) << i)
            for i, f in enumerate(features)
        ]
        table = np.zeros((d, 1 << d))  # attribution of feature i under each agreement pattern
        for pattern in range(1 << d):
            one = [float(pattern >> i & 1) for i in range(d)]
            for i in range(d):
                # poly[s]: sum over coalitions of size s of the products of their members' fractions
                poly = np.array([1.0])
                for j in range(d):
                    if j != i:
                        poly = np.convolve(poly, [zero[j], one[j]])
                weight = sum(poly[s] * factorial(s) * factorial(d - s - 1) for s in range(d)) / factorial(d)
                table[i, pattern] = weight * (one[i] - zero[i]) * value
        self.leaves.append((lookups, table))

    def explain(self, x: np.ndarray) -> np.ndarray:
        """(rows, features) attributions; base + row sum equals the prediction."""
        bins = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)])
        # Rows in the same bins have the same attributions.
        distinct, back = np.unique(bins, axis=0, return_inverse=True)
        columns = np.ascontiguousarray(distinct.T)
        out = np.zeros((self.width, len(distinct)))
        for lookups, table in self.leaves:
            pattern = lookups[0][1][columns[lookups[0][0]]]
            for f, lookup in lookups[1:]:
                pattern = pattern + lookup[columns[f]]
            for i, (f, _) in enumerate(lookups):
                out[f] += table[i][pattern]
        return out.T[back.ravel()]


def tree_shap(df: DataFrame, model, columns: Sequence[str], keep: Sequence[str], normalize: bool = False) -> DataFrame:
    """Long form, one row per input row and feature: (keep..., base_value, feature, feature_value,
    contribution, position, running_total).

    ``position`` ranks a row's contributions by size, ``running_total`` adds them up in that order
    from the base value. All trees are explained together; see ``tree_shap_blocks``.
    """
    return tree_shap_blocks(df, model, columns, keep, normalize, trees_per_block=max(1, len(model.treeWeights)))


TREES_PER_BLOCK, ROWS_PER_BLOCK = 25, 20_000
#: Up to so many combinations of bins (about 10 MB) are broadcast to the rows; beyond, Spark chooses the join.
BROADCAST_CELLS = 100_000


def model_cuts(nodes: DataFrame, width: int) -> list[np.ndarray]:
    """The thresholds that a model's splits use, per feature."""
    used = nodes.where("leftChild >= 0").groupBy("feature").agg(F.collect_set(F.col("at")[0]).alias("cuts")).collect()
    cuts = {r["feature"]: np.unique(np.array(r["cuts"], float)) for r in used}
    return [cuts.get(i, np.array([])) for i in range(width)]


def model_nodes(spark, model) -> DataFrame:
    """The nodes of all trees of a model, stored by Spark ML and read again."""
    path = scratch_path(spark, "model")
    model.write().save(path)
    return spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").select(
        "treeID", "id", "prediction", "rawCount", "leftChild", "rightChild",
        F.col("split.featureIndex").alias("feature"), F.col("split.leftCategoriesOrThreshold").alias("at"),
        F.col("split.numCategories").alias("categories"),
    )


def tree_shap_blocks(
    df: DataFrame, model, columns: Sequence[str], keep: Sequence[str], normalize: bool = False,
    trees_per_block: int = TREES_PER_BLOCK, rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """``tree_shap`` for ensembles of any size: the driver holds thresholds, but no node.

    A row's attributions depend on its values only through the thresholds below each of them. The rows are
    reduced to their distinct combinations of bins, which are explained in blocks of about ``rows_per_block``:
    each block of ``trees_per_block`` trees builds its own explainer on an executor, every (tree block, block of
    combinations) pair meets in one task, and the contributions of the tree blocks are added per combination
    (Shapley values of a sum of trees are the sums of theirs). The rows then take theirs by one join.
    ``df`` is read twice, so it must give the same rows each time.
    """
    import pickle

    spark = df.sparkSession
    nodes = model_nodes(spark, model)
    weights = [float(w) for w in model.treeWeights]  # one number per tree
    total = sum(weights) if normalize else 1.0
    scaled = [w / total for w in weights]
    names = list(columns)
    width = len(names)
    cuts = model_cuts(nodes, width)
    bins = [f"_b{i}" for i in range(width)]
    columns_of_bins = ", ".join(f"{b} int" for b in bins)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        block = int(part["_tb"].iloc[0])
        view = Attribution(part.drop(columns="_tb").sort_values(["treeID", "id"]), scaled, width)
        return pd.DataFrame({"_tb": [block], "_explainer": [pickle.dumps(view)]})

    tree_blocks = -(-len(weights) // trees_per_block)
    explainers = nodes.withColumn("_tb", (F.col("treeID") / trees_per_block).cast("int")).groupBy("_tb").applyInPandas(build, "_tb int, _explainer binary")
    slim = df.select(*keep, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(names)])
    values = [f"_x{i}" for i in range(width)]
    cells = spill(with_bins(slim.select(*values), values, cuts).select(*bins).distinct(), "shap_cells")
    count = cells.count()
    row_blocks = max(1, -(-count // rows_per_block))
    packed = cells.withColumn("_rb", F.pmod(F.xxhash64(*bins), F.lit(row_blocks))).withColumn("_tb", F.explode(F.sequence(F.lit(0), F.lit(tree_blocks - 1))))
    copies = explainers.withColumn("_rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))))

    def score(part: pd.DataFrame, views: pd.DataFrame) -> pd.DataFrame:
        out = part[bins].copy()
        if len(part) == 0:
            return out.assign(_tb=[], _phi=[])
        view = pickle.loads(views["_explainer"].iloc[0])
        x = np.column_stack([np.append(cuts[i], np.inf)[part[b].to_numpy()] for i, b in enumerate(bins)])  # a bin's greatest value
        out["_tb"] = part["_tb"]
        out["_phi"] = list(np.column_stack([view.explain(x), np.full(len(x), view.base)]))
        return out

    met = packed.groupBy("_tb", "_rb").cogroup(copies.groupBy("_tb", "_rb")).applyInPandas(score, f"{columns_of_bins}, _tb int, _phi array<double>")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("_tb", "_phi"))), lambda p: p["_phi"])
    added = F.aggregate(in_order, F.array_repeat(F.lit(0.0), width + 1), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    merged = met.groupBy(*bins).agg(added.alias("_phi"))
    by_name = np.argsort(np.argsort(names))

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = np.array([np.asarray(v, float) for v in batch["_phi"]]).reshape(len(batch), width + 1)
            phi, base = whole[:, :width], whole[:, width]
            order = np.lexsort((np.broadcast_to(by_name, phi.shape), -np.abs(phi)), axis=1)
            position, running = np.empty(order.shape, dtype=np.int32), np.empty(phi.shape)
            np.put_along_axis(position, order, np.arange(1, width + 1, dtype=np.int32)[None, :], axis=1)
            np.put_along_axis(running, order, base[:, None] + np.cumsum(np.take_along_axis(phi, order, axis=1), axis=1), axis=1)
            out = batch[bins].copy()
            out["_phi"], out["_position"], out["_total"], out["base_value"] = list(phi), list(position), list(running), base
            yield out

    schema = f"{columns_of_bins}, _phi array<double>, _position array<int>, _total array<double>, base_value double"
    explained = spill(merged.mapInPandas(ranked, schema), "shap")
    wide = with_bins(slim, values, cuts).join(F.broadcast(explained) if count <= BROADCAST_CELLS else explained, bins, "left")
    value = F.transform(F.array(*values), lambda v: F.nanvl(v, F.lit(None).cast("double")))
    entries = F.arrays_zip(
        F.array(*[F.lit(c) for c in names]).alias("feature"), value.alias("feature_value"), F.col("_phi").alias("contribution"),
        F.col("_position").alias("position"), F.col("_total").alias("running_total"),
    )
    return wide.select(*keep, "base_value", F.inline(entries))


def with_bin_values(df: DataFrame, model, columns: Sequence[str]) -> DataFrame:
    """``df`` with each column replaced by the greatest value of its bin under the model's thresholds (infinity in the last).

    The model gives the same predictions, and so it does when such columns are shuffled.
    """
    cuts = model_cuts(model_nodes(df.sparkSession, model), len(columns))
    return with_bins(df, columns, cuts).withColumns(_greatest(columns, cuts)).select(*df.columns)


def _greatest(columns: Sequence[str], cuts: Sequence[np.ndarray]) -> dict:
    return {c: F.get(F.array(*[F.lit(float(v)) for v in [*cuts[i], np.inf]]), F.col(f"_b{i}")) for i, c in enumerate(columns)}


def predict_by_bins(df: DataFrame, model, columns: Sequence[str], name: str = "prediction") -> DataFrame:
    """``predict_trees`` for large ensembles: each combination of bins is scored once and joined to its rows.

    ``df`` is read twice, so it must give the same rows each time.
    """
    return predict_models_by_bins(df, {name: model}, columns)


def predict_models_by_bins(df: DataFrame, models: Mapping[str, object], columns: Sequence[str]) -> DataFrame:
    """``predict_by_bins`` of several models, a prediction column each, over the bins between all their thresholds."""
    used = [model_cuts(model_nodes(df.sparkSession, model), len(columns)) for model in models.values()]
    cuts = [np.unique(np.concatenate(of)) for of in zip(*used)]
    bins = [f"_b{i}" for i in range(len(columns))]
    cells = with_bins(df.select(*columns), columns, cuts).select(*bins).distinct().withColumns(_greatest(columns, cuts))
    for name, model in models.items():
        cells = predict_trees(cells, model, columns, name)
    scored = spill(cells.select(*bins, *models), "scored_cells")
    few = scored.count() <= BROADCAST_CELLS
    return with_bins(df, columns, cuts).join(F.broadcast(scored) if few else scored, bins, "left").select(*df.columns, *models)


def shap_importance(long: DataFrame) -> DataFrame:
    """Mean absolute contribution, rank, share, spread, sign counts and concentration per feature."""
    phi = F.col("contribution")
    per = long.groupBy("feature").agg(
        F.avg(F.abs(phi)).alias("mean_abs_shap"), F.avg(phi).alias("mean"), F.stddev_pop(phi).alias("std"),
        F.min(phi).alias("min"), F.max(phi).alias("max"),
        F.count_if(phi > 0).alias("positive"), F.count_if(phi < 0).alias("negative"), F.count_if(phi == 0).alias("neutral"),
    )
    # One row per feature from here on.
    whole = Window.partitionBy()
    total = F.sum("mean_abs_shap").over(whole)
    return per.select(
        "*",
        F.row_number().over(Window.orderBy(F.desc("mean_abs_shap"), "feature")).alias("importance_rank"),
        (F.try_divide(F.col("mean_abs_shap"), total) * 100).alias("importance_percent"),
        F.try_divide(F.max("mean_abs_shap").over(whole), total).alias("concentration"),
    )


def shap_waterfall(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per row: contributions by falling size with the running total from the base value."""
    kind = F.when(F.col("contribution") > 0, "positive").otherwise("negative")
    return long.select(*keys, "position", "feature", "contribution", "running_total", kind.alias("kind"))


def importance_tree(spark, model, features: Sequence[str]) -> DataFrame:
    """Split importance per feature: value, percent and rank."""
    values = np.asarray(model.featureImportances.toArray(), float)
    total = values.sum()
    ranks = {i: r for r, i in enumerate(sorted(range(len(features)), key=lambda i: (-values[i], features[i])), 1)}
    rows = [(f, float(values[i]), float(values[i] / total * 100) if total > 0 else 0.0, ranks[i]) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "feature string, importance double, importance_percent double, importance_rank int")
