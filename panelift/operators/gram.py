"""Distributed sufficient statistics and the small solves on top of them.

``moments`` reduces any number of rows to n, the mean vector and the centred cross-product
matrix of k columns, in one pass. Up to ``SQL_WIDTH`` columns this is a plain SQL aggregate of
covariances (computed stably, with map-side partial aggregation). Wider matrices are accumulated
per partition with numpy and merged in levels of constant fan-in, so neither the driver nor a task
ever holds more than a fixed number of k x k matrices, however many partitions there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelift.session import spill

SQL_WIDTH = 14
_MERGE_FAN = 16
RANK_TOLERANCE = 1e-10


@dataclass
class Moments:
    """n rows, mean of each column and centred cross products of k named columns."""

    names: list[str]
    n: float
    mean: np.ndarray
    cross: np.ndarray
    total: float = 0.0

    def pick(self, wanted: Sequence[str]) -> "Moments":
        at = [self.names.index(c) for c in wanted]
        return Moments(list(wanted), self.n, self.mean[at], self.cross[np.ix_(at, at)], self.total)

    def minus(self, part: "Moments") -> "Moments":
        """The rows of self without the rows of ``part``."""
        n = self.n - part.n
        mean = (self.n * self.mean - part.n * part.mean) / n
        gap = part.mean - mean
        cross = self.cross - part.cross - np.outer(gap, gap) * (n * part.n / self.n)
        return Moments(self.names, n, mean, cross, self.total - part.total)

    def variance(self, ddof: int = 1) -> np.ndarray:
        return np.diag(self.cross) / (self.n - ddof)

    def correlation(self) -> np.ndarray:
        sd = np.sqrt(np.clip(np.diag(self.cross), 0.0, None))
        with np.errstate(divide="ignore", invalid="ignore"):
            r = self.cross / np.outer(sd, sd)
        return r


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Listwise deletion on the used columns; NaN counts as missing."""
    return df.filter(_present(df, columns))


def _present(df: DataFrame, columns: Sequence[str]):
    typed = dict(df.dtypes)
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
        if typed[c] in ("double", "float"):
            ok = ok & ~F.isnan(c)
    return ok


def moments_frame(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per group: (by..., total, n, mean array<double>, cross array<double> of k*k values).

    ``n`` counts the complete rows that enter the moments, ``total`` all rows.
    """
    names = list(columns)
    k = len(names)
    if k > SQL_WIDTH:
        return _wide_moments(df, names, by)
    ok = _present(df, names)
    used = df.select(*by, ok.alias("_ok"), *[F.when(ok, F.col(c).cast("double")).alias(f"_v{i}") for i, c in enumerate(names)])
    aggregates = [F.count(F.lit(1)).cast("double").alias("total"), F.count_if("_ok").cast("double").alias("n")]
    aggregates += [F.avg(f"_v{i}").alias(f"_m{i}") for i in range(k)]
    aggregates += [
        F.covar_pop(f"_v{i}", f"_v{j}").alias(f"_c{i}_{j}") for i in range(k) for j in range(i, k)
    ]
    reduced = used.groupBy(*by).agg(*aggregates)
    cross = [
        F.coalesce(F.col(f"_c{min(i, j)}_{max(i, j)}"), F.lit(0.0)) * F.col("n")
        for i in range(k)
        for j in range(k)
    ]
    means = [F.coalesce(F.col(f"_m{i}"), F.lit(0.0)) for i in range(k)]
    return reduced.select(*by, "total", "n", F.array(*means).alias("mean"), F.array(*cross).alias("cross"))


def _merge(parts: Iterator[tuple[float, float, np.ndarray, np.ndarray]], k: int):
    total, n, mean, cross = 0.0, 0.0, np.zeros(k), np.zeros((k, k))
    for pt, pn, pm, pc in parts:
        total += pt
        if pn == 0:
            continue
        gap = pm - mean
        cross = cross + pc + np.outer(gap, gap) * (n * pn / (n + pn))
        mean = mean + gap * (pn / (n + pn))
        n += pn
    return total, n, mean, cross


def _wide_moments(df: DataFrame, names: list[str], by: Sequence[str]) -> DataFrame:
    k = len(names)
    by = list(by)
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*[f"`{c}` {fields[c]}" for c in by], "_bucket int", "total double", "n double", "mean array<double>", "cross array<double>"])
    used = df.select(*by, *[F.col(c).cast("double").alias(c) for c in names], F.spark_partition_id().alias("_bucket"))

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple] = {}
        for batch in batches:
            groups = batch.groupby(by, dropna=False, sort=False) if by else [((), batch)]
            for key, rows in groups:
                x = rows[names].to_numpy(dtype=float)
                total = float(len(x))
                x = x[~np.isnan(x).any(axis=1)]
                m = x.mean(axis=0) if len(x) else np.zeros(k)
                d = x - m
                key = (*(key if isinstance(key, tuple) else (key,)), int(rows["_bucket"].iloc[0]))
                part = (total, float(len(x)), m, d.T @ d)
                held[key] = _merge(iter([held[key], part]), k) if key in held else part
            # Partial matrices are emitted early when many groups meet in one task.
            if len(held) * k * k > 16_000_000:
                yield _rows(held)
                held = {}
        if held:
            yield _rows(held)

    def _rows(held: dict[tuple, tuple]) -> pd.DataFrame:
        out = pd.DataFrame(list(held.keys()), columns=[*by, "_bucket"])
        out["total"] = [v[0] for v in held.values()]
        out["n"] = [v[1] for v in held.values()]
        out["mean"] = [v[2].tolist() for v in held.values()]
        out["cross"] = [v[3].ravel().tolist() for v in held.values()]
        return out

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        parts = ((r.total, r.n, np.asarray(r.mean, float), np.asarray(r.cross, float).reshape(k, k)) for r in
                 rows.rename(columns={c: f"_b{i}" for i, c in enumerate(by)}).itertuples(index=False))
        total, n, mean, cross = _merge(parts, k)
        out = rows.iloc[:1][[*by, "_bucket"]].copy()
        out["total"], out["n"], out["mean"], out["cross"] = total, n, [mean.tolist()], [cross.ravel().tolist()]
        return out

    return merged_in_levels(used.mapInPandas(partials, schema), by, merge, schema).drop("_bucket")


def merged_in_levels(parts: DataFrame, by: Sequence[str], merge, schema: str, bucket: str = "_bucket") -> DataFrame:
    """Merge the rows of ``parts`` (by..., bucket, ...) to one per group, ``_MERGE_FAN`` buckets at a time.

    ``bucket`` is the number of the partition a row comes from. The partial results are stored once, so the
    number of levels is known; each level divides the number of buckets by the fan-in.
    """
    merged = spill(parts, "partials")
    kind = dict(merged.dtypes)[bucket]
    most = merged.agg(F.max(bucket)).first()[0] or 0
    while True:
        merged = merged.withColumn(bucket, F.floor(F.col(bucket) / _MERGE_FAN).cast(kind)).groupBy(*by, bucket).applyInPandas(merge, schema)
        most //= _MERGE_FAN
        if most == 0:
            return merged


def pair_sums(df: DataFrame, columns: Sequence[str], shift: Sequence[float]) -> dict[str, np.ndarray]:
    """Sums over the rows where both columns of a pair are present, for every pair, in one pass.

    ``n`` counts, ``x`` sums the first column, ``xx`` its squares, ``xy`` the products, all about
    ``shift``. Each partition adds up k x k matrices; they are merged in levels of constant fan-in.
    """
    names = list(columns)
    k = len(names)
    centre = np.asarray(shift, float)
    used = df.select(*[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(names)], F.spark_partition_id().alias("_bucket"))
    schema = "_bucket int, sums array<double>"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, bucket = np.zeros((4, k, k)), 0
        for batch in batches:
            x = batch[[f"_v{i}" for i in range(k)]].to_numpy(dtype=float) - centre
            seen = ~np.isnan(x)
            mask, value = seen.astype(float), np.where(seen, x, 0.0)
            total += np.stack([mask.T @ mask, value.T @ mask, (value * value).T @ mask, value.T @ value])
            bucket = int(batch["_bucket"].iloc[0]) if len(batch) else bucket
        yield pd.DataFrame({"_bucket": [bucket], "sums": [total.ravel().tolist()]})

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(4 * k * k)
        for values in part["sums"]:
            total += np.asarray(values, float)
        return pd.DataFrame({"_bucket": part["_bucket"].iloc[:1].tolist(), "sums": [total.tolist()]})

    rows = merged_in_levels(used.mapInPandas(partial, schema), [], merge, schema).collect()
    total = np.asarray(rows[0]["sums"], float).reshape(4, k, k) if rows else np.zeros((4, k, k))
    return dict(zip(("n", "x", "xx", "xy"), total))


def _from_row(names: list[str], r) -> Moments:
    k = len(names)
    return Moments(
        names, float(r["n"]), np.asarray(r["mean"], float), np.asarray(r["cross"], float).reshape(k, k), float(r["total"])
    )


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Moments of the whole table: one row of k + k*k numbers reaches the driver."""
    names = list(columns)
    rows = moments_frame(df, names).collect()
    k = len(names)
    return _from_row(names, rows[0]) if rows else Moments(names, 0.0, np.zeros(k), np.zeros((k, k)))


def moments_by(df: DataFrame, columns: Sequence[str], group: str) -> dict[object, Moments]:
    """Moments per value of a column that the caller has bounded (folds, splits)."""
    names = list(columns)
    return {r[group]: _from_row(names, r) for r in moments_frame(df, names, [group]).collect()}


@dataclass
class LinearFit:
    """Least-squares fit with intercept; minimum-norm slopes when the features are dependent."""

    target: str
    features: list[str]
    intercept: float
    slopes: np.ndarray
    n: float
    sse: float
    sst: float
    full_rank: bool
    inverse: np.ndarray | None = field(default=None, repr=False)  # (X'X)^-1 with the constant first

    @property
    def terms(self) -> list[str]:
        return ["intercept", *self.features]

    @property
    def coefficients(self) -> np.ndarray:
        return np.concatenate([[self.intercept], self.slopes])

    @property
    def df_resid(self) -> float:
        return self.n - len(self.features) - 1

    @property
    def r2(self) -> float:
        return 1.0 - self.sse / self.sst if self.sst > 0 else float("nan")

    @property
    def adjusted_r2(self) -> float:
        if self.df_resid <= 0:
            return float("nan")
        return 1.0 - (1.0 - self.r2) * (self.n - 1) / self.df_resid

    @property
    def standard_errors(self) -> np.ndarray:
        if self.inverse is None or self.df_resid <= 0:
            return np.full(len(self.terms), np.nan)
        return np.sqrt(np.clip(np.diag(self.inverse) * self.sse / self.df_resid, 0.0, None))


def solve_linear(m: Moments, target: str, features: Sequence[str]) -> LinearFit:
    """Ordinary least squares from moments."""
    features = list(features)
    if m.n < 1:
        raise ValueError("no complete rows to fit")
    part = m.pick([*features, target])
    k = len(features)
    sxx, sxy, syy = part.cross[:k, :k], part.cross[:k, k], float(part.cross[k, k])
    scale = np.sqrt(np.clip(np.diag(sxx), 0.0, None))
    usable = scale > 0
    full_rank = bool(usable.all()) and m.n > k
    if full_rank and k:
        unit = sxx / np.outer(scale, scale)
        full_rank = bool(np.linalg.eigvalsh(unit)[0] > RANK_TOLERANCE)
    inverse = None
    if full_rank:
        core = np.linalg.inv(sxx / np.outer(scale, scale)) / np.outer(scale, scale) if k else np.zeros((0, 0))
        slopes = core @ sxy
        xbar = part.mean[:k]
        inverse = np.empty((k + 1, k + 1))
        inverse[1:, 1:] = core
        inverse[0, 1:] = inverse[1:, 0] = -core @ xbar
        inverse[0, 0] = 1.0 / part.n + xbar @ core @ xbar
    else:
        slopes = np.linalg.pinv(sxx, rcond=RANK_TOLERANCE, hermitian=True) @ sxy
    intercept = float(part.mean[k] - part.mean[:k] @ slopes)
    sse = max(0.0, float(syy - 2 * slopes @ sxy + slopes @ sxx @ slopes))
    return LinearFit(target, features, intercept, slopes, part.n, sse, syy, full_rank, inverse)


def r_factor(df: DataFrame, columns: Sequence[str]) -> tuple[float, np.ndarray]:
    """(rows, R) of the QR factorisation of [1, columns] over rows without a gap (tall-skinny QR).

    Each partition folds its batches into one triangular factor; the factors are stacked and factored
    again in levels of constant fan-in, so no task or driver ever holds more than a fixed number of
    (k + 1) x (k + 1) matrices. Working on the rows themselves keeps the condition number unsquared.
    """
    names = list(columns)
    k = len(names) + 1
    present = F.lit(True)
    for c in names:
        present = present & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    used = df.where(present).select(*[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(names)], F.spark_partition_id().alias("_bucket"))
    schema = "_bucket int, n double, r array<double>"

    def fold(stack: np.ndarray) -> np.ndarray:
        r = np.linalg.qr(stack, mode="r")
        out = np.zeros((k, k))
        out[: r.shape[0]] = r[:k]
        return out

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, n, bucket = np.zeros((k, k)), 0.0, 0
        for batch in batches:
            if not len(batch):
                continue
            block = np.column_stack([np.ones(len(batch)), batch[[f"_v{i}" for i in range(k - 1)]].to_numpy(dtype=float)])
            r, n = fold(np.vstack([r, block])), n + len(batch)
            bucket = int(batch["_bucket"].iloc[0])
        yield pd.DataFrame({"_bucket": [bucket], "n": [n], "r": [r.ravel().tolist()]})

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        stack = np.vstack([np.asarray(v, float).reshape(k, k) for v in part["r"]])
        return pd.DataFrame({"_bucket": part["_bucket"].iloc[:1].tolist(), "n": [part["n"].sum()], "r": [fold(stack).ravel().tolist()]})

    rows = merged_in_levels(used.mapInPandas(partial, schema), [], merge, schema).collect()
    if not rows:
        return 0.0, np.zeros((k, k))
    return float(rows[0]["n"]), np.asarray(rows[0]["r"], float).reshape(k, k)


def fit_ols_qr(df: DataFrame, target: str, features: Sequence[str]) -> LinearFit:
    """Least squares with intercept from the R factor of [1, features, target]; rows with a gap are left out.

    Coefficients come by back-substitution, the residual sum of squares is the last diagonal entry squared,
    and (X'X)^-1 = R^-1 R^-T. A feature whose diagonal entry is below 1e-12 of the largest makes the fit
    rank-deficient: then minimum-norm coefficients and no inverse.
    """
    features = list(features)
    n, r = r_factor(df, [*features, target])
    if n < 1:
        raise ValueError("no complete rows to fit")
    k = len(features) + 1
    rxx, rxy, ryy = r[:k, :k], r[:k, k], float(r[k, k])
    diagonal = np.abs(np.diag(rxx))
    full_rank = bool(n > k and diagonal.min() > 1e-12 * diagonal.max())
    if full_rank:
        beta = np.linalg.solve(rxx, rxy)
        core = np.linalg.inv(rxx)
        inverse = core @ core.T
        sse = ryy * ryy
    else:
        beta = np.linalg.lstsq(rxx, rxy, rcond=1e-12)[0]
        inverse = None
        sse = float(np.sum((rxx @ beta - rxy) ** 2) + ryy * ryy)
    total = np.linalg.qr(r[:, [0, k]], mode="r")  # R of [1, target]: its last entry is the centred spread
    sst = float(total[1, 1] ** 2)
    return LinearFit(target, features, float(beta[0]), beta[1:], n, float(sse), sst, full_rank, inverse)


def holdout_errors(m: Moments, fit: LinearFit) -> tuple[float, float]:
    """(sum of squared errors, total sum of squares) of a fit on other rows, from their moments."""
    part = m.pick([*fit.features, fit.target])
    k = len(fit.features)
    weights = np.concatenate([-fit.slopes, [1.0]])
    shift = float(part.mean[k] - fit.intercept - part.mean[:k] @ fit.slopes)
    return float(weights @ part.cross @ weights + part.n * shift * shift), float(part.cross[k, k])


def information_criteria(n: float, sse: float, parameters: int) -> tuple[float, float, float]:
    """(log-likelihood, AIC, BIC) of a Gaussian least-squares fit."""
    llf = -n / 2.0 * (math.log(2 * math.pi) + math.log(sse / n) + 1.0) if sse > 0 else float("inf")
    return llf, 2 * parameters - 2 * llf, parameters * math.log(n) - 2 * llf
