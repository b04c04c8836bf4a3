"""Autoregressive moving-average counterfactuals per unit, estimated by Hannan-Rissanen regressions.

1. A long autoregression per unit gives innovations (actual minus its fit).
2. The actual is regressed on its own lags and on lagged innovations. One matrix of cross products per
   unit holds the normal equations of every order up to (max_p, max_q) on a common sample, so the order of
   least AIC is found from that matrix alone.
3. One-step predictions need the model's own innovations, e_t = u_t - sum(theta_j e_(t-j)), where u_t is
   the actual minus the autoregressive part. That recursion is linear, so each (slice, unit) part is
   summed up as an affine map of the incoming state; the maps are composed along each unit in slice order
   and every part is then replayed from its incoming state. A unit that holds a third of all rows spans
   many slices and so many tasks; nothing of a unit passes through the driver.

All sums are taken over every row; the driver sees one mean and one spread of the target.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelift.operators.ordered import Sliced, slice_rows
from panelift.session import spill

LONG_AR = 8
MAX_P = MAX_Q = 3


def _products(rows: DataFrame, unit: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Per unit: _n and _gram, the row-major cross products of (1, names...) over rows where all are set."""
    z = [F.lit(1.0)] + [F.col(c) for c in names]
    k = len(z)
    usable = rows.where(" and ".join(f"`{c}` is not null" for c in names)) if names else rows
    sums = [F.sum(z[i] * z[j]).alias(f"_g{i}_{j}") for i in range(k) for j in range(i, k)]
    keyed = usable if unit else usable.withColumn("_all", F.lit(0))
    grouped = keyed.groupBy(*(unit or ["_all"])).agg(F.count(F.lit(1)).cast("double").alias("_n"), *sums)
    gram = F.array(*[F.col(f"_g{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)])
    return grouped.select(*(unit or ["_all"]), "_n", gram.alias("_gram"))


def _solve(gram: np.ndarray, used: list[int], target: int) -> tuple[np.ndarray, float]:
    """Least squares of column ``target`` on columns ``used`` from cross products: (beta, residual sum)."""
    xx, xy = gram[np.ix_(used, used)], gram[used, target]
    beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
    return beta, float(gram[target, target] - beta @ xy)


def choose_order(gram: np.ndarray, n: float, max_p: int, max_q: int, fixed: tuple[int, int] | None = None) -> tuple[int, int, np.ndarray] | None:
    """(p, q, [const, phi_1..phi_max_p, theta_1..theta_max_q]) of least AIC = n ln(RSS / n) + 2 k.

    ``gram`` is over (1, y_1..y_max_p, e_1..e_max_q, y_0). Ties go to fewer terms, then fewer lags of
    the actual. Orders with no more rows than terms are not tried; None if none is left.
    """
    target = 1 + max_p + max_q
    best = None
    orders = [fixed] if fixed else [(p, q) for p in range(max_p + 1) for q in range(max_q + 1)]
    for p, q in orders:
        used = [0, *range(1, p + 1), *range(1 + max_p, 1 + max_p + q)]
        if n <= len(used):
            continue
        beta, rss = _solve(gram, used, target)
        aic = n * np.log(max(rss, 1e-300) / n) + 2 * len(used)
        key = (aic, p + q, p)
        if best is None or key < best[0]:
            full = np.zeros(1 + max_p + max_q)
            full[used] = beta
            best = (key, p, q, full)
    return None if best is None else best[1:]


def _affine(u: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(M, v): the state after these rows is M @ state_before + v; a missing u starts afresh."""
    q = len(theta)
    m, v = np.eye(q), np.zeros(q)
    for x in u:
        if np.isnan(x):
            m, v = np.zeros((q, q)), np.zeros(q)
            continue
        e = x - theta @ v
        row = -theta @ m
        m = np.vstack([row, m[:-1]])
        v = np.concatenate([[e], v[:-1]])
    return m, v


def _replay(u: np.ndarray, theta: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Innovations e_t = u_t - theta . (e_(t-1) .. e_(t-q)); NaN where u is missing (and the state restarts)."""
    out = np.full(len(u), np.nan)
    s = state.copy()
    for i, x in enumerate(u):
        if np.isnan(x):
            s[:] = 0.0
            continue
        e = x - theta @ s
        out[i] = e
        if len(s):
            s = np.concatenate([[e], s[:-1]])
    return out


def innovations(rows: DataFrame, unit: Sequence[str], q: int) -> DataFrame:
    """Add _e to sliced rows that hold _u (actual minus autoregressive part) and _theta (length q).

    Rows must carry _slice and _pos as ``slice_rows`` gives them.
    """
    if q == 0:
        return rows.withColumn("_e", F.col("_u"))
    keys = ["_slice", *unit]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    key_schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys)

    def summary(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_pos")
        theta = np.asarray(part["_theta"].iloc[0] if part["_theta"].iloc[0] is not None else np.zeros(q), float)
        m, v = _affine(part["_u"].to_numpy(float, na_value=np.nan), theta)
        out = part[keys].iloc[:1].copy()
        out["_m"], out["_v"] = [m.ravel().tolist()], [v.tolist()]
        return out

    parts = rows.select(*keys, "_pos", "_u", "_theta").groupBy(*keys).applyInPandas(summary, f"{key_schema}, _m array<double>, _v array<double>")
    unit_keys = list(unit) or ["_all"]
    if not unit:
        parts = parts.withColumn("_all", F.lit(0))

    def carried(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_slice")
        s, states = np.zeros(q), []
        for m, v in zip(part["_m"], part["_v"]):
            states.append(s.tolist())
            s = np.asarray(m, float).reshape(q, q) @ s + np.asarray(v, float)
        out = part[keys].copy()
        out["_state"] = states
        return out

    states = parts.groupBy(*unit_keys).applyInPandas(carried, f"{key_schema}, _state array<double>")
    joined = rows.join(states, keys, "left")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + ["_e double"])

    def replay(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_pos")
        theta = np.asarray(part["_theta"].iloc[0] if part["_theta"].iloc[0] is not None else np.zeros(q), float)
        state = part["_state"].iloc[0]
        state = np.zeros(q) if state is None else np.asarray(state, float)
        part = part.drop(columns=["_state"])
        part["_e"] = _replay(part["_u"].to_numpy(float, na_value=np.nan), theta, state)
        return part

    return joined.groupBy(*keys).applyInPandas(replay, schema)


def arma_impact(
    df: DataFrame,
    target: str,
    order_by: Sequence[str],
    unit: Sequence[str] = (),
    order: tuple[int, int] | None = None,
    max_p: int = MAX_P,
    max_q: int = MAX_Q,
    long_ar: int = LONG_AR,
    slices: int | None = None,
) -> DataFrame:
    """One-step ARMA predictions per unit, effect = actual - prediction and its running sum.

    ``order`` fixes (p, q); otherwise the order of least AIC up to (max_p, max_q) is taken per unit. The
    long autoregression has ``long_ar`` lags. The moving-average part is made invertible (``invertible``). Innovations before a unit's first predicted row count as
    0; rows without p earlier rows, and units with no more usable rows than terms, have no prediction.
    Returns unit, order columns, actual, prediction, effect, cumulative_effect, ar_order, ma_order.
    """
    keep = [*dict.fromkeys([*unit, *order_by])]
    unit = list(unit)
    base = df.select(*keep, F.col(target).cast("double").alias("actual")).filter(F.col("actual").isNotNull() & ~F.isnan("actual"))
    big_p, big_q = order if order else (max_p, max_q)
    m = max(1, long_ar)
    sliced = slice_rows(base, order_by, unit, slices)
    level = base.agg(F.avg("actual").alias("m"), F.stddev_pop("actual").alias("s")).first()
    mean, scale = float(level["m"] or 0.0), float(level["s"] or 0.0) or 1.0
    z = lambda c: (F.col(c) - F.lit(mean)) / F.lit(scale)
    lagged = sliced.shifted({f"_y{k}": ("actual", k) for k in range(1, max(m, big_p) + 1)})
    lagged = lagged.withColumns({f"_z{k}": z(f"_y{k}") for k in range(1, max(m, big_p) + 1)}).withColumn("_z0", z("actual"))
    # 1. long autoregression and its innovations (in units of the spread)
    names = [f"_z{k}" for k in range(1, m + 1)]
    long_fit = _fitted_table(_products(lagged, unit, [*names, "_z0"]), unit, lambda g, n: _long(g, m))
    fit = F.col("_a")[0]
    for k in range(1, m + 1):
        fit = fit + F.col("_a")[k] * F.col(f"_z{k}")
    first = sliced.attach(lagged, long_fit, "left").withColumn("_eps", F.col("_z0") - fit).drop("_a")
    columns = [*keep, "actual", *[f"_y{k}" for k in range(1, big_p + 1)], *[f"_z{k}" for k in range(0, big_p + 1)], "_eps"]
    stage = Sliced(spill(first.select(*columns, "_slice", "_pos"), "innovations"), unit, columns)
    shifted = stage.shifted({f"_e{j}": ("_eps", j) for j in range(1, big_q + 1)})
    # 2. every order from one matrix of cross products per unit
    names = [*[f"_z{k}" for k in range(1, big_p + 1)], *[f"_e{j}" for j in range(1, big_q + 1)], "_z0"]
    fixed = tuple(order) if order else None
    table = _fitted_table(_products(shifted, unit, names), unit, lambda g, n: _orders(g, n, big_p, big_q, fixed, mean, scale))
    table = table.select(*(unit or ["_all"]), F.col("_a")[0].cast("int").alias("ar_order"), F.col("_a")[1].cast("int").alias("ma_order"), F.slice("_a", 3, 1 + big_p + big_q).alias("_beta"))
    scored = stage.attach(shifted, table.drop("_all") if not unit else table, "left")
    # 3. the autoregressive part, then the innovations by a scan over the slices
    part = F.col("_beta")[0]
    for k in range(1, big_p + 1):
        weight = F.col("_beta")[k]
        part = part + F.when(weight == 0, F.lit(0.0)).otherwise(weight * F.col(f"_y{k}"))
    ready = F.col("_beta").isNotNull()
    for k in range(1, big_p + 1):
        ready = ready & (F.col(f"_y{k}").isNotNull() | (F.col("ar_order") < k))
    theta = F.slice("_beta", 2 + big_p, big_q) if big_q else F.lit(None).cast("array<double>")
    with_u = scored.withColumn("_u", F.when(ready, F.col("actual") - part)).withColumn("_theta", theta)
    with_e = innovations(with_u.select(*keep, "actual", "ar_order", "ma_order", "_u", "_theta", "_slice", "_pos"), unit, big_q)
    out = with_e.withColumn("prediction", F.col("actual") - F.col("_e")).withColumn("effect", F.col("actual") - F.col("prediction"))
    shown = [*keep, "actual", "prediction", "effect", "ar_order", "ma_order"]
    running = Sliced(spill(out.select(*shown, "_slice", "_pos"), "arma"), unit, shown).scan(sums={"cumulative_effect": "effect"})
    return running.select(*keep, "actual", "prediction", "effect", "cumulative_effect", "ar_order", "ma_order")


def _long(gram: np.ndarray, m: int) -> list[float] | None:
    if gram[0, 0] <= m + 1:
        return None
    beta, _ = _solve(gram, list(range(m + 1)), m + 1)
    return beta.tolist()


def _orders(gram, n, big_p, big_q, fixed, mean, scale) -> list[float] | None:
    """[p, q, const, phi.., theta..] in the units of the target."""
    found = choose_order(gram, n, big_p, big_q, fixed)
    if found is None:
        return None
    p, q, b = found
    phi, theta = b[1 : 1 + big_p], b[1 + big_p :].copy()
    theta[:q] = invertible(theta[:q])
    const = mean + scale * b[0] - mean * phi.sum()
    return [float(p), float(q), float(const), *phi.tolist(), *theta.tolist()]


def invertible(theta: np.ndarray) -> np.ndarray:
    """MA coefficients with every root of 1 + theta_1 z + ... inside the unit circle reflected out (1 / conj).

    The reflected model has the same autocorrelations, and its innovations die out instead of growing
    without bound; for one term that is theta -> 1 / theta when |theta| > 1.
    """
    theta = np.asarray(theta, float)
    if not len(theta) or not theta.any():
        return theta
    last = int(np.flatnonzero(theta)[-1])
    roots = np.roots(np.concatenate([theta[: last + 1][::-1], [1.0]]))
    if (np.abs(roots) >= 1).all():
        return theta
    roots = np.where(np.abs(roots) < 1, 1 / np.conj(roots), roots)
    rising = np.poly(roots)[::-1]
    out = theta.copy()
    out[: last + 1] = np.real(rising[1:] / rising[0])
    return out


def _fitted_table(products: DataFrame, unit: Sequence[str], solve) -> DataFrame:
    """(unit..., _a): ``solve(gram, n)`` per unit, on the executors."""
    keys = list(unit) or ["_all"]
    kinds = {f.name: f.dataType.simpleString() for f in products.schema.fields}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "_a array<double>"])

    def one(part: pd.DataFrame) -> pd.DataFrame:
        row = part.iloc[0]
        gram = np.asarray(row["_gram"], float)
        k = int(round(np.sqrt(len(gram))))
        out = part[keys].iloc[:1].copy()
        out["_a"] = [solve(gram.reshape(k, k), float(row["_n"]))]
        return out

    return products.groupBy(*keys).applyInPandas(one, schema)
