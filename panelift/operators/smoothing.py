"""Exponential smoothing per unit (level, trend, season) and forecasts as quantiles of sampled paths.

The additive Holt-Winters update is linear in the state (level, trend, the last ``season`` seasonal terms)
and the new value, so every (slice, unit) part of a series is one affine map of its incoming state. The
maps are composed along each unit in slice order and each part is replayed from its incoming state:
a series longer than a slice is spread over as many tasks as it has slices.

Paths: with one-step errors e, the state moves as level += trend + alpha e, trend += alpha beta e and the
season used += gamma (1 - alpha) e, so a path h steps ahead is the point forecast plus e_h plus
sum_j c_(h-j) e_j with c_i = alpha (1 + i beta) + gamma (1 - alpha) [i divisible by season]. The errors of a
path are drawn from the unit's own one-step errors by a hash of (unit, path, step, seed): the same draws at
every run and in any partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelift.operators.ordered import Sliced, slice_rows
from panelift.session import spill

ALPHA, BETA, GAMMA = 0.3, 0.1, 0.1
PATHS, SEED = 20, 7
QUANTILES = (0.1, 0.5, 0.9)


class Holt:
    """The linear update of the state x = (level, trend, s_newest .. s_oldest) by one value y."""

    def __init__(self, season: int | None, alpha: float = ALPHA, beta: float = BETA, gamma: float = GAMMA):
        self.m = season or 0
        self.alpha, self.beta, self.gamma = alpha, beta, gamma
        size = 2 + self.m
        a, b, g = alpha, beta, gamma if self.m else 0.0
        old = size - 1 if self.m else None
        self.matrix, self.inflow = np.zeros((size, size)), np.zeros(size)
        # level' = a y - a s_old + (1 - a)(level + trend)
        self.matrix[0, 0] = self.matrix[0, 1] = 1 - a
        self.inflow[0] = a
        # trend' = a b y - a b s_old - a b level + (1 - a b) trend
        self.matrix[1, 0], self.matrix[1, 1], self.inflow[1] = -a * b, 1 - a * b, a * b
        if self.m:
            self.matrix[0, old] = -a
            self.matrix[1, old] = -a * b
            # s' = g (1 - a) y + (g a + 1 - g) s_old - g (1 - a)(level + trend); the others move one place
            self.matrix[2, 0] = self.matrix[2, 1] = -g * (1 - a)
            self.matrix[2, old] = g * a + 1 - g
            self.inflow[2] = g * (1 - a)
            for i in range(3, size):
                self.matrix[i, i - 1] = 1.0
        self.size = size

    def start(self, y: float) -> np.ndarray:
        """State after a unit's first value: level y, no trend, no season."""
        x = np.zeros(self.size)
        x[0] = y
        return x

    def predicted(self, x: np.ndarray) -> float:
        return float(x[0] + x[1] + (x[-1] if self.m else 0.0))

    def weights(self, horizon: int) -> np.ndarray:
        """c_1 .. c_horizon of the error-correction form."""
        i = np.arange(1, horizon + 1)
        seasonal = (i % self.m == 0) * self.gamma * (1 - self.alpha) if self.m else 0.0
        return self.alpha * (1 + i * self.beta) + seasonal

    def ahead(self, x: np.ndarray, horizon: int) -> np.ndarray:
        """Point forecasts 1..horizon steps after state x."""
        h = np.arange(1, horizon + 1)
        out = x[0] + h * x[1]
        if self.m:
            out = out + x[2 + self.m * np.ceil(h / self.m).astype(int) - h]
        return out


def _summary(model: Holt, y: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(M, v) with state after these rows = M @ state before + v; a unit's first row starts afresh."""
    m, v = np.eye(model.size), np.zeros(model.size)
    for value, is_first in zip(y, first):
        if is_first:
            m, v = np.zeros((model.size, model.size)), model.start(value)
        else:
            m, v = model.matrix @ m, model.matrix @ v + model.inflow * value
    return m, v


def _replay(model: Holt, y: np.ndarray, first: np.ndarray, x: np.ndarray):
    """Per row: state after it, and the one-step prediction before it (NaN on a unit's first row)."""
    states, predicted = np.zeros((len(y), model.size)), np.full(len(y), np.nan)
    for i, (value, is_first) in enumerate(zip(y, first)):
        if is_first:
            x = model.start(value)
        else:
            predicted[i] = model.predicted(x)
            x = model.matrix @ x + model.inflow * value
        states[i] = x
    return states, predicted


def smoothed(
    df: DataFrame, time: str, target: str, unit: Sequence[str] = (), season: int | None = None,
    alpha: float = ALPHA, beta: float = BETA, gamma: float = GAMMA, slices: int | None = None,
) -> DataFrame:
    """Per row: unit, time, actual, level, trend, season (the term just updated, null without season),
    predicted (one step ahead, null on a unit's first row), error, _state (all terms) and _pos.

    Rows with a null time or value take no part; ties in time follow ``slice_rows``.
    """
    unit = list(unit)
    model = Holt(season, alpha, beta, gamma)
    base = df.select(*unit, time, F.col(target).cast("double").alias("actual")).where(F.col(time).isNotNull() & F.col("actual").isNotNull())
    sliced = slice_rows(base, [time], unit, slices)
    keys = ["_slice", *unit]
    rows = sliced.frame
    firsts = rows.groupBy(*unit).agg(F.min("_pos").alias("_start"))
    flagged = sliced.attach(rows, firsts, "left").withColumn("_first", F.col("_pos") == F.col("_start")).drop("_start")
    kinds = {f.name: f.dataType.simpleString() for f in flagged.schema.fields}
    key_schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys)

    def summary(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_pos")
        m, v = _summary(model, part["actual"].to_numpy(float), part["_first"].to_numpy(bool))
        out = part[keys].iloc[:1].copy()
        out["_m"], out["_v"] = [m.ravel().tolist()], [v.tolist()]
        return out

    parts = flagged.select(*keys, "_pos", "actual", "_first").groupBy(*keys).applyInPandas(summary, f"{key_schema}, _m array<double>, _v array<double>")
    if not unit:
        parts = parts.withColumn("_all", F.lit(0))

    def carried(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_slice")
        x, states = np.zeros(model.size), []
        for m, v in zip(part["_m"], part["_v"]):
            states.append(x.tolist())
            x = np.asarray(m, float).reshape(model.size, model.size) @ x + np.asarray(v, float)
        out = part[keys].copy()
        out["_in"] = states
        return out

    incoming = parts.groupBy(*(unit or ["_all"])).applyInPandas(carried, f"{key_schema}, _in array<double>")
    joined = flagged.join(incoming, keys, "left")
    out_schema = f"{key_schema}, _pos long, `{time}` {kinds[time]}, actual double, predicted double, _state array<double>"

    def replay(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_pos")
        x = part["_in"].iloc[0]
        x = np.zeros(model.size) if x is None else np.asarray(x, float)
        states, predicted = _replay(model, part["actual"].to_numpy(float), part["_first"].to_numpy(bool), x)
        out = part[[*keys, "_pos", time, "actual"]].copy()
        out["predicted"], out["_state"] = predicted, list(states.tolist())
        return out

    done = joined.groupBy(*keys).applyInPandas(replay, out_schema)
    return done.select(
        *unit, time, "actual", F.col("_state")[0].alias("level"), F.col("_state")[1].alias("trend"),
        (F.col("_state")[2] if model.m else F.lit(None).cast("double")).alias("season"), "predicted",
        (F.col("actual") - F.col("predicted")).alias("error"), "_state", "_slice", "_pos",
    )


def sampled_forecast(
    df: DataFrame, time: str, target: str, horizon: int, unit: Sequence[str] = (), season: int | None = None,
    step: float = 1, paths: int = PATHS, seed: int = SEED, alpha: float = ALPHA, beta: float = BETA, gamma: float = GAMMA,
    slices: int | None = None,
) -> DataFrame:
    """History rows (one-step predictions) and ``horizon`` forecast rows per unit: the median and the 10 %
    and 90 % quantiles (linear interpolation) of ``paths`` sampled paths.

    ``step`` is the distance between times (seconds for timestamps, days for dates). A unit without
    one-step errors (a single row) gets paths equal to its point forecast.
    """
    unit = list(unit)
    model = Holt(season, alpha, beta, gamma)
    states = spill(smoothed(df, time, target, unit, season, alpha, beta, gamma, slices), "smoothed")
    history = states.select(
        *unit, time, "actual", "predicted", F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"),
        F.lit("historical").alias("data_type"),
    )
    # The errors of each unit, numbered 0.. in time order, and the unit's last state and time.
    errors = Sliced(states.where("error is not null"), unit, [*unit, time, "error"]).scan(number="_k")
    errors = errors.select(*unit, (F.col("_k") - 1).alias("_k"), "error")
    ends = states.groupBy(*unit).agg(F.max_by("_state", "_pos").alias("_state"), F.max(time).alias("_time")) if unit else states.agg(
        F.max_by("_state", "_pos").alias("_state"), F.max(time).alias("_time")
    )
    counts = errors.groupBy(*unit).agg(F.count(F.lit(1)).alias("_n"))
    grid = ends.join(counts, unit, "left") if unit else ends.withColumn("_n", F.lit(errors.count()))
    grid = grid.withColumn("path", F.explode(F.sequence(F.lit(1), F.lit(paths)))).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    draw = F.pmod(F.xxhash64(*[F.col(c) for c in unit], F.col("path"), F.col("h"), F.lit(seed)), F.col("_n"))
    grid = grid.withColumn("_k", F.when(F.col("_n") > 0, draw))
    drawn = grid.join(errors, [*unit, "_k"], "left").select(*unit, "_state", "_time", "path", "h", F.coalesce("error", F.lit(0.0)).alias("e"))
    kinds = {f.name: f.dataType.simpleString() for f in drawn.schema.fields}
    keys = unit or ["_all"]
    if not unit:
        drawn = drawn.withColumn("_all", F.lit(0))
        kinds["_all"] = "int"
    out_schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], f"_time {kinds['_time']}", "h int", "predicted double", "lower double", "upper double"])
    weights = model.weights(horizon)

    def quantiles(part: pd.DataFrame) -> pd.DataFrame:
        e = np.zeros((paths, horizon))
        e[part["path"].to_numpy(int) - 1, part["h"].to_numpy(int) - 1] = part["e"].to_numpy(float)
        point = model.ahead(np.asarray(part["_state"].iloc[0], float), horizon)
        moved = e.copy()
        for h in range(1, horizon):
            moved[:, h] += e[:, :h] @ weights[:h][::-1]
        q = np.quantile(point + moved, QUANTILES, axis=0)
        out = pd.DataFrame({"h": np.arange(1, horizon + 1), "predicted": q[1], "lower": q[0], "upper": q[2]})
        for c in keys:
            out[c] = part[c].iloc[0]
        out["_time"] = part["_time"].iloc[0]
        return out

    future = drawn.groupBy(*keys).applyInPandas(quantiles, out_schema)
    if kinds["_time"].startswith("timestamp"):
        at = F.col("_time") + F.make_dt_interval(secs=F.col("h") * F.lit(float(step)))
    elif kinds["_time"] == "date":
        at = F.date_add("_time", (F.col("h") * F.lit(int(step))).cast("int"))
    else:
        at = F.col("_time") + F.col("h") * F.lit(step)
    forecast_rows = future.select(
        *unit, at.cast(kinds["_time"]).alias(time), F.lit(None).cast("double").alias("actual"), "predicted", "lower", "upper", F.lit("forecast").alias("data_type")
    )
    return history.unionByName(forecast_rows)
