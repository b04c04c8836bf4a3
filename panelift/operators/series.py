"""Time-series models per unit: vector autoregression, autoregressive impact, forecasts."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelift.operators.frequency import quantiles
from panelift.operators.gram import merged_in_levels
from panelift.operators.linear import fit_metrics
from panelift.operators.ordered import Sliced, slice_rows
from panelift.session import spill

MAX_LAGS = 5
IRF_STEPS = 10
HORIZON = 12
MINIMUM_OBSERVATIONS = 10


def _typed(df: DataFrame, columns: Sequence[str]) -> list[str]:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [f"`{c}` {kinds[c]}" for c in columns]


class VarStatistics:
    """Lagged cross products per unit from which every order 0..max_lags can be solved.

    Each row contributes z z' for z = [1, lag-1 values, ..., lag-L values, values], standardized by
    the table's overall mean and deviation. Rows are classed by the number of lags they have
    (at most L): orders are compared on class L, the final fit of order p uses classes p..L.
    """

    def __init__(self, df: DataFrame, variables: Sequence[str], order_by: Sequence[str], unit: Sequence[str] = (), max_lags: int = MAX_LAGS):
        self.variables, self.unit, self.max_lags = list(variables), list(unit), max_lags
        names = self.variables
        used = df.select(*dict.fromkeys([*self.unit, *order_by]), *[F.col(c).cast("double").alias(f"_y{i}") for i, c in enumerate(names)])
        used = used.na.drop(subset=[f"_y{i}" for i in range(len(names))])
        sliced = slice_rows(used, order_by, self.unit)
        level = sliced.frame.agg(
            *[F.avg(f"_y{i}").alias(f"m{i}") for i in range(len(names))],
            *[F.stddev_pop(f"_y{i}").alias(f"s{i}") for i in range(len(names))],
        ).first()
        self.mean = np.array([level[f"m{i}"] or 0.0 for i in range(len(names))])
        self.scale = np.array([level[f"s{i}"] or 1.0 for i in range(len(names))])
        self.grams = spill(self._grams(sliced), "var")

    def _grams(self, sliced: Sliced) -> DataFrame:
        m, lags, unit = len(self.variables), self.max_lags, self.unit
        wanted = {f"_l{k}_{i}": (f"_y{i}", k) for k in range(1, lags + 1) for i in range(m)}
        rows = sliced.shifted(wanted)
        seen = sum((F.col(f"_l{k}_0").isNotNull().cast("int") for k in range(1, lags + 1)), F.lit(0))
        columns = [f"_l{k}_{i}" for k in range(1, lags + 1) for i in range(m)] + [f"_y{i}" for i in range(m)]
        picked = rows.select(
            *unit, seen.alias("_class"), F.col("_slice").alias("_part"), *columns
        )
        mean = np.tile(self.mean, lags + 1)
        scale = np.tile(self.scale, lags + 1)
        keys = [*unit, "_class", "_part"]
        schema = ", ".join([*_typed(picked, keys), "n double", "gram array<double>"])
        size = 1 + m * (lags + 1)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[tuple, list] = {}
            for batch in batches:
                z = np.nan_to_num((batch[columns].to_numpy(dtype=float) - mean) / scale, nan=0.0)
                z = np.hstack([np.ones((len(z), 1)), z])
                for key, at in batch.groupby(keys, dropna=False, sort=False).indices.items():
                    part = z[at]
                    entry = held.setdefault(key if isinstance(key, tuple) else (key,), [0.0, np.zeros((size, size))])
                    entry[0] += len(at)
                    entry[1] += part.T @ part
                if len(held) * size * size > 8_000_000:
                    yield flush(held)
                    held = {}
            if held:
                yield flush(held)

        def flush(held: dict[tuple, list]) -> pd.DataFrame:
            out = pd.DataFrame(list(held.keys()), columns=keys)
            out["n"] = [v[0] for v in held.values()]
            out["gram"] = [v[1].ravel().tolist() for v in held.values()]
            return out

        def merge(part: pd.DataFrame) -> pd.DataFrame:
            out = part.iloc[:1][keys].copy()
            out["n"] = part["n"].sum()
            total = np.zeros(size * size)
            for g in part["gram"]:
                total += np.asarray(g, float)
            out["gram"] = [total.tolist()]
            return out

        return merged_in_levels(picked.mapInPandas(partial, schema), keys[:-1], merge, schema, "_part").drop("_part")

    def _solved(self, order: int | None, emit, schema: str) -> DataFrame:
        """Run ``emit(key values, solution)`` per unit on its few Gram rows (at most L + 1)."""
        lags, names = self.max_lags, self.variables
        mean, scale, unit = self.mean, self.scale, self.unit
        m = len(names)

        def solve(rows: pd.DataFrame) -> pd.DataFrame:
            size = 1 + m * (lags + 1)
            grams = {int(r["_class"]): (r["n"], np.asarray(r["gram"], float).reshape(size, size)) for _, r in rows.iterrows()}
            found = solve_var(grams, m, lags, mean, scale, order)
            key = [rows[c].iloc[0] for c in unit]
            return emit(key, found)

        grouped = self.grams.groupBy(*unit) if unit else self.grams.withColumn("_all", F.lit(0)).groupBy("_all")
        return grouped.applyInPandas(solve, schema)

    def coefficients(self, order: int | None = None) -> DataFrame:
        """(unit..., lag_order, equation, term, coefficient); terms are 'const' and '{variable}.L{k}'."""
        names, unit = self.variables, self.unit
        schema = ", ".join([*_typed(self.grams, unit), "lag_order int", "equation string", "term string", "coefficient double"])

        def emit(key, s):
            rows = []
            for e, equation in enumerate(names):
                rows.append((*key, s["order"], equation, "const", s["const"][e]))
                for k, a in enumerate(s["lags"], 1):
                    rows += [(*key, s["order"], equation, f"{v}.L{k}", a[e, j]) for j, v in enumerate(names)]
            return pd.DataFrame(rows, columns=[*unit, "lag_order", "equation", "term", "coefficient"])

        return self._solved(order, emit, schema)

    def impulse_responses(self, order: int | None = None, steps: int = IRF_STEPS) -> DataFrame:
        """(unit..., step, impulse, response, effect, cumulative) for steps 0..``steps``."""
        names, unit = self.variables, self.unit
        schema = ", ".join([*_typed(self.grams, unit), "step int", "impulse string", "response string", "effect double", "cumulative double"])

        def emit(key, s):
            rows, total = [], np.zeros((len(names), len(names)))
            for step, effect in enumerate(moving_average(s["lags"], len(names), steps)):
                total = total + effect
                rows += [
                    (*key, step, names[j], names[i], effect[i, j], total[i, j]) for i in range(len(names)) for j in range(len(names))
                ]
            return pd.DataFrame(rows, columns=[*unit, "step", "impulse", "response", "effect", "cumulative"])

        return self._solved(order, emit, schema)

    def diagnostics(self, order: int | None = None) -> DataFrame:
        """Lag order, criteria, stability and total coefficient size per unit."""
        unit = self.unit
        numbers = ["aic", "bic", "hqic", "fpe", "largest_root"]
        schema = ", ".join(
            [*_typed(self.grams, unit), "lag_order int", "observations long", *[f"{c} double" for c in numbers],
             "stable boolean", "total_parameters int", "coefficient_magnitude double"]
        )

        def emit(key, s):
            row = (*key, s["order"], int(s["n"]), *[s[c] for c in numbers], bool(s["largest_root"] < 1.0),
                   s["order"] * len(s["const"]) ** 2, float(np.abs(s["const"]).sum() + sum(np.abs(a).sum() for a in s["lags"])))
            return pd.DataFrame([row], columns=[*unit, "lag_order", "observations", *numbers, "stable", "total_parameters", "coefficient_magnitude"])

        return self._solved(order, emit, schema)


def _order_fit(gram: np.ndarray, n: float, m: int, lags: int, p: int):
    x = [0, *range(1, 1 + m * p)]
    y = list(range(1 + m * lags, 1 + m * (lags + 1)))
    a, b = gram[np.ix_(x, x)], gram[np.ix_(x, y)]
    solution = np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ b
    errors = gram[np.ix_(y, y)] - b.T @ solution - solution.T @ b + solution.T @ a @ solution
    return solution, errors / n


def _criteria(sigma: np.ndarray, n: float, m: int, p: int, shift: float) -> dict[str, float]:
    sign, log_det = np.linalg.slogdet(sigma)
    log_det = (log_det if sign > 0 else float("-inf")) + shift
    free = p * m * m + m
    per_equation = p * m + 1
    fpe = float("nan") if n <= per_equation else ((n + per_equation) / (n - per_equation)) ** m * math.exp(log_det)
    return {
        "aic": log_det + 2.0 / n * free,
        "bic": log_det + math.log(n) / n * free,
        "hqic": log_det + 2.0 * math.log(math.log(n)) / n * free if n > math.e else float("nan"),
        "fpe": fpe,
    }


def solve_var(grams: dict[int, tuple], m: int, lags: int, mean: np.ndarray, scale: np.ndarray, order: int | None) -> dict:
    """Choose the order by AIC on the common sample (unless given), then refit on all usable rows."""
    size = 1 + m * (lags + 1)
    shift = 2.0 * float(np.log(scale).sum())

    def pooled(p: int):
        n, g = 0.0, np.zeros((size, size))
        for level, (count, gram) in grams.items():
            if level >= p:
                n, g = n + count, g + gram
        return n, g

    if order is None:
        n, g = pooled(lags)
        best = (float("inf"), 0)
        for p in range(lags + 1):
            if n > 1 + m * p:
                aic = _criteria(_order_fit(g, n, m, lags, p)[1], n, m, p, shift)["aic"]
                best = min(best, (aic, p))
        order = best[1]
    n, g = pooled(order)
    if n <= 0:
        nothing = {c: float("nan") for c in ("aic", "bic", "hqic", "fpe")}
        return {"order": order, "n": n, "const": np.full(m, np.nan), "lags": [], "largest_root": float("nan"), **nothing}
    solution, sigma = _order_fit(g, n, m, lags, order)
    matrices = [
        (solution[1 + m * k : 1 + m * (k + 1), :].T * scale[:, None]) / scale[None, :] for k in range(order)
    ]
    const = mean + scale * solution[0] - sum((a @ mean for a in matrices), np.zeros(m))
    root = 0.0
    if order:
        companion = np.zeros((m * order, m * order))
        companion[:m] = np.hstack(matrices)
        companion[m:, :-m] = np.eye(m * (order - 1))
        root = float(np.abs(np.linalg.eigvals(companion)).max())
    return {"order": order, "n": n, "const": const, "lags": matrices, "largest_root": root, **_criteria(sigma, n, m, order, shift)}


def moving_average(matrices: Sequence[np.ndarray], m: int, steps: int) -> list[np.ndarray]:
    """Responses to a unit impulse at steps 0..steps."""
    effects = [np.eye(m)]
    for step in range(1, steps + 1):
        effects.append(sum((effects[step - k] @ a for k, a in enumerate(matrices, 1) if step >= k), np.zeros((m, m))))
    return effects


def var_importance(coefficients: DataFrame, variables: Sequence[str], unit: Sequence[str] = ()) -> DataFrame:
    """Sum of absolute lag coefficients of each variable over all equations; 0 when no lag was chosen."""
    variable = F.regexp_replace("term", r"\.L\d+$", "")
    mine = lambda v: (F.col("term") != "const") & (variable == v)
    structs = [
        F.struct(
            F.lit(v).alias("variable"),
            F.coalesce(F.sum(F.when(mine(v), F.abs("coefficient"))), F.lit(0.0)).alias("total_magnitude"),
            F.count_distinct(F.when(mine(v), F.col("equation"))).alias("equations"),
        ).alias(f"_v{i}")
        for i, v in enumerate(variables)
    ]
    packed = coefficients.groupBy(*unit).agg(*structs)
    return packed.select(*unit, F.inline(F.array(*[f"_v{i}" for i in range(len(structs))])))


def ar_impact(
    df: DataFrame,
    target: str,
    order_by: Sequence[str],
    unit: Sequence[str] = (),
    order: int | None = None,
    max_lags: int = MAX_LAGS,
    difference: int = 0,
    post: str | None = None,
) -> DataFrame:
    """One-step autoregressive fit per unit, effect = actual - fit and its running sum.

    The order is chosen by AIC unless given; ``difference=1`` models changes. With ``post`` the fit
    uses only rows where that flag is 0 and effects count only where it is 1. The first rows of
    a unit have no fit, so no effect.
    """
    keep = [*unit, *order_by, *([post] if post else [])]
    base = df.select(*dict.fromkeys(keep), F.col(target).cast("double").alias("actual")).filter(F.col("actual").isNotNull())
    sliced = slice_rows(base, order_by, unit)
    lags = order if order is not None else max_lags
    wanted = {f"_b{k}": ("actual", k) for k in range(1, lags + difference + 1)}
    rows = sliced.shifted(wanted)
    level = lambda k: F.col("actual") if k == 0 else F.col(f"_b{k}")
    change = (lambda k: level(k) - level(k + 1)) if difference else level
    shown = spill(rows.withColumns({f"_x{k}": change(k) for k in range(lags + 1)}), "impact")
    training = shown.filter("_x0 is not null")
    if post:
        training = training.filter(F.col(post) == 0)
    stats = _LaggedStatistics(training, lags, unit)
    table = stats.coefficient_table(order)
    joined = sliced.attach(shown, table, "left")
    fit = F.col("_beta")[0]
    for k in range(1, lags + 1):
        # Orders above the chosen one have coefficient 0 and may lack a lag.
        weight = F.col("_beta")[k]
        fit = fit + F.when(weight == 0, F.lit(0.0)).otherwise(weight * F.col(f"_x{k}"))
    if difference:
        fit = fit + F.col("_b1")
    effect = F.col("actual") - fit
    if post:
        effect = F.when(F.col(post) == 1, effect)
    scored = joined.withColumn("prediction", fit).withColumn("effect", effect)
    columns = [*dict.fromkeys(keep), "actual", "prediction", "effect"]
    # The rows are still cut into the slices made above, so the running sum needs no new order.
    running = Sliced(spill(scored.select(*columns, "_slice", "_pos"), "effects"), unit, columns).scan(sums={"cumulative_effect": "effect"})
    return running.select(*columns, "cumulative_effect")


class _LaggedStatistics:
    """Autoregression of _x0 on _x1.._xL per unit, by the same lagged cross products."""

    def __init__(self, rows: DataFrame, lags: int, unit: Sequence[str]):
        self.lags, self.unit = lags, list(unit)
        level = rows.agg(F.avg("_x0").alias("m"), F.stddev_pop("_x0").alias("s")).first()
        self.mean, self.scale = float(level["m"] or 0.0), float(level["s"] or 1.0)
        z = [F.lit(1.0)] + [
            F.coalesce((F.col(f"_x{k}") - F.lit(self.mean)) / F.lit(self.scale), F.lit(0.0)) for k in [*range(1, lags + 1), 0]
        ]
        seen = sum((F.col(f"_x{k}").isNotNull().cast("int") for k in range(1, lags + 1)), F.lit(0))
        named = rows.select(*unit, seen.alias("_class"), *[c.alias(f"_z{i}") for i, c in enumerate(z)])
        size = len(z)
        sums = [F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"_g{i}_{j}") for i in range(size) for j in range(i, size)]
        grouped = named.groupBy(*unit, "_class").agg(F.count(F.lit(1)).cast("double").alias("n"), *sums)
        gram = F.array(*[F.col(f"_g{min(i, j)}_{max(i, j)}") for i in range(size) for j in range(size)])
        self.grams = grouped.select(*unit, "_class", "n", gram.alias("gram"))

    def coefficient_table(self, order: int | None) -> DataFrame:
        lags, unit = self.lags, self.unit
        mean, scale = np.array([self.mean]), np.array([self.scale])
        schema = ", ".join([*_typed(self.grams, unit), "_order int", "_beta array<double>"])

        def solve(rows: pd.DataFrame) -> pd.DataFrame:
            size = lags + 2
            grams = {int(r["_class"]): (r["n"], np.asarray(r["gram"], float).reshape(size, size)) for _, r in rows.iterrows()}
            s = solve_var(grams, 1, lags, mean, scale, order)
            beta = [float(s["const"][0]), *[float(a[0, 0]) for a in s["lags"]]]
            beta += [0.0] * (lags + 1 - len(beta))
            out = pd.DataFrame([[rows[c].iloc[0] for c in unit] + [s["order"]]], columns=[*unit, "_order"])
            out["_beta"] = [beta]
            return out

        grouped = self.grams.groupBy(*unit) if unit else self.grams.withColumn("_all", F.lit(0)).groupBy("_all")
        return grouped.applyInPandas(solve, schema)


def impact_summary(effects: DataFrame, unit: Sequence[str] = ()) -> DataFrame:
    """Cumulative, mean and std of the effect, and the effect as percent of the total."""
    total = F.coalesce(F.sum("effect"), F.lit(0.0))
    return effects.groupBy(*unit).agg(
        total.alias("cumulative_effect"), F.avg("effect").alias("average_effect"), F.stddev_samp("effect").alias("effect_std"),
        F.coalesce(F.try_divide(total, F.sum("actual")) * 100, F.lit(0.0)).alias("relative_percent"),
    )


def future_keys(last: DataFrame, horizon: int, time: str, step: str = "step") -> DataFrame:
    """``horizon`` future times per row: time + i x step (numbers, or seconds for timestamps)."""
    kind = dict(last.dtypes)[time]
    exploded = last.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    if kind in ("timestamp", "timestamp_ntz"):
        ahead = F.col(time) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("h") * F.col(step)).cast("decimal(18,6)"))
    elif kind == "date":
        ahead = F.date_add(time, (F.col("h") * F.col(step)).cast("int"))
    else:
        ahead = (F.col(time) + F.col("h") * F.col(step)).cast(kind)
    return exploded.withColumn(time, ahead)


def forecast(
    df: DataFrame,
    time: str,
    target: str,
    horizon: int = HORIZON,
    unit: Sequence[str] = (),
    season: int | None = None,
    step: float = 1,
) -> DataFrame:
    """History rows followed by ``horizon`` forecast rows per unit with 10 % and 90 % bounds.

    Without ``season`` the forecast is the last value plus the mean change per step; with it, the
    value one season earlier. Bounds add the residual quantiles of the same rule applied one step
    (season) ahead inside the history, widened by the square root of the steps (seasons) ahead.
    ``step`` is the distance between times (seconds for timestamps, days for dates).
    """
    unit = list(unit)
    base = df.select(*unit, time, F.col(target).cast("double").alias(target)).na.drop(subset=[time, target])
    sliced = slice_rows(base, [time], unit)
    back = season or 1
    # Forecasts need the history's last rows per unit: rows with fewer than ``back`` rows behind them.
    near = spill(sliced.shifted({"_before": (target, back), "_ahead": (target, -back)}), "history")
    ends = near.groupBy(*unit).agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(target, "_pos").alias("_first"), F.max_by(target, "_pos").alias("_last"), F.max(time).alias("_time")
    )
    drift = F.coalesce(F.try_divide(F.col("_last") - F.col("_first"), F.col("_n") - 1), F.lit(0.0))
    ends = ends.withColumn("_drift", drift if season is None else F.lit(0.0))
    errors = sliced.attach(near.filter(F.col("_before").isNotNull()), ends.select(*unit, "_drift")).select(
        *unit, (F.col(target) - F.col("_before") - F.col("_drift")).alias("_error")
    )
    # From here on both sides have one row per unit.
    keyed = lambda a, b, how="inner": (
        a.join(b, unit, how) if unit else a.withColumn("_k", F.lit(1)).join(F.broadcast(b.withColumn("_k", F.lit(1))), "_k", how).drop("_k")
    )
    bounds = quantiles(errors, ["_error"], [0.1, 0.9], unit).select(*unit, F.col("q0").alias("_q10"), F.col("q1").alias("_q90"))
    future = future_keys(keyed(ends, bounds, "left").withColumnsRenamed({"_time": time}).withColumn("step", F.lit(step)), horizon, time)
    if season is None:
        point, wide = F.col("_last") + F.col("h") * F.col("_drift"), F.sqrt(F.col("h").cast("double"))
    else:
        # The last season's rows: the ones with no row ``season`` places ahead, numbered 1..season.
        tail = near.filter(F.col("_ahead").isNull()).select(*unit, target, "_pos")
        places = tail.groupBy(*unit).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", target))), lambda s: s[target]).alias("_tail"))
        future = keyed(future, places)
        point = F.try_element_at("_tail", (F.pmod(F.col("h") - 1, F.lit(season)) + 1).cast("int"))
        wide = F.sqrt(F.ceil(F.col("h") / season).cast("double"))
    forecast_rows = future.select(
        *unit, time, F.lit(None).cast("double").alias("actual"), point.alias("predicted"),
        (point + F.col("_q10") * wide).alias("lower"), (point + F.col("_q90") * wide).alias("upper"), F.lit("forecast").alias("data_type"),
    )
    value = F.col(target)
    history = near.select(
        *unit, time, value.alias("actual"), value.alias("predicted"), value.alias("lower"), value.alias("upper"), F.lit("historical").alias("data_type")
    )
    return history.unionByName(forecast_rows)


def holdout_metrics(
    df: DataFrame, time: str, target: str, unit: Sequence[str] = (), share: float = 0.2, season: int | None = None
) -> DataFrame:
    """Errors on the last ``share`` of each unit, forecast from its training part only.

    With ``season`` a row takes the value one or more seasons earlier; where a unit's training part is
    shorter than a season and lacks that place, the drift rule of the form without season serves.
    """
    unit = list(unit)
    base = df.select(*unit, time, F.col(target).cast("double").alias(target)).na.drop(subset=[time, target])
    sliced = slice_rows(base, [time], unit)
    placed = spill(sliced.scan(number="_rn"), "holdout")
    sizes = placed.groupBy(*unit).agg(F.count(F.lit(1)).alias("_n"))
    cut = F.floor(F.lit(1 - share) * F.col("_n"))
    parts = sliced.attach(placed, sizes).withColumn("_cut", cut)
    training = parts.filter(F.col("_rn") <= F.col("_cut"))
    ends = training.groupBy(*unit).agg(
        F.min_by(target, "_rn").alias("_first"), F.max_by(target, "_rn").alias("_last"), F.count(F.lit(1)).alias("_m"),
        # the last season of a unit: at most ``season`` values
        *([] if season is None else [F.collect_list(F.when(F.col("_rn") > F.col("_cut") - season, F.struct("_rn", target))).alias("_tail")]),
    )
    slope = F.coalesce(F.try_divide(F.col("_last") - F.col("_first"), F.col("_m") - 1), F.lit(0.0))
    drift = F.col("_last") + (F.col("_rn") - F.col("_cut")) * slope
    scored = sliced.attach(parts.filter(F.col("_rn") > F.col("_cut")), ends)
    if season is None:
        scored = scored.withColumn("_p", drift)
    else:
        values = F.transform(F.array_sort("_tail"), lambda s: s[target])
        place = F.pmod(F.col("_rn") - F.col("_cut") - 1, F.lit(season)) - (F.lit(season) - F.size("_tail"))
        seasonal = F.when(place >= 0, F.try_element_at(values, (place + 1).cast("int")))
        scored = scored.withColumn("_p", F.coalesce(seasonal, drift))
    return fit_metrics(scored, target, "_p", 0, unit).select(*unit, F.col("observations").alias("test_size"), "mae", "mse", "rmse", "mape")
