"""Treatment effects: difference-in-differences, synthetic control, score matching."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelift.functions.columns import safe_name
from panelift.operators.filters import assert_flags
from panelift.operators.gram import LinearFit
from panelift.operators.linear import fit_ols, inference_rows, linear_expression
from panelift.operators.ordered import slice_rows
from panelift.session import spill
from panelift.functions.tails import t_quantile, t_two_sided

INTERACTION = "treated:post"


def dummy_columns(df: DataFrame, column: str) -> tuple[DataFrame, list[str]]:
    """0/1 columns for the levels of a text column in sorted order, the first level left out.

    Every level becomes a regressor, so the fit grows with the square of their number (``did_absorbed``
    takes many levels without dummies). Levels whose safe names meet (``a b`` and ``a-b``), also with the
    left-out first level or an existing column, are told apart by a number: ``_2``, ``_3``, ... in level order.
    """
    every = sorted(str(r[0]) for r in df.select(column).na.drop().distinct().collect())
    taken = set(df.columns) | ({f"{column}_{safe_name(every[0])}"} if every else set())
    levels, names = every[1:], []
    for v in levels:
        name, count = f"{column}_{safe_name(v)}", 1
        while name in taken:
            count += 1
            name = f"{column}_{safe_name(v)}_{count}"
        taken.add(name)
        names.append(name)
    flags = {n: (F.col(column).cast("string") == v).cast("double") for n, v in zip(names, levels)}
    return (df.withColumns(flags) if flags else df), names


def did_fit(df: DataFrame, target: str, features: Sequence[str] = ()) -> tuple[LinearFit, DataFrame]:
    """target ~ treated * post + features; returns the fit and the frame with its regressors."""
    assert_flags(df, ["treated", "post"], both=False)
    out = df.withColumn(INTERACTION, (F.col("treated") * F.col("post")).cast("double"))
    terms = ["treated", "post", INTERACTION]
    kinds = dict(df.dtypes)
    for c in features:
        if kinds[c] == "string":
            out, names = dummy_columns(out, c)
            terms += names
        else:
            terms.append(c)
    return fit_ols(out, target, terms, missing="drop"), out


def did_effect(spark, fit: LinearFit) -> DataFrame:
    """Average treatment effect with standard error, 95 % interval, p-value and fit figures."""
    term = next(r for r in inference_rows(fit) if r[0] == INTERACTION)
    k = len(fit.features)
    f = None if fit.sse <= 0 or fit.df_resid <= 0 else (fit.sst - fit.sse) / k / (fit.sse / fit.df_resid)
    row = (term[1], term[2], term[3], term[4], term[5], term[6], term[7], fit.r2, f, int(fit.n))
    return spark.createDataFrame(
        [row],
        "ate double, std_error double, t_value double, p_value double, ci_low double, ci_high double, "
        "significant boolean, r_squared double, f_statistic double, observations long",
    )


def did_absorbed(
    df: DataFrame, target: str, features: Sequence[str] = (), absorb: Sequence[str] = (), tolerance: float = 1e-10, rounds: int = 200
) -> DataFrame:
    """Difference-in-differences with the levels of ``absorb`` columns as fixed effects, without dummies.

    Every variable (target, treated, post, treated:post, numeric ``features``) is demeaned within the
    levels of each absorbed column in turn (alternating projections); with one absorbed column one pass
    is exact, with more the passes repeat until no level mean of any variable exceeds ``tolerance`` times
    the variable's spread (at most ``rounds`` rounds; ``converged`` tells). Each pass is written to the
    shared folder. Least squares on the demeaned variables then gives the effect; a regressor whose
    demeaned sum of squares is below 1e-12 of its own is absorbed (e.g. treated, when it is fixed within a
    level) and left out. Residual degrees of freedom: rows - regressors - (sum of levels - columns + 1).
    r_squared is the within R2. Rows with a null in any used column are left out. Only counts of levels
    and one small cross-product matrix reach the driver, never the levels.
    """
    assert_flags(df, ["treated", "post"], both=False)
    absorb, features = list(absorb), list(features)
    names = ["_y", "treated", "post", "_did", *[f"_f{i}" for i in range(len(features))]]
    rows = df.select(
        *[F.col(c) for c in absorb], F.col(target).cast("double").alias("_y"), F.col("treated").cast("double").alias("treated"),
        F.col("post").cast("double").alias("post"), (F.col("treated") * F.col("post")).cast("double").alias("_did"),
        *[F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(features)],
    ).na.drop()
    rows = spill(rows, "absorbed")
    spread = rows.agg(*[F.stddev_pop(v).alias(v) for v in names], *[F.count_distinct(c).alias(f"_l{i}") for i, c in enumerate(absorb)], F.count(F.lit(1)).alias("_n")).first()
    total = {v: float(spread[v] or 0.0) for v in names}
    levels = sum(int(spread[f"_l{i}"]) for i in range(len(absorb)))
    converged, done = True, 0
    for done in range(1, rounds + 1):
        for c in absorb:
            means = rows.groupBy(c).agg(*[F.avg(v).alias(f"_m{v}") for v in names])
            rows = spill(rows.join(means, c).select(*absorb, *[(F.col(v) - F.col(f"_m{v}")).alias(v) for v in names]), "absorbed")
        if len(absorb) <= 1:
            break
        largest = [rows.groupBy(c).agg(*[F.abs(F.avg(v)).alias(v) for v in names]).agg(*[F.max(v).alias(v) for v in names]).first() for c in absorb]
        converged = all(float(w[v] or 0.0) <= tolerance * (total[v] or 1.0) for w in largest for v in names)
        if converged:
            break
    regressors = names[1:]
    sums = rows.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for i, a in enumerate(names) for b in names[i:]]).first().asDict()
    product = lambda a, b: float(sums.get(f"{a}|{b}", sums.get(f"{b}|{a}")) or 0.0)
    n = int(spread["_n"])
    kept = [v for v in regressors if product(v, v) > 1e-12 * max(total[v] ** 2 * n, 1e-300)]
    xx = np.array([[product(a, b) for b in kept] for a in kept]).reshape(len(kept), len(kept))
    xy = np.array([product(a, "_y") for a in kept])
    inverse = np.linalg.pinv(xx) if len(kept) else np.zeros((0, 0))
    beta = inverse @ xy
    yy = product("_y", "_y")
    sse = max(0.0, yy - float(beta @ xy))
    dof = n - len(kept) - (levels - len(absorb) + 1 if absorb else 1)
    ate = se = t = p = low = high = None
    if "_did" in kept:
        j = kept.index("_did")
        ate = float(beta[j])
        if dof > 0:
            se = float(np.sqrt(sse / dof * inverse[j, j]))
            t = ate / se if se > 0 else float("inf") * float(np.sign(ate))
            p = t_two_sided(t, dof)
            reach = t_quantile(0.975, dof)
            low, high = ate - reach * se, ate + reach * se
    r2 = 1 - sse / yy if yy > 0 else None
    row = (ate, se, t, p, low, high, p is not None and p < 0.05, r2, n, levels, converged, done)
    return df.sparkSession.createDataFrame(
        [row],
        "ate double, std_error double, t_value double, p_value double, ci_low double, ci_high double, significant boolean, "
        "r_squared double, observations long, absorbed_levels long, converged boolean, rounds int",
    )


def did_effect_size(effect: DataFrame, df: DataFrame, target: str) -> DataFrame:
    """|ate| over the target's standard deviation with its band, and whether the interval is narrow."""
    std = df.agg(F.stddev_samp(target)).first()[0]
    sd = F.lit(std).cast("double")
    size = F.try_divide(F.abs("ate"), sd)
    band = F.when(sd == 0, "cannot assess").when(size < 0.2, "small").when(size < 0.5, "medium").otherwise("large")
    width = F.col("ci_high") - F.col("ci_low")
    return effect.select(
        "ate", size.alias("effect_size"), band.alias("band"), width.alias("ci_width"), (width < sd).alias("narrow_interval")
    )


def synthetic_control(
    df: DataFrame, target: str, features: Sequence[str], intercept: bool = False
) -> tuple[LinearFit, DataFrame]:
    """Weights from control rows; treated rows get features . weights, control rows their actual value.

    ``intercept`` adds the fitted constant to the synthetic value of treated rows.
    """
    assert_flags(df, ["treated"])
    control = df.filter(F.col("treated") == 0)
    fit = fit_ols(control, target, features, missing="raise")
    if fit.n < len(features):
        raise ValueError(f"{int(fit.n)} control rows are too few for {len(features)} features")
    synthetic = F.when(F.col("treated") == 0, F.col(target).cast("double")).otherwise(linear_expression(fit, intercept))
    return fit, df.withColumn("actual", F.col(target).cast("double")).withColumn("synthetic", synthetic)


def sc_diagnostics(df: DataFrame) -> DataFrame:
    """Fit and effect figures over all rows, and the error over treated rows alone."""
    gap = F.col("actual") - F.col("synthetic")
    treated_square = F.when(F.col("treated") == 1, gap * gap)
    return df.agg(
        F.sqrt(F.avg(gap * gap)).alias("rmspe"), F.avg(gap * gap).alias("mspe"), F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(treated_square)).alias("rmspe_treated"), F.avg(gap).alias("mean_effect"), F.sum(gap).alias("cumulative_effect"),
        F.stddev_samp(gap).alias("effect_std"), F.min(gap).alias("min_effect"), F.max(gap).alias("max_effect"),
    )


def zscore(df: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """(x - mean) / population standard deviation; a constant column becomes 0."""
    r = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]
    ).first()
    return df.withColumns(
        {f"{c}{suffix}": (F.col(c) - F.lit(r[f"m{i}"])) / F.lit(r[f"s{i}"] or 1.0) for i, c in enumerate(columns)}
    )


def propensity_score(df: DataFrame, features: Sequence[str], treated: str = "treated", name: str = "propensity") -> DataFrame:
    """Linear probability of treatment from z-scored features."""
    scaled = zscore(df, features)
    fit = fit_ols(scaled, treated, [f"{c}_z" for c in features])
    return scaled.withColumn(name, linear_expression(fit)).drop(*[f"{c}_z" for c in features])


def nearest_match(
    df: DataFrame, score: str, key: str, carry: Sequence[str] = (), treated: str = "treated", pool: str = "controls"
) -> DataFrame:
    """Nearest pool row by score for every treated row, with replacement.

    Rows are put in score order (slices with carry, so equal scores may fill many slices) and the
    closest pool row on either side is compared; the lower side wins a tie. ``pool='all'`` lets
    treated rows match themselves. Output: key, score, carry..., match_key, match_score,
    match_{carry}..., gap.
    """
    used = df.select(*dict.fromkeys([key, score, treated, *carry]))
    member = (F.col(treated) == 0) if pool == "controls" else F.lit(True)
    # one struct per side: a carried value that is missing stays the match's own missing value
    picked = F.when(member & F.col(score).isNotNull(), F.struct(*dict.fromkeys([key, score, *carry])))
    sliced = slice_rows(used.withColumn("_p", picked), [score, key])
    seen = sliced.scan(last={"_b": "_p"}, following={"_a": "_p"})
    below, above = F.col(score) - F.col("_b")[score], F.col("_a")[score] - F.col(score)
    lower = F.col("_b").isNotNull() & (F.col("_a").isNull() | (below <= above))
    pick = lambda c: F.when(lower, F.col("_b")[c]).otherwise(F.col("_a")[c])
    matched = seen.filter(F.col(treated) == 1)
    return matched.select(
        *dict.fromkeys([key, score, *carry]),
        pick(key).alias("match_key"), pick(score).alias("match_score"), *[pick(c).alias(f"match_{c}") for c in carry],
        F.when(lower, below).otherwise(above).alias("gap"),
    )


def matched_att(matches: DataFrame, outcome: str) -> DataFrame:
    """Mean treated outcome minus mean matched outcome."""
    sums = matches.agg(
        F.count(F.lit(1)).alias("treated_count"), F.avg(outcome).alias("treated_mean"), F.avg(f"match_{outcome}").alias("matched_mean")
    )
    att = F.col("treated_mean") - F.col("matched_mean")
    return sums.withColumn("att", att).withColumn("direction", F.when(att > 0, "positive").otherwise("negative"))


def matching_balance(df: DataFrame, matches: DataFrame, features: Sequence[str], key: str, treated: str = "treated") -> DataFrame:
    """Standardized mean differences before and after matching.

    Matches are counted per control row first, so a control row used very often joins once.
    """
    uses = matches.groupBy(F.col("match_key").alias(key)).agg(F.count(F.lit(1)).cast("double").alias("_w"))
    rows = df.select(key, treated, *features).join(uses, key, "left")
    is_treated, weight = F.col(treated) == 1, F.coalesce("_w", F.lit(0.0))
    structs = []
    for c in features:
        x = F.col(c).cast("double")
        t, u = F.when(is_treated, x), F.when(~is_treated, x)
        matched_mean = F.try_divide(F.sum(F.when(~is_treated, x * weight)), F.sum(F.when(~is_treated & x.isNotNull(), weight)))
        spread = F.sqrt((F.var_samp(t) + F.var_samp(u)) / 2)
        structs.append(
            F.struct(
                F.lit(c).alias("feature"), F.avg(t).alias("treated_mean"), F.avg(u).alias("control_mean"), matched_mean.alias("matched_mean"),
                F.try_divide(F.avg(t) - F.avg(u), spread).alias("smd_before"),
                F.try_divide(F.avg(t) - matched_mean, spread).alias("smd_after"),
            )
        )
    packed = rows.agg(*[s.alias(f"_s{i}") for i, s in enumerate(structs)])
    return packed.select(F.inline(F.array(*[f"_s{i}" for i in range(len(structs))])))
