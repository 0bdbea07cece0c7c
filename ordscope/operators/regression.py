"""Linear models from distributed sufficient statistics.

A model never sees a design matrix. Rows are reduced to moments per factor
combination, moments to a Gram matrix in tidy form (one row per pair of terms),
and only that k x k matrix is solved with NumPy inside one task. Standard errors
use the same construction with residual weights.

Where a model has more than ``DENSE_TERMS`` terms, its largest factors are absorbed
(see ``absorption``): the matrix then holds what they leave of the other terms, so it
stays that small whatever the number of levels. Estimates, fit and tests are the same;
the absorbed effects themselves are not listed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordscope import fixed_values as fv
from ordscope.functions.probability import (
    f_sf,
    normal_cdf,
    normal_cdf_col,
    one_sided,
    t_cdf,
    t_cdf_col,
    two_sided_normal,
)
from ordscope.operators.absorption import Absorbed, absorb
from ordscope.operators.checks import join_null_safe, require_columns
from ordscope.operators.quantiles import coarse_bucket
from ordscope.session import materialise

INTERCEPT = "Intercept"
OUTCOME = "__y"
TOTAL = "__total"
DENSE_TERMS = 1000


@dataclass(frozen=True)
class OlsSpec:
    """Outcome, numeric regressors, factors (treatment coded), reference levels."""

    outcome: str
    numeric: tuple[str, ...] = ()
    factors: tuple[str, ...] = ()
    reference: Mapping[str, str] = field(default_factory=dict)


# ---- simple gradient -----------------------------------------------------


def fit_gradient(df: DataFrame, by: Sequence[str] = (), x: str = "weight", y: str = "delta") -> DataFrame:
    """Least-squares line of y on x per group: alpha, beta, n_obs, sigma.

    With fewer than two distinct x the slope does not exist: a single fit fails,
    a grouped fit returns NULLs for that group.
    """
    require_columns(df, [*by, x, y], "table")
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    fit = df.groupBy(*by).agg(
        F.regr_intercept(yd, xd).alias("alpha"),
        F.regr_slope(yd, xd).alias("beta"),
        F.regr_count(yd, xd).alias("n_obs"),
        F.regr_syy(yd, xd).alias("__syy"),
        F.regr_sxx(yd, xd).alias("__sxx"),
    )
    rss = F.greatest(F.col("__syy") - F.col("beta") * F.col("beta") * F.col("__sxx"), F.lit(0.0))
    fit = fit.withColumn("sigma", F.sqrt(rss / F.col("n_obs"))).drop("__syy", "__sxx")
    if not by:
        message = F.lit("need at least 2 distinct weights to fit a gradient")
        # In a filter, so that the check stays whichever columns are read.
        fit = fit.where(F.when(F.col("beta").isNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    return fit


# ---- pooled gradient with clustered errors --------------------------------


def _cluster_moments(df: DataFrame, x: str, y: str, cluster: Sequence[str]) -> DataFrame:
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    return (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .dropna(subset=list(cluster))
        .groupBy(*cluster)
        .agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.sum(xd).alias("sx"),
            F.sum(yd).alias("sy"),
            F.sum(xd * xd).alias("sxx"),
            F.sum(xd * yd).alias("sxy"),
            F.sum(yd * yd).alias("syy"),
        )
    )


def clustered_slope(df: DataFrame, x: str, y: str, cluster: Sequence[str]) -> DataFrame:
    """One row: slope, its clustered variance, and the pieces of R squared.

    Two aggregates: one over rows (per cluster, map-side combined), one over the
    cluster moments. The fitted line enters the second as a scalar subquery.
    """
    moments = _cluster_moments(df, x, y, cluster)
    n, sx, sy, sxx, sxy = (F.sum(c) for c in ("n", "sx", "sy", "sxx", "sxy"))
    beta = (sxy - sx * sy / n) / (sxx - sx * sx / n)
    # The subquery names every moment, so that it and the main plan need the same
    # columns and share one exchange of the cluster moments.
    line = moments.agg(
        F.struct(
            beta.alias("b"), ((sy - beta * sx) / n).alias("a"), F.sum("syy").alias("syy")
        ).alias("line")
    )
    scored = moments.withColumn("line", line.scalar())
    a, b = F.col("line.a"), F.col("line.b")
    scored = scored.withColumns(
        {
            "s0": F.col("sy") - a * F.col("n") - b * F.col("sx"),
            "s1": F.col("sxy") - a * F.col("sx") - b * F.col("sxx"),
        }
    )
    total = scored.agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy", "syy")],
        F.count(F.lit(1)).alias("n_clusters"),
        F.max("line.b").alias("beta"),
        F.max("line.a").alias("alpha"),
        F.sum(F.col("s0") * F.col("s0")).alias("m00"),
        F.sum(F.col("s0") * F.col("s1")).alias("m01"),
        F.sum(F.col("s1") * F.col("s1")).alias("m11"),
    )
    c = {name: F.col(name) for name in total.columns}
    cx = c["sxx"] - c["sx"] * c["sx"] / c["n"]
    cy = c["syy"] - c["sy"] * c["sy"] / c["n"]
    mean_x = c["sx"] / c["n"]
    # Row of (X'X)^-1 that belongs to the slope is (-mean_x, 1) / cx.
    sandwich = (mean_x * mean_x * c["m00"] - 2.0 * mean_x * c["m01"] + c["m11"]) / (cx * cx)
    g = c["n_clusters"].cast("double")
    correction = g / (g - 1.0) * (c["n"] - 1.0) / (c["n"] - 2.0)
    few = c["n_clusters"] < 2
    message = F.lit(f"need at least 2 distinct values of {list(cluster)} to cluster")
    return total.select(
        F.when(few, F.raise_error(message).cast("double")).otherwise(c["beta"]).alias("beta"),
        c["alpha"].alias("alpha"),
        (correction * sandwich).alias("beta_variance"),
        c["n"].cast("long").alias("n_obs"),
        c["n_clusters"].alias("n_clusters"),
        (c["beta"] * c["beta"] * cx / cy).alias("r_squared"),
    )


def pooled_gradient(
    df: DataFrame, x: str = "weight", y: str = "delta", cluster_by: str = "grp", p_values: bool = True
) -> DataFrame:
    """Pooled slope with one-way clustered standard error (normal p-values)."""
    require_columns(df, [x, y, cluster_by], "panel")
    fit = clustered_slope(df, x, y, [cluster_by])
    fit = fit.withColumn("std_error", F.sqrt("beta_variance")).drop("beta_variance")
    fit = fit.withColumn("t_statistic", F.col("beta") / F.col("std_error")).withColumn(
        "cluster_variable", F.lit(cluster_by)
    )
    return with_normal_p_values(fit) if p_values else fit


def two_way_gradient(
    df: DataFrame, x: str, y: str, cluster_a: str, cluster_b: str, p_values: bool = True
) -> DataFrame:
    """Pooled slope with two-way clustered variance: V_a + V_b - V_ab."""
    parts = [
        clustered_slope(df, x, y, keys).withColumn("sign", F.lit(sign)).withColumn("part", F.lit(part))
        for part, keys, sign in (
            ("a", [cluster_a], 1.0),
            ("b", [cluster_b], 1.0),
            ("ab", [cluster_a, cluster_b], -1.0),
        )
    ]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    fit = stacked.agg(
        F.max("beta").alias("beta"),
        F.sum(F.col("sign") * F.col("beta_variance")).alias("__v"),
        F.max("n_obs").alias("n_obs"),
        F.max(F.when(F.col("part") == "a", F.col("n_clusters"))).alias("n_clusters_a"),
        F.max(F.when(F.col("part") == "b", F.col("n_clusters"))).alias("n_clusters_b"),
        F.max("r_squared").alias("r_squared"),
    )
    fit = fit.withColumn("std_error", F.sqrt("__v")).drop("__v")
    fit = fit.withColumn("t_statistic", F.col("beta") / F.col("std_error"))
    return with_normal_p_values(fit) if p_values else fit


def with_normal_p_values(fit: DataFrame) -> DataFrame:
    """Two-sided normal p-value and the one-sided one for a negative slope."""
    two = two_sided_normal(F.col("t_statistic"))
    return fit.withColumn("p_two_sided", two).withColumn(
        "p_one_sided", one_sided(F.col("p_two_sided"), F.col("t_statistic") < 0)
    )


# ---- per-cell shift test and multiple testing ------------------------------


def shift_test(
    df: DataFrame, cell_keys: Sequence[str], value: str = "delta", cluster_by: str = "grp"
) -> DataFrame:
    """One-sided test per cell that the mean is below zero, clustered by group."""
    per_cluster = (
        df.where(F.col(value).isNotNull())
        .groupBy(*cell_keys, cluster_by)
        .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(value).alias("s"))
    )
    # Clustered variance of a mean: sum over clusters of (s - n * mean)^2, which
    # expands to cluster-level sums, so one more aggregate is enough.
    n, s = F.sum("n"), F.sum("s")
    mean = s / n
    g = F.count(F.lit(1)).cast("double")
    meat = (
        F.sum(F.col("s") * F.col("s"))
        - 2.0 * mean * F.sum(F.col("s") * F.col("n"))
        + mean * mean * F.sum(F.col("n") * F.col("n"))
    )
    fit = per_cluster.groupBy(*cell_keys).agg(
        mean.alias("mean_delta"),
        F.sqrt(F.greatest(meat, F.lit(0.0)) * g / (g - 1.0) * (n - 1.0) / (n - 1.0) / (n * n)).alias("std_error"),
        n.cast("long").alias("n_obs"),
        F.count(F.lit(1)).alias("n_clusters"),
    )
    return fit.withColumn("t_statistic", F.try_divide(F.col("mean_delta"), F.col("std_error")))


def with_shift_p(fit: DataFrame) -> DataFrame:
    """p-value of the lower tail."""
    return fit.withColumn("p_value", normal_cdf_col(F.col("t_statistic")))


def benjamini_hochberg(
    df: DataFrame,
    p_col: str = "p_value",
    by: Sequence[str] = (),
    fdr: float = fv.FALSE_DISCOVERY_RATE,
    effect_col: str | None = None,
    min_effect: float = fv.MIN_EFFECT,
    per_octave: int = 64,
) -> DataFrame:
    """Step-up adjusted p-values, without ordering the whole table in one task.

    Distinct p-values with their counts are cut into order-preserving slices
    (of relative width towards both ends, so crowds near zero and near one are split
    as well). Ranks inside a slice
    plus the counts of the slices before it give the global rank; the running
    minimum from the top is built the same way.
    """
    keys = list(by)
    rows = df.where(F.col(p_col).isNotNull())
    distinct = rows.groupBy(*keys, p_col).agg(F.count(F.lit(1)).alias("__c"))
    low = coarse_bucket(F.col(p_col), per_octave)
    high = 2 * coarse_bucket(F.lit(0.5), per_octave) + 1 - coarse_bucket(1.0 - F.col(p_col), per_octave)
    distinct = distinct.withColumn("__slice", F.when(F.col(p_col) <= 0.5, low).when(F.col(p_col) < 1.0, high).otherwise(F.lit(1 << 40)))
    on = [*keys, "__slice"]
    across = Window.partitionBy(*keys).orderBy("__slice")
    per_slice = (
        distinct.groupBy(*on)
        .agg(F.sum("__c").alias("__s"))
        .withColumn("__m", F.sum("__s").over(Window.partitionBy(*keys)))
        .withColumn(
            "__before", F.sum("__s").over(across.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__s")
        )
        .drop("__s")
    )
    upto = Window.partitionBy(*on).orderBy(p_col).rowsBetween(Window.unboundedPreceding, 0)
    ranked = join_null_safe(distinct, per_slice, on).withColumn(
        "__raw", F.col(p_col) * F.col("__m") / (F.col("__before") + F.sum("__c").over(upto))
    )
    above = (
        ranked.groupBy(*on)
        .agg(F.min("__raw").alias("__low"))
        .withColumn(
            "__above",
            F.min("__low").over(
                Window.partitionBy(*keys).orderBy(F.desc("__slice")).rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .drop("__low")
    )
    down = Window.partitionBy(*on).orderBy(F.desc(p_col)).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = join_null_safe(ranked, above, on).select(
        *keys,
        p_col,
        F.least(F.lit(1.0), F.coalesce(F.col("__above"), F.lit(1.0)), F.min("__raw").over(down)).alias(
            "p_adjusted"
        ),
    )
    claim = F.col("p_adjusted") < fdr
    if effect_col:
        claim = claim & (F.col(effect_col) < min_effect)
    return join_null_safe(rows, adjusted, [*keys, p_col]).withColumn("claimed", claim)


# ---- general least squares -------------------------------------------------


def moment_cells(df: DataFrame, spec: OlsSpec, by: Sequence[str] = ()) -> DataFrame:
    """Moments per factor combination: the only pass over the raw rows."""
    needed = [*by, spec.outcome, *spec.numeric, *spec.factors]
    require_columns(df, needed, "panel")
    rows = df.dropna(subset=needed)
    y = F.col(spec.outcome).cast("double")
    xs = {x: F.col(x).cast("double") for x in spec.numeric}
    aggregates = [
        F.count(F.lit(1)).cast("double").alias("__n"),
        F.sum(y).alias("__sy"),
        F.sum(y * y).alias("__syy"),
    ]
    names = list(xs)
    for i, a in enumerate(names):
        aggregates += [F.sum(xs[a]).alias(f"__s_{i}"), F.sum(xs[a] * y).alias(f"__sy_{i}")]
        aggregates += [F.sum(xs[a] * xs[names[j]]).alias(f"__s_{i}_{j}") for j in range(i + 1)]
    return rows.groupBy(*by, *spec.factors).agg(*aggregates)


def _terms(spec: OlsSpec) -> list[tuple[Column, int | None]]:
    """Term name and index of its numeric regressor (None: the term is 0/1)."""
    terms: list[tuple[Column, int | None]] = [(F.lit(INTERCEPT), None)]
    terms += [
        (F.concat(F.lit(f"{f}="), F.col(f).cast("string")), None) for f in spec.factors
    ]
    terms += [(F.lit(x), i) for i, x in enumerate(spec.numeric)]
    return terms


def gram_from_cells(cells: DataFrame, spec: OlsSpec, by: Sequence[str] = ()) -> DataFrame:
    """Tidy Gram matrix ``(by, i, j, value)`` over all terms and the outcome.

    A row has one term per factor, so it emits a fixed handful of pairs no matter
    how many levels exist; the pairs are summed map-side.
    """
    terms = _terms(spec)

    def moment(a: int | None, b: int | None) -> Column:
        if a is None and b is None:
            return F.col("__n")
        if a is None or b is None:
            return F.col(f"__s_{b if a is None else a}")
        return F.col(f"__s_{max(a, b)}_{min(a, b)}")

    pairs = [
        F.struct(ti.alias("i"), tj.alias("j"), moment(xi, xj).alias("value"))
        for ti, xi in terms
        for tj, xj in terms
    ]
    for ti, xi in terms:
        v = F.col("__sy") if xi is None else F.col(f"__sy_{xi}")
        pairs.append(F.struct(ti.alias("i"), F.lit(OUTCOME).alias("j"), v.alias("value")))
    pairs.append(
        F.struct(F.lit(OUTCOME).alias("i"), F.lit(OUTCOME).alias("j"), F.col("__syy").alias("value"))
    )
    return (
        cells.select(*by, F.inline(F.array(*pairs)))
        .groupBy(*by, "i", "j")
        .agg(F.sum("value").alias("value"))
    )


def gram_matrix(df: DataFrame, spec: OlsSpec, by: Sequence[str] = ()) -> DataFrame:
    return gram_from_cells(moment_cells(df, spec, by), spec, by)


@dataclass
class Reduced:
    """A Gram matrix of bounded size, and what was absorbed to get there."""

    gram: DataFrame
    spec: OlsSpec  # of the terms that are left
    cells: DataFrame | None = None
    absorbed: Absorbed | None = None

    @property
    def rank(self) -> int:
        return self.absorbed.rank if self.absorbed else 0


def _moment_columns(cells: DataFrame, spec: OlsSpec) -> DataFrame:
    """``cell, column, value``: sums per cell of every term but the intercept, and of the outcome."""
    entries = [F.struct(F.concat(F.lit(f"{f}="), F.col(f"`{f}`").cast("string")).alias("column"), F.col("__n").alias("value")) for f in spec.factors]
    entries += [F.struct(F.lit(x).alias("column"), F.col(f"__s_{i}").alias("value")) for i, x in enumerate(spec.numeric)]
    entries.append(F.struct(F.lit(OUTCOME).alias("column"), F.col("__sy").alias("value")))
    return cells.select("cell", F.inline(F.array(*entries)))


def reduced_gram(df: DataFrame, spec: OlsSpec, keep: Sequence[str] = (), dense_terms: int | None = None) -> Reduced:
    """The model's Gram matrix; the largest factors outside ``keep`` are absorbed where it would be too large."""
    limit = DENSE_TERMS if dense_terms is None else dense_terms
    cells = moment_cells(df, spec)
    if not spec.factors:
        return Reduced(gram_from_cells(cells, spec), spec)
    cells = materialise(cells, "cells")
    sizes = cells.agg(*[F.count_distinct(f"`{f}`").alias(f"n_{i}") for i, f in enumerate(spec.factors)]).first()
    levels = dict(zip(spec.factors, sizes))
    taken: list[str] = []
    for f in sorted(set(spec.factors) - set(keep), key=lambda f: (-levels[f], f)):
        if 1 + len(spec.numeric) + sum(levels[g] for g in spec.factors if g not in taken) <= limit:
            break
        taken.append(f)
    if not taken:
        return Reduced(gram_from_cells(cells, spec), spec, cells)
    cells = materialise(cells.withColumn("cell", F.monotonically_increasing_id()), "cells")
    rest = OlsSpec(spec.outcome, spec.numeric, tuple(f for f in spec.factors if f not in taken), spec.reference)
    absorbed = absorb(cells.withColumnRenamed("__n", "n"), taken, materialise(_moment_columns(cells, rest), "columns"))
    gram = materialise(gram_from_cells(cells, rest), "gram")
    # Levels that never meet have no entry in the matrix, but a product of their residuals.
    out = absorbed.explained().where((F.col("i") != OUTCOME) | (F.col("j") == OUTCOME)).withColumnRenamed("value", "out")
    net = gram.join(out, ["i", "j"], "full").select(
        "i", "j", (F.coalesce("value", F.lit(0.0)) - F.coalesce("out", F.lit(0.0))).alias("value")
    )
    total = gram.where("i = j").select(F.lit(TOTAL).alias("i"), "j", "value")
    return Reduced(net.unionByName(total), rest, cells, absorbed)


def _select_terms(all_terms: list[str], spec: OlsSpec) -> list[str]:
    chosen = [INTERCEPT, *[x for x in spec.numeric]]
    for f in spec.factors:
        levels = sorted(t for t in all_terms if t.startswith(f"{f}="))
        base = f"{f}={spec.reference[f]}" if f in spec.reference else (levels[0] if levels else None)
        chosen += [t for t in levels if t != base] if len(levels) > 1 else []
    return chosen


def _solve(gram: pd.DataFrame, spec: OlsSpec, meat: pd.DataFrame | None, absorbed_rank: int = 0):
    """Coefficients, covariance and fit statistics from tidy matrices.

    With absorbed factors the matrix holds residuals; the intercept is among what was
    absorbed, and a column of which they leave nothing but rounding is a zero column.
    """
    totals = gram[gram["i"] == TOTAL].set_index("j")["value"]
    table = gram[gram["i"] != TOTAL].pivot(index="i", columns="j", values="value").fillna(0.0)
    terms = _select_terms(list(table.index), spec)
    if absorbed_rank:
        terms = terms[1:]
        gone = [t for t in terms if table.loc[t, t] <= 1e-10 * totals[t]]
        table.loc[gone, :] = 0.0
        table.loc[:, gone] = 0.0
    xtx = table.loc[terms, terms].to_numpy(dtype=float)
    xty = table.loc[terms, OUTCOME].to_numpy(dtype=float)
    yty = float(table.loc[OUTCOME, OUTCOME])
    n = float(table.loc[INTERCEPT, INTERCEPT])
    sum_y = float(table.loc[INTERCEPT, OUTCOME])
    scale = np.sqrt(np.where(np.diag(xtx) > 0, np.diag(xtx), 1.0))
    inverse = np.linalg.pinv(xtx / np.outer(scale, scale), rcond=1e-12, hermitian=True) / np.outer(scale, scale) if terms else xtx
    rank = absorbed_rank + (int(np.linalg.matrix_rank(xtx / np.outer(scale, scale), tol=1e-10, hermitian=True)) if terms else 0)
    beta = inverse @ xty
    rss = max(yty - float(beta @ xty), 0.0)
    tss = (float(totals[OUTCOME]) if absorbed_rank else yty) - sum_y * sum_y / n
    df_resid = n - rank
    if meat is None:
        cov = inverse * (rss / df_resid if df_resid > 0 else np.nan)
    else:
        m = meat.pivot(index="i", columns="j", values="value").reindex(index=terms, columns=terms).fillna(0.0)
        cov = inverse @ m.to_numpy(dtype=float) @ inverse * (n / df_resid)
    fit = {
        "n_obs": int(n),
        "df_resid": df_resid,
        "rank": rank,
        "rss": rss,
        "r_squared": 1.0 - rss / tss if tss > 0 else float("nan"),
    }
    return terms, beta, cov, fit


COEFFICIENT_SCHEMA = (
    "term string, estimate double, std_error double, t_statistic double, p_two_sided double, "
    "n_obs long, df_resid double, n_rank int, rss double, r_squared double"
)


def _one_model(gram: DataFrame, by: Sequence[str], func, schema: str) -> DataFrame:
    """Apply ``func`` to the (small) Gram matrix of each model."""
    by_schema = "".join(
        f"`{f.name}` {f.dataType.simpleString()}, " for f in gram.schema.fields if f.name in by
    )
    keyed = gram if by else gram.withColumn("__one", F.lit(1))
    keys = list(by) or ["__one"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = func(pdf)
        for name, value in zip(by, key):
            out[name] = value
        return out

    return keyed.groupBy(*keys).applyInPandas(run, by_schema + schema)


def _coefficients(pdf: pd.DataFrame, spec: OlsSpec, robust: bool, absorbed_rank: int = 0) -> pd.DataFrame:
    gram = pdf[pdf["part"] == "gram"] if "part" in pdf else pdf
    meat = pdf[pdf["part"] == "meat"] if robust else None
    terms, beta, cov, fit = _solve(gram, spec, meat, absorbed_rank)
    se = np.sqrt(np.clip(np.diag(cov), 0, None))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = beta / se
    if robust:
        p = 2.0 * normal_cdf(-np.abs(t))
    else:
        p = 2.0 * t_cdf(-np.abs(t), fit["df_resid"])
    return pd.DataFrame(
        {
            "term": terms,
            "estimate": beta,
            "std_error": se,
            "t_statistic": t,
            "p_two_sided": p,
            "n_obs": fit["n_obs"],
            "df_resid": fit["df_resid"],
            "n_rank": fit["rank"],
            "rss": fit["rss"],
            "r_squared": fit["r_squared"],
        }
    )


def fit_ols(df: DataFrame, spec: OlsSpec, by: Sequence[str] = (), dense_terms: int | None = None) -> DataFrame:
    """Coefficient table with classical errors and t p-values; absorbed factors are not listed.

    Models per group (``by``) are small ones: each is solved densely in a task.
    """
    if by:
        return _one_model(gram_matrix(df, spec, by), by, lambda pdf: _coefficients(pdf, spec, False), COEFFICIENT_SCHEMA)
    reduced = reduced_gram(df, spec, (), dense_terms)
    rest, rank = reduced.spec, reduced.rank
    return _one_model(reduced.gram, (), lambda pdf: _coefficients(pdf, rest, False, rank), COEFFICIENT_SCHEMA)


def _fit_row(reduced: Reduced) -> DataFrame:
    """``n_obs, rank, rss, r_squared`` of a reduced model, one row."""
    rest, rank = reduced.spec, reduced.rank

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, _, fit = _solve(pdf, rest, None, rank)
        return pd.DataFrame({k: [fit[k]] for k in ("n_obs", "rank", "rss", "r_squared")})

    return _one_model(reduced.gram, (), run, "n_obs long, rank int, rss double, r_squared double")


def joint_f_test(df: DataFrame, spec: OlsSpec, factor: str, by: Sequence[str] = (), dense_terms: int | None = None) -> DataFrame:
    """F statistic for all dummies of one factor being zero.

    A model with absorbed factors is compared with the one without the factor: the two
    residual sums give the same statistic.
    """
    schema = (
        "factor string, f_statistic double, p_value double, df_num int, df_den double, n_obs long, r_squared double"
    )
    reduced = None if by else reduced_gram(df, spec, (), dense_terms)
    if reduced is not None and reduced.absorbed:
        rows = df.dropna(subset=[spec.outcome, *spec.numeric, *spec.factors])
        without = OlsSpec(spec.outcome, spec.numeric, tuple(f for f in spec.factors if f != factor), spec.reference)
        small = _fit_row(reduced_gram(rows, without, (), dense_terms))
        both = _fit_row(reduced).crossJoin(small.select(F.col("rank").alias("rank0"), F.col("rss").alias("rss0")))  # one row each

        def compare(batches):
            for pdf in batches:
                q, den = pdf["rank"] - pdf["rank0"], (pdf["n_obs"] - pdf["rank"]).astype(float)
                if (q < 1).any():
                    raise ValueError(f"{factor} needs at least 2 levels")
                stat = ((pdf["rss0"] - pdf["rss"]) / q) / (pdf["rss"] / den)
                yield pd.DataFrame({
                    "factor": factor, "f_statistic": stat, "p_value": f_sf(stat.to_numpy(), q.to_numpy(float), den.to_numpy()), "df_num": q,
                    "df_den": den, "n_obs": pdf["n_obs"], "r_squared": pdf["r_squared"],
                })

        return both.mapInPandas(compare, schema)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        terms, beta, cov, fit = _solve(pdf, spec, None)
        pick = [i for i, t in enumerate(terms) if t.startswith(f"{factor}=")]
        if not pick:
            raise ValueError(f"{factor} needs at least 2 levels")
        b, v = beta[pick], cov[np.ix_(pick, pick)]
        q = int(np.linalg.matrix_rank(v, hermitian=True))
        stat = float(b @ np.linalg.pinv(v, hermitian=True) @ b) / q if q else float("nan")
        return pd.DataFrame(
            {
                "factor": [factor],
                "f_statistic": stat,
                "p_value": f_sf(stat, q, fit["df_resid"]),
                "df_num": q,
                "df_den": fit["df_resid"],
                "n_obs": fit["n_obs"],
                "r_squared": fit["r_squared"],
            }
        )

    return _one_model(gram_matrix(df, spec, by) if by else reduced.gram, by, test, schema)


def fixed_effects_test(df: DataFrame, outcome: str = "index_value") -> DataFrame:
    """Language effects after model and country effects: joint F on the languages."""
    return joint_f_test(df, OlsSpec(outcome, (), ("language", "model", "country")), "language")


def scaling_test(
    df: DataFrame,
    outcome: str = "index_value",
    size_col: str = "log_parameters",
    extra: Sequence[str] = ("debias_explicit",),
    family_col: str = "architecture_family",
) -> DataFrame:
    """Slope on log size with optional indicator and family effects; lower-tail t p-value."""
    require_columns(df, [outcome, size_col, family_col], "model panel")
    numeric = (size_col, *[c for c in extra if c in df.columns])
    fit = fit_ols(df, OlsSpec(outcome, numeric, (family_col,)))
    few = F.col("n_obs") < 4
    return (
        fit.where(F.col("term") == size_col)
        # In a filter, so that the check stays whichever columns are read.
        .where(F.when(few, F.raise_error(F.lit("at least 4 observations are needed")).cast("boolean")).otherwise(F.lit(True)))
        .withColumn("p_one_sided", t_cdf_col(F.col("t_statistic"), F.col("df_resid")))
    )


def outcome_share(df: DataFrame, labels: Sequence[str] = fv.OUTCOME_LABELS, name: str = "outcome") -> DataFrame:
    """Row sum of label columns; the query fails if a sum leaves [0, 1]."""
    require_columns(df, labels, "image panel")
    total = sum((F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in labels), F.lit(0.0))
    message = F.lit("label sums outside [0, 1]: the columns must hold probabilities")
    return df.withColumn(
        name, F.when(total.between(0.0, 1.0), total).otherwise(F.raise_error(message).cast("double"))
    )


def robust_cells(df: DataFrame, spec: OlsSpec, cells: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Moment cells of a factor-only model and the cells weighted by squared residuals.

    All rows of a factor combination share one prediction, so the residual sum of
    squares of a cell follows from its moments: no second pass over the rows.
    """
    if spec.numeric:
        raise ValueError("robust_cells handles factor-only models")
    cells = moment_cells(df, spec) if cells is None else cells
    fit = _one_model(
        gram_from_cells(cells, spec), (), lambda pdf: _coefficients(pdf, spec, False), COEFFICIENT_SCHEMA
    )
    lookup = fit.agg(F.map_from_entries(F.collect_list(F.struct("term", "estimate"))).alias("m"))
    scored = cells.withColumn("__coef", lookup.scalar())
    pred = F.try_element_at("__coef", F.lit(INTERCEPT))
    for f in spec.factors:
        term = F.concat(F.lit(f"{f}="), F.col(f).cast("string"))
        pred = pred + F.coalesce(F.try_element_at("__coef", term), F.lit(0.0))
    sse = F.col("__syy") - 2.0 * pred * F.col("__sy") + pred * pred * F.col("__n")
    weighted = scored.withColumn("__n", F.greatest(sse, F.lit(0.0))).drop("__coef")
    return cells, weighted


def _robust_gram(df: DataFrame, spec: OlsSpec, keep: Sequence[str] = (), dense_terms: int | None = None) -> tuple[DataFrame, OlsSpec, int]:
    """Gram matrix and meat in one tidy table, the terms they are about, and the rank of what was absorbed."""
    reduced = reduced_gram(df, spec, keep, dense_terms)
    if reduced.absorbed:
        meat = _absorbed_meat(reduced)
    else:
        _, weighted = robust_cells(df, spec, reduced.cells)
        meat = gram_from_cells(weighted, spec).where((F.col("i") != OUTCOME) & (F.col("j") != OUTCOME))
    both = reduced.gram.withColumn("part", F.lit("gram")).unionByName(meat.withColumn("part", F.lit("meat")))
    return both, reduced.spec, reduced.rank


def _absorbed_meat(reduced: Reduced) -> DataFrame:
    """Products of the terms' residuals weighted with squared residuals of the outcome, per cell.

    All rows of a cell share one prediction and one residual of each term.
    """
    if reduced.spec.numeric:
        raise ValueError("robust errors are for factor-only models")
    rest, rank = reduced.spec, reduced.rank
    fit = _one_model(reduced.gram, (), lambda pdf: _coefficients(pdf, rest, False, rank), COEFFICIENT_SCHEMA)
    coefficients = fit.select(F.col("term").alias("column"), F.col("estimate"))
    own = _moment_columns(reduced.cells, rest).where(F.col("column") != OUTCOME).select("cell", "column", F.lit(1.0).alias("own"))
    fitted = materialise(reduced.absorbed.fitted(), "fitted")
    net = own.join(fitted.where(F.col("column") != OUTCOME), ["cell", "column"], "full")
    net = net.select("cell", "column", (F.coalesce("own", F.lit(0.0)) - F.coalesce("value", F.lit(0.0))).alias("d"))
    net = materialise(net.join(coefficients, "column"), "net")
    part = net.groupBy("cell").agg(F.sum(F.col("d") * F.col("estimate")).alias("part"))
    base = fitted.where(F.col("column") == OUTCOME).select("cell", F.col("value").alias("base"))
    cells = reduced.cells.join(base, "cell", "left").join(part, "cell", "left")
    guess = F.coalesce("base", F.lit(0.0)) + F.coalesce("part", F.lit(0.0))
    sse = F.col("__syy") - 2.0 * guess * F.col("__sy") + guess * guess * F.col("__n")
    weights = cells.select("cell", F.greatest(sse, F.lit(0.0)).alias("sse"))
    left = net.select("cell", F.col("column").alias("i"), F.col("d").alias("di")).join(weights, "cell")
    right = net.select("cell", F.col("column").alias("j"), F.col("d").alias("dj"))
    return left.join(right, "cell").groupBy("i", "j").agg(F.sum(F.col("sse") * F.col("di") * F.col("dj")).alias("value"))


def fit_robust(df: DataFrame, spec: OlsSpec, dense_terms: int | None = None) -> DataFrame:
    """Coefficient table of a factor-only model with HC1 errors (normal p-values)."""
    gram, rest, rank = _robust_gram(df, spec, (), dense_terms)
    return _one_model(gram, (), lambda pdf: _coefficients(pdf, rest, True, rank), COEFFICIENT_SCHEMA)


def marker_contrast(
    df: DataFrame,
    outcome: str = "outcome",
    marker_col: str = "marker",
    factors: Sequence[str] = ("occupation", "model"),
    reference: str = "unmarked",
    treated: str = "LatAm",
    control: str = "US",
    dense_terms: int | None = None,
) -> DataFrame:
    """Difference of two marker effects with HC1 error and one-sided p-value."""
    require_columns(df, [outcome, marker_col, *factors], "image panel")
    spec = OlsSpec(outcome, (), (marker_col, *factors), {marker_col: reference})

    gram, rest, rank = _robust_gram(df, spec, (marker_col,), dense_terms)

    def contrast(pdf: pd.DataFrame) -> pd.DataFrame:
        terms, beta, cov, fit = _solve(pdf[pdf["part"] == "gram"], rest, pdf[pdf["part"] == "meat"], rank)
        c = np.zeros(len(terms))
        for level, sign in ((treated, 1.0), (control, -1.0)):
            if level == reference:
                continue
            term = f"{marker_col}={level}"
            if term not in terms:
                raise KeyError(f"no fitted coefficient for marker {level!r}")
            c[terms.index(term)] = sign
        diff = float(c @ beta)
        se = float(np.sqrt(max(c @ cov @ c, 0.0)))
        z = diff / se if se > 0 else float("nan")
        return pd.DataFrame(
            {
                "diff": [diff],
                "std_error": se,
                "p_one_sided": normal_cdf(-z),
                "n_obs": fit["n_obs"],
                "r_squared": fit["r_squared"],
            }
        )

    schema = "diff double, std_error double, p_one_sided double, n_obs long, r_squared double"
    return _one_model(gram, (), contrast, schema)
