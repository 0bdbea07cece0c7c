"""Regressions, tests, agreement, quantiles against NumPy and plain Python."""

import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ordscope.fixed_values import OUTCOME_LABELS
from ordscope.functions.probability import f_sf, normal_cdf, t_cdf
from ordscope.operators import agreement, quantiles, regression, sampling
from ordscope.plans import estimation
from ordscope.session import materialise


def design(pdf, numeric=(), factors=(), reference=None):
    """Dense treatment-coded design matrix, for comparison only."""
    cols, names = [np.ones(len(pdf))], ["Intercept"]
    for x in numeric:
        cols.append(pdf[x].to_numpy(float))
        names.append(x)
    for f in factors:
        levels = sorted(pdf[f].astype(str).unique())
        base = (reference or {}).get(f, levels[0])
        for level in levels if len(levels) > 1 else []:
            if level != base:
                cols.append((pdf[f].astype(str) == level).to_numpy(float))
                names.append(f"{f}={level}")
    return np.column_stack(cols), names


def gradient_panel():
    rng = np.random.default_rng(3)
    rows = []
    for g in range(25):
        w, shock = (g + 1) / 325, rng.normal(0, 0.3)
        for m in range(4):
            rows.append((f"g{g}", f"m{m}", w, -0.5 - 2.0 * w + shock + rng.normal(0, 0.4)))
    return pd.DataFrame(rows, columns=["grp", "model", "weight", "delta"])


def sandwich(x, e, groups):
    bread = np.linalg.inv(x.T @ x)
    scores = pd.DataFrame(x * e[:, None]).groupby(groups).sum().to_numpy()
    g, (n, k) = len(scores), x.shape
    return g / (g - 1) * (n - 1) / (n - k) * bread @ (scores.T @ scores) @ bread


def test_pooled_gradient(spark):
    pdf = gradient_panel()
    x, _ = design(pdf, ["weight"])
    y = pdf["delta"].to_numpy()
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    se = math.sqrt(sandwich(x, y - x @ beta, pdf["grp"].to_numpy())[1, 1])
    got = regression.pooled_gradient(spark.createDataFrame(pdf)).first()
    assert (got.beta, got.std_error, got.n_obs, got.n_clusters) == (
        pytest.approx(beta[1]), pytest.approx(se), 100, 25,
    )
    assert got.p_two_sided == pytest.approx(2 * normal_cdf(-abs(beta[1] / se)))
    assert got.p_one_sided == pytest.approx(normal_cdf(beta[1] / se))
    with pytest.raises(PySparkException):
        regression.pooled_gradient(spark.createDataFrame(pdf.assign(grp="one"))).collect()
    with pytest.raises(KeyError):
        regression.pooled_gradient(spark.createDataFrame(pdf), cluster_by="nope")


def test_two_way_gradient(spark):
    pdf = gradient_panel()
    x, _ = design(pdf, ["weight"])
    y = pdf["delta"].to_numpy()
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    both = (pdf["grp"] + "|" + pdf["model"]).to_numpy()
    v = sandwich(x, e, pdf["grp"].to_numpy()) + sandwich(x, e, pdf["model"].to_numpy()) - sandwich(x, e, both)
    got = regression.two_way_gradient(spark.createDataFrame(pdf), "weight", "delta", "grp", "model").first()
    assert got.std_error == pytest.approx(math.sqrt(v[1, 1]), rel=1e-8)


def test_gradient_by_cell_and_degenerate(spark):
    pdf = gradient_panel()
    got = estimation.cell_gradients(spark.createDataFrame(pdf), ["model"]).collect()
    for row in got:
        cell = pdf[pdf["model"] == row.model]
        b, a = np.polyfit(cell["weight"], cell["delta"], 1)
        resid = cell["delta"] - a - b * cell["weight"]
        assert (row.alpha, row.beta, row.sigma) == (
            pytest.approx(a), pytest.approx(b), pytest.approx(resid.std(ddof=0)),
        )
    with pytest.raises(PySparkException):
        regression.fit_gradient(spark.createDataFrame(pdf.assign(weight=1.0))).collect()


def effects_panel(effect):
    rng = np.random.default_rng(5)
    return pd.DataFrame(
        [
            (f"c{c}", f"l{l}", f"m{m}", -0.5 + 0.2 * c + 0.3 * m + l * effect + rng.normal(0, 0.1))
            for c in range(4) for l in range(4) for m in range(4) if (c, l, m) != (1, 2, 3)
        ],
        columns=["country", "language", "model", "index_value"],
    )


def test_fixed_effects(spark):
    pdf = effects_panel(0.3)
    x, names = design(pdf, (), ["language", "model", "country"])
    y = pdf["index_value"].to_numpy()
    rss1 = np.sum((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2)
    x0, _ = design(pdf, (), ["model", "country"])
    rss0 = np.sum((y - x0 @ np.linalg.lstsq(x0, y, rcond=None)[0]) ** 2)
    df = len(y) - x.shape[1]
    stat = (rss0 - rss1) / 3 / (rss1 / df)
    got = regression.fixed_effects_test(spark.createDataFrame(pdf)).first()
    assert (got.f_statistic, got.df_num, got.df_den) == (pytest.approx(stat), 3, df)
    assert got.p_value == pytest.approx(f_sf(stat, 3, df)) and got.p_value < 0.01
    null = regression.fixed_effects_test(spark.createDataFrame(effects_panel(0.0))).first()
    assert null.p_value > 0.01
    with pytest.raises(PySparkException):
        regression.fixed_effects_test(spark.createDataFrame(pdf.assign(language="en"))).collect()


def test_collinear_factors_use_pseudo_inverse(spark):
    pdf = effects_panel(0.3)
    pdf["nested"] = pdf["country"].str.replace("c", "n")
    spec = regression.OlsSpec("index_value", (), ("country", "nested"))
    got = regression.fit_ols(spark.createDataFrame(pdf), spec).collect()
    x, _ = design(pdf, (), ["country"])
    y = pdf["index_value"].to_numpy()
    rss = np.sum((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2)
    assert got[0].n_rank == 4 and got[0].rss == pytest.approx(rss)


def test_scaling(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame(
        {
            "log_parameters": rng.uniform(18, 24, 40),
            "debias_explicit": rng.integers(0, 2, 40).astype(float),
            "architecture_family": rng.choice(["A", "B", "C"], 40),
        }
    )
    pdf["index_value"] = 1 - 0.4 * pdf["log_parameters"] + rng.normal(0, 0.5, 40)
    x, names = design(pdf, ["log_parameters", "debias_explicit"], ["architecture_family"])
    y = pdf["index_value"].to_numpy()
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    s2 = np.sum((y - x @ b) ** 2) / (len(y) - x.shape[1])
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * s2)
    got = regression.scaling_test(spark.createDataFrame(pdf)).first()
    assert (got.estimate, got.std_error) == (pytest.approx(b[1]), pytest.approx(se[1]))
    assert got.p_one_sided == pytest.approx(t_cdf(b[1] / se[1], len(y) - x.shape[1]))
    with pytest.raises(PySparkException):
        regression.scaling_test(spark.createDataFrame(pdf.head(3))).collect()


def marker_panel(lift=0.2):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(360):
        marker = ["unmarked", "LatAm", "US"][i % 3]
        p = rng.dirichlet([1, 1, 1, 6]) * (1 - lift)
        extra = lift if marker == "LatAm" else 0.0
        rows.append((f"i{i}", marker, f"o{rng.integers(4)}", f"m{rng.integers(2)}", p[0] + extra, p[1], p[2]))
    return pd.DataFrame(rows, columns=["image_id", "marker", "occupation", "model", *OUTCOME_LABELS])


def test_marker_contrast_hc1(spark):
    pdf = marker_panel()
    pdf["outcome"] = pdf[list(OUTCOME_LABELS)].sum(axis=1)
    x, names = design(pdf, (), ["marker", "occupation", "model"], {"marker": "unmarked"})
    y = pdf["outcome"].to_numpy()
    bread = np.linalg.inv(x.T @ x)
    b = bread @ x.T @ y
    e = y - x @ b
    v = len(y) / (len(y) - x.shape[1]) * bread @ (x.T * e**2) @ x @ bread
    c = np.zeros(len(names))
    c[names.index("marker=LatAm")], c[names.index("marker=US")] = 1, -1
    frame = regression.outcome_share(spark.createDataFrame(pdf.drop(columns="outcome")))
    got = regression.marker_contrast(frame).first()
    assert got["diff"] == pytest.approx(c @ b)
    assert got.std_error == pytest.approx(math.sqrt(c @ v @ c))
    assert got.p_one_sided == pytest.approx(normal_cdf(-(c @ b) / got.std_error), abs=1e-12)
    table = regression.fit_robust(
        frame, regression.OlsSpec("outcome", (), ("marker", "occupation", "model"), {"marker": "unmarked"})
    )
    assert {r.term: r.std_error for r in table.collect()} == {
        n: pytest.approx(s) for n, s in zip(names, np.sqrt(np.diag(v)))
    }
    with pytest.raises(PySparkException):
        regression.outcome_share(frame.drop("outcome").withColumn(OUTCOME_LABELS[0], F.lit(1.5))).collect()
    with pytest.raises(KeyError):
        regression.outcome_share(frame.drop(OUTCOME_LABELS[1]))


def test_benjamini_hochberg(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.uniform(0, 1, 60), rng.uniform(0, 1e-4, 25), [0.0, 0.0, 0.03, 0.03, 1.0]])
    order = np.argsort(p)
    raw = p[order] * len(p) / np.arange(1, len(p) + 1)
    adjusted = np.empty(len(p))
    adjusted[order] = np.minimum.accumulate(raw[::-1])[::-1].clip(max=1)
    df = spark.createDataFrame([(i, float(v), -1.0) for i, v in enumerate(p)], "i int, p_value double, d double")
    got = {r.i: r for r in regression.benjamini_hochberg(df, effect_col="d").collect()}
    assert len(got) == len(p)
    for i, want in enumerate(adjusted):
        assert got[i].p_adjusted == pytest.approx(want)
        assert got[i].claimed == (want < 0.05)


def test_directional_claims(spark):
    rng = np.random.default_rng(2)
    rows = [(f"m{m}", f"g{g}", float((-1.5 if m == 0 else 0.0) + rng.normal(0, 0.3))) for m in range(4) for g in range(25)]
    df = spark.createDataFrame(rows, "model string, grp string, delta double")
    got = {r.model: r for r in estimation.directional_claims(df, ["model"]).collect()}
    assert got["m0"].claimed and not any(got[f"m{m}"].claimed for m in (1, 2, 3))
    values = [d for m, _, d in rows if m == "m1"]
    assert got["m1"].std_error == pytest.approx(statistics.stdev(values) / 5)


# ---- quantiles ------------------------------------------------------------------------


@pytest.mark.parametrize("sort_rows", [1 << 16, 20])
def test_exact_quantiles_match_numpy(spark, sort_rows):
    """With one pass, and with passes until a prefix holds 40 rows, or one."""
    rng = np.random.default_rng(4)
    groups = {
        "crowd": 1.0 + rng.permutation(300) * 2.0**-50,
        "zeros": np.array([0.0, -0.0, 0.0, -1e-300, 1e-300]),
        "wide": rng.lognormal(0, 6, 501),
        "neg": rng.normal(0, 5, 400).round(2),
        "const": np.full(33, 7.25),
        "one": np.array([3.5]),
        "two": np.array([1.0, 2.0]),
        "hot": np.concatenate([np.full(900, 1.0), rng.uniform(0, 2, 101)]),
        None: rng.uniform(-1, 1, 50),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("wide", None), ("wide", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = {"q05": 0.05, "q50": 0.5, "q95": 0.95, "x95": (0.95, True)}
    got = {r.g: r for r in quantiles.exact_quantiles(df, ["g"], "v", qs, sort_rows).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        want = np.percentile(vs, [5, 50, 95])
        assert [got[g].q05, got[g].q50, got[g].q95] == pytest.approx(list(want))
        assert got[g].n == len(vs)
        if len(vs) >= 20:
            assert got[g].x95 == pytest.approx(statistics.quantiles(list(vs), n=20)[-1])
    overall = quantiles.exact_quantiles(df, [], "v", {"m": 0.5}, sort_rows).first()
    assert overall.m == pytest.approx(np.median(np.concatenate(list(groups.values()))))


# ---- agreement and sampling --------------------------------------------------------------


def kappa(pairs, linear=True):
    labels = sorted({x for p in pairs for x in p})
    n = len(pairs)
    w = lambda a, b: abs(labels.index(a) - labels.index(b)) if linear else int(a != b)
    obs = sum(w(a, b) for a, b in pairs)
    exp = sum(w(a, d) for a, _ in pairs for _, d in pairs) / n
    return 1 - obs / exp


@pytest.mark.parametrize("linear", [True, False])
def test_kappa_brute_force(spark, linear):
    rng = np.random.default_rng(8)
    a = rng.choice([1, 2, 5, 9, 11], 200)
    b = np.where(rng.uniform(size=200) < 0.6, a, rng.choice([1, 3, 5, 11], 200))
    pairs = list(zip(a.tolist(), b.tolist()))
    df = spark.createDataFrame(pairs + [(None, 3), (4, None)], "a int, b int")
    got = agreement.cohens_kappa(df, "a", "b", weights="linear" if linear else None).first()
    assert got.value == pytest.approx(kappa(pairs, linear)) and got.n == 200


def test_kappa_edges(spark):
    same = spark.createDataFrame([(1, 1), (5, 5), (7, 7)], "a int, b int")
    assert agreement.cohens_kappa(same, "a", "b").first().value == 1.0
    swapped = spark.createDataFrame([(1, 5), (5, 1)] * 3, "a int, b int")
    assert agreement.cohens_kappa(swapped, "a", "b").first().value < 0
    few = agreement.cohens_kappa(spark.createDataFrame([(1, 1), (None, 2)], "a int, b int"), "a", "b").first()
    assert math.isnan(few.value) and few.n == 1 and few.note
    with pytest.raises(ValueError):
        agreement.cohens_kappa(same, "a", "b", weights="quadratic")


def test_stratified_sample(spark):
    rows = [(f"i{i}", "big" if i % 3 else "small", i % 10 != 0) for i in range(300)] + [("x", "tiny", None), ("y", "tiny", True)]
    df = spark.createDataFrame(rows, "image_id string, occupation string, has_face boolean")
    for c in ("language", "model", "country", "path"):
        df = df.withColumn(c, F.lit(c))
    sheet = sampling.sample_for_validation(df, 12)
    got = sheet.collect()
    counts = pd.Series([r.occupation for r in got]).value_counts().to_dict()
    assert counts == {"big": 12, "small": 12, "tiny": 1}
    assert all(r.label_a is None and r.notes == "" for r in got)
    assert {r.image_id for r in sampling.sample_for_validation(df, 12).collect()} == {r.image_id for r in got}
    assert {r.image_id for r in sampling.sample_for_validation(df, 12, seed=1).collect()} != {r.image_id for r in got}
    plan = sheet._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    with pytest.raises(KeyError):
        sampling.sample_for_validation(df.drop("path"))


# ---- factors with many levels ---------------------------------------------------------------


def factor_rows(n, sizes, seed):
    rng = np.random.default_rng(seed)
    cols = [rng.integers(0, k, n) for k in sizes]
    x = rng.normal(size=n) + cols[0] % 3
    y = 0.7 * x + sum(np.sin(c * (i + 1)) for i, c in enumerate(cols)) + rng.normal(size=n)
    return [(float(y[i]), float(x[i]), *[f"v{c[i]}" for c in cols]) for i in range(n)]


SCHEMA = "y double, x double, a string, b string, c string"


@pytest.mark.parametrize("dense_terms", [14, 8, 3])
def test_absorbed_factors_equal_the_dense_fit(spark, dense_terms):
    """One factor absorbed, two, and three; the dense solver sees all 17 terms."""
    df = spark.createDataFrame([*factor_rows(200, (9, 6, 4), 1), (None, 1.0, "v1", "v1", "v1")], SCHEMA)
    spec = regression.OlsSpec("y", ("x",), ("a", "b", "c"))
    want = {r.term: r for r in regression.fit_ols(df, spec).collect()}
    got = {r.term: r for r in regression.fit_ols(df, spec, dense_terms=dense_terms).collect()}
    assert "x" in got and not any(t.startswith("a=") for t in got) and len(got) < len(want)
    for term, r in got.items():
        w = want[term]
        assert (r.n_obs, r.df_resid, r.n_rank) == (w.n_obs, w.df_resid, w.n_rank)
        assert [r.estimate, r.std_error, r.rss, r.r_squared] == pytest.approx([w.estimate, w.std_error, w.rss, w.r_squared], rel=1e-8)
    for factor in ("a",) if dense_terms == 8 else ():
        w = regression.joint_f_test(df, spec, factor).first()
        r = regression.joint_f_test(df, spec, factor, dense_terms=dense_terms).first()
        assert (r.df_num, r.df_den, r.n_obs) == (w.df_num, w.df_den, w.n_obs)
        assert [r.f_statistic, r.p_value] == pytest.approx([w.f_statistic, w.p_value], rel=1e-6)


def test_absorbed_factors_of_separate_components(spark):
    """Levels that never meet: the rank counts the components of the level graph."""
    rows = [(y, x, f"p{a}" if i % 2 else f"q{a}", f"p{b}" if i % 2 else f"q{b}", "one") for i, (y, x, a, b, _) in enumerate(factor_rows(120, (5, 4, 1), 2))]
    df = spark.createDataFrame(rows, SCHEMA)
    spec = regression.OlsSpec("y", ("x",), ("a", "b"))
    w = next(r for r in regression.fit_ols(df, spec).collect() if r.term == "x")
    r = next(r for r in regression.fit_ols(df, spec, dense_terms=3).collect() if r.term == "x")
    assert (r.n_rank, r.df_resid) == (w.n_rank, w.df_resid) and r.estimate == pytest.approx(w.estimate, rel=1e-8)
    assert r.std_error == pytest.approx(w.std_error, rel=1e-8)


@pytest.mark.parametrize("dense_terms", [9, 5])
def test_marker_contrast_with_absorbed_factors(spark, dense_terms):
    rng = np.random.default_rng(3)
    rows = [
        (["LatAm", "US", "unmarked"][i % 3], f"o{rng.integers(0, 6)}", f"m{rng.integers(0, 4)}", float(rng.random() + (i % 3) / 5)) for i in range(500)
    ]
    df = spark.createDataFrame(rows, "marker string, occupation string, model string, outcome double")
    w, r = regression.marker_contrast(df).first(), regression.marker_contrast(df, dense_terms=dense_terms).first()
    assert [r.diff, r.std_error, r.p_one_sided, r.r_squared] == pytest.approx([w.diff, w.std_error, w.p_one_sided, w.r_squared], rel=1e-7)
    assert r.n_obs == w.n_obs


def test_a_hundred_thousand_levels(spark):
    """The slope within 100 000 groups of three rows, against its closed form."""
    n = 300_000
    df = spark.range(n).select(
        (F.col("id") % 100_000).cast("string").alias("a"),
        (F.rand(1) + F.col("id") % 7).alias("x"),
        F.rand(2).alias("e"),
        F.col("id"),
    )
    df = materialise(df.withColumn("y", 2.0 * F.col("x") + F.col("e") + F.col("id") % 100_000), "rows")
    row = regression.fit_ols(df, regression.OlsSpec("y", ("x",), ("a",))).first()
    inside = df.groupBy("a").agg(F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx")).agg(F.sum("xy") / F.sum("xx")).first()[0]
    assert row.term == "x" and row.estimate == pytest.approx(inside, rel=1e-8)
    assert (row.n_rank, row.df_resid) == (100_001, n - 100_001)


def test_adjusted_p_values_of_rows_without_a_group(spark):
    rows = [("g", 0.01), ("g", 0.04), (None, 0.02), (None, 0.03), (None, None)]
    df = spark.createDataFrame(rows, "g string, p_value double")
    got = sorted((r.g or "", r.p_value, round(r.p_adjusted, 12)) for r in regression.benjamini_hochberg(df, by=["g"]).collect())
    assert got == [("", 0.02, 0.03), ("", 0.03, 0.03), ("g", 0.01, 0.02), ("g", 0.04, 0.04)]
