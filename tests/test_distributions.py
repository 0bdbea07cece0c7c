"""Histograms, distances, index."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ordscope.fixed_values import BINS
from ordscope.functions import distances
from ordscope.operators import baselines, bootstrap, distributions, weights
from ordscope.plans import audit
from ordscope.sources.dimensions import groups_dim

K = len(BINS)


def one_hot(b):
    return [1.0 if x == b else 0.0 for x in BINS]


def evaluate(spark, p, q, expr):
    df = spark.createDataFrame([(p, q)], "p array<double>, q array<double>")
    return df.select(expr.alias("v")).first().v


def w1(spark, p, q, validate=True):
    return evaluate(spark, p, q, distances.wasserstein1(F.col("p"), F.col("q"), validate=validate))


@pytest.mark.parametrize(
    "p,q,want",
    [
        (one_hot(4), one_hot(4), 0.0),
        (one_hot(4), one_hot(5), 1.0),
        (one_hot(1), one_hot(11), 10.0),
        ([1 / K] * K, one_hot(6), 30 / 11),
    ],
)
def test_w1_closed_form(spark, p, q, want):
    assert w1(spark, p, q) == pytest.approx(want)
    assert w1(spark, q, p) == pytest.approx(want)


@pytest.mark.parametrize(
    "p", [[0.5] + [0.0] * 10, [1.5, -0.5] + [0.0] * 9, [1.0], [], [float("nan")] + [0.1] * 10]
)
def test_w1_rejects_malformed(spark, p):
    with pytest.raises(PySparkException):
        w1(spark, p, one_hot(3))


def test_w1_unequal_gaps(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0], [0.0, 0.0, 1.0])], "p array<double>, q array<double>")
    v = df.select(distances.wasserstein1(F.col("p"), F.col("q"), (1, 4, 6)).alias("v")).first().v
    assert v == pytest.approx(5.0)


probs = st.lists(st.integers(0, 20), min_size=K, max_size=K).filter(lambda x: sum(x) > 0).map(
    lambda x: [v / sum(x) for v in x]
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(probs, probs, probs), min_size=5, max_size=5))
def test_w1_properties(spark, triples):
    df = spark.createDataFrame(triples, "p array<double>, q array<double>, r array<double>")
    c = {x: F.col(x) for x in "pqr"}
    got = df.select(
        distances.wasserstein1(c["p"], c["q"]).alias("pq"),
        distances.wasserstein1(c["q"], c["p"]).alias("qp"),
        distances.wasserstein1(c["p"], c["r"]).alias("pr"),
        distances.wasserstein1(c["r"], c["q"]).alias("rq"),
        distances.signed_shift(c["p"], c["q"]).alias("shift"),
    ).collect()
    for row in got:
        assert row.pq == pytest.approx(row.qp)
        assert row.pq <= row.pr + row.rq + 1e-9
        assert row.pq >= abs(row["shift"]) - 1e-9


def panel_rows(spark, rows):
    return spark.createDataFrame(
        rows, "country string, language string, model string, grp string, has_signal boolean, bin int"
    )


def two_group_panel(spark, n=30):
    rows = [("CO", "en", "m", "CEO", True, 2)] * n + [("CO", "en", "m", "domestic worker", True, 8)] * n
    return panel_rows(spark, rows)


def two_group_baseline(spark):
    return spark.createDataFrame(
        [("CO", "CEO", one_hot(8), 0.7), ("CO", "domestic worker", one_hot(2), 0.3)],
        "country string, grp string, base_probs array<double>, weight double",
    )


def test_index_closed_form(spark):
    table = audit.group_table(two_group_panel(spark), two_group_baseline(spark))
    rows = {r.grp: r for r in table.collect()}
    assert (rows["CEO"].distance, rows["CEO"].delta) == (6.0, -6.0)
    assert (rows["domestic worker"].distance, rows["domestic worker"].delta) == (6.0, 6.0)
    index = audit.index_by_cell(table).first()
    assert index.index_value == pytest.approx(-2.4)
    assert index.covered_weight == pytest.approx(1.0)


def test_histogram_missing_data_rules(spark):
    rows = [
        ("CO", "en", "m", "all-ineligible", False, 3),
        ("CO", "en", "m", "null-flag", None, 3),
        ("CO", "en", "m", "outside", True, 12),
        ("CO", "en", "m", "mixed", True, 3),
        ("CO", "en", "m", "mixed", True, None),
        ("CO", "en", "m", "mixed", True, 12),
        ("CO", "en", "m", "mixed", False, 5),
        (None, "en", "m", "no-key", True, 5),
    ]
    hist = distributions.ordinal_histogram(panel_rows(spark, rows), [*audit.CELL_KEYS, "grp"])
    got = {r.grp: r for r in hist.collect()}
    for grp in ("all-ineligible", "null-flag", "outside"):
        assert got[grp].is_uniform_fallback
        assert got[grp].probs == pytest.approx([1 / K] * K)
    assert got["mixed"].probs == one_hot(3)
    assert got["mixed"].n_rows == 4
    assert "no-key" not in got
    absent = distributions.ordinal_histogram(panel_rows(spark, rows).drop("bin"), ["grp"])
    assert all(r.is_uniform_fallback for r in absent.collect())
    with pytest.raises(KeyError):
        distributions.ordinal_histogram(panel_rows(spark, rows).drop("grp"), ["grp"])


def test_zero_shift_and_missing_weight(spark):
    base = spark.createDataFrame(
        [("CO", "CEO", one_hot(2), 0.7), ("CO", "domestic worker", one_hot(2), None)],
        "country string, grp string, base_probs array<double>, weight double",
    )
    table = audit.group_table(two_group_panel(spark), base)
    row = table.where("grp = 'CEO'").first()
    assert (row.distance, row.signed_distance) == (0.0, 0.0)
    index = audit.index_by_cell(table).first()
    assert (index.index_value, index.n_missing_weight) == (0.0, 1)


def test_long_and_array_forms_round_trip(spark):
    hist = distributions.ordinal_histogram(two_group_panel(spark), ["country", "grp"])
    long = distributions.to_long(hist, ["country", "grp"])
    assert long.count() == 2 * K
    back = distributions.from_long(long.where("prob > 0"), ["country", "grp"])
    want = {r.grp: r.probs for r in hist.collect()}
    assert {r.grp: r.probs for r in back.collect()} == want


def test_multi_cells_get_one_result_per_country(spark):
    rows = [("MULTI", "en", "m", "CEO", True, 2)] * 5 + [("CO", "es", "m", "CEO", True, 2)] * 5
    base = spark.createDataFrame(
        [("CO", "CEO", one_hot(4), 1.0), ("MX", "CEO", one_hot(7), 1.0)],
        "country string, grp string, base_probs array<double>, weight double",
    )
    table = audit.group_table(panel_rows(spark, rows), base, countries=["CO", "MX"])
    got = {(r.country, r.language): r.delta for r in table.collect()}
    assert got == {("CO", "en"): -2.0, ("MX", "en"): -5.0, ("CO", "es"): -2.0}


def test_poc_golden_numbers(spark):
    """Weights 1/2, 1/3, 1/6 and the published index of the three-group table."""
    w = weights.percentile_rank_weights(
        spark.createDataFrame(
            [("CO", "CEO", 18e6), ("CO", "nurse", 3.2e6), ("CO", "domestic worker", 0.95e6)],
            "country string, grp string, income double",
        )
    )
    by = {r.grp: r.weight for r in w.collect()}
    assert [by["CEO"], by["nurse"], by["domestic worker"]] == pytest.approx([1 / 2, 1 / 3, 1 / 6])
    d = {"CEO": 4.488203472713306, "nurse": 2.1264564501899015, "domestic worker": 1.2153638477274977}
    assert sum(by[g] * d[g] for g in d) == pytest.approx(3.155481, abs=1e-6)


def test_weights_average_ties_and_positive(spark):
    incomes = spark.createDataFrame(
        [("CO", "a", 1.0), ("CO", "b", 1.0), ("CO", "c", 5.0), ("MX", "a", 2.0)],
        "country string, grp string, income double",
    )
    got = {(r.country, r.grp): r.weight for r in weights.percentile_rank_weights(incomes).collect()}
    assert got[("CO", "a")] == got[("CO", "b")] == pytest.approx(0.25)
    assert got[("MX", "a")] == 1.0
    bad = spark.createDataFrame([("CO", "a", 0.0)], "country string, grp string, income double")
    with pytest.raises(PySparkException):
        weights.percentile_rank_weights(bad).collect()


def test_prior_weights_and_baseline(spark):
    w = weights.prior_weights(spark)
    totals = {r.country: r.s for r in w.groupBy("country").agg(F.sum("weight").alias("s")).collect()}
    assert totals == {c: pytest.approx(1.0) for c in ("CO", "MX", "BR", "PE")}
    with pytest.raises(KeyError):
        weights.prior_weights(spark, ["XX"])
    with pytest.raises(KeyError):
        weights.prior_weights(spark, ["CO"], ["astronaut"])
    base = audit.ground_truth(spark, ["CO", "MX"])
    assert base.count() == 50
    for row in base.limit(5).collect():
        assert sum(row.base_probs) == pytest.approx(1.0)
        assert row.is_synthetic and row.weight > 0


def survey_frame(spark, n=500):
    rows = []
    for country in (8, 1):
        for i in range(n):
            level = i % 7
            tone = min(11, max(1, round(8 - 0.9 * level + ((i * 37) % 7 - 3) * 0.5)))
            rows.append((str(country), 88 if i % 20 == 0 else tone, level, i % 9 + 1, float(100 + 10 * (9 - i % 9))))
    return spark.createDataFrame(rows, "pais string, colorr int, edre int, occupation_major int, q10inc double")


def test_survey_ground_truth(spark):
    base = audit.ground_truth(spark, ["CO", "MX", "BR"], survey_frame(spark))
    rows = base.collect()
    assert len(rows) == 75
    by = {(r.country, r.grp): r for r in rows}
    mean = lambda r: sum(b * p for b, p in zip(BINS, r.base_probs))
    for country in ("CO", "MX"):
        assert mean(by[(country, "CEO")]) < mean(by[(country, "nurse")]) < mean(by[(country, "farmer")])
        assert not by[(country, "CEO")].is_synthetic
        assert sum(r.weight for r in rows if r.country == country) == pytest.approx(1.0)
    assert by[("BR", "CEO")].is_synthetic
    with pytest.raises(KeyError):
        baselines.survey_baseline(survey_frame(spark).drop("colorr"), groups_dim(spark))


def test_empty_tier_is_uniform(spark):
    rows = spark.createDataFrame([("8", 3, 6)] * 4, "pais string, colorr int, edre int")
    tiers = baselines.tier_distributions(baselines.survey_rows(rows, {"CO": 8}))
    got = {r.tier: r for r in tiers.collect()}
    assert got["high"].base_probs == one_hot(3) and got["high"].low_n
    assert got["low"].n_respondents == 0
    assert got["low"].base_probs == pytest.approx([1 / K] * K)


def test_country_code_forms(spark):
    rows = spark.createDataFrame([("8",), ("8.0",), ("88",), ("x",), (None,)], "pais string")
    assert baselines.country_rows(rows, "pais", {"CO": 8}).count() == 2


# ---- bootstrap -----------------------------------------------------------------


def noisy_panel(spark, spread):
    rows = []
    for model in ("m1", "m2", "m3"):
        for grp, centre in (("CEO", 3), ("domestic worker", 8)):
            rows += [("CO", "en", model, grp, i % 10 != 0, centre + (i % 3 - 1) * spread) for i in range(20)]
    return panel_rows(spark, rows)


def test_bootstrap_by_cell(spark):
    out = audit.index_with_interval(noisy_panel(spark, 1), two_group_baseline(spark), n_replicates=200)
    rows = out.orderBy("model").collect()
    assert [r.model for r in rows] == ["m1", "m2", "m3"]
    assert all(r.n_units == 40 and r.n_replicates == 200 for r in rows)
    assert all(r.index_lower <= r.index_value <= r.index_upper for r in rows)
    again = audit.index_with_interval(noisy_panel(spark, 1), two_group_baseline(spark), n_replicates=200)
    assert again.orderBy("model").collect() == rows
    assert len({r.index_lower for r in rows}) > 1, "cells must not share one random stream"
    wider = audit.index_with_interval(noisy_panel(spark, 3), two_group_baseline(spark), n_replicates=200).collect()
    assert min(r.index_upper - r.index_lower for r in wider) > max(r.index_upper - r.index_lower for r in rows)


def test_bootstrap_degenerate_and_uncovered_cells(spark):
    base = two_group_baseline(spark)
    rows = two_group_panel(spark).unionByName(panel_rows(spark, [("XX", "en", "m", "CEO", True, 1)] * 3))
    out = audit.index_with_interval(rows, base, n_replicates=50).collect()
    assert len(out) == 1
    assert out[0].index_lower == out[0].index_upper == pytest.approx(-2.4)
    with pytest.raises(KeyError):
        audit.index_with_interval(rows.drop("model"), base)


def test_draws_estimate_the_interval_of_row_resampling(spark):
    """Against rows resampled with NumPy's generator."""
    rows = noisy_panel(spark, 2)
    base = two_group_baseline(spark)
    hist = distributions.ordinal_histogram(rows, [*audit.CELL_KEYS, "grp"])
    got = bootstrap.bootstrap_by_cell(hist, base, audit.CELL_KEYS, ["country", "grp"], n_replicates=2000).orderBy("model").collect()
    probs = {r.grp: np.array(r.base_probs) for r in base.collect()}
    weight = {r.grp: r.weight for r in base.collect()}
    rng = np.random.default_rng(0)
    table = [r.asDict() for r in rows.collect()]
    for r in got:
        index = np.zeros(2000)
        for grp in probs:
            bins = np.array([x["bin"] if x["has_signal"] else 0 for x in table if (x["model"], x["grp"]) == (r.model, grp)])
            drawn = rng.choice(bins, (2000, len(bins)))
            counts = np.stack([(drawn == k).sum(axis=1) for k in range(1, 12)], axis=1)
            diff = counts / counts.sum(axis=1, keepdims=True) - probs[grp]
            delta = diff @ np.arange(1, 12)
            index += weight[grp] * np.sign(delta) * np.abs(np.cumsum(diff, axis=1)[:, :-1]).sum(axis=1)
        low, high = np.quantile(index, [0.025, 0.975])
        assert abs(r.index_lower - low) < 0.2 * (high - low) and abs(r.index_upper - high) < 0.2 * (high - low)


def test_group_intervals_cover_point(spark):
    hist = distributions.ordinal_histogram(noisy_panel(spark, 1), [*audit.CELL_KEYS, "grp"])
    metrics = distributions.group_metrics(hist, two_group_baseline(spark), ["country", "grp"])
    out = bootstrap.group_intervals(bootstrap.replicate_table(metrics, audit.CELL_KEYS, n_replicates=300)).collect()
    assert len(out) == 6
    for r in out:
        assert r.delta_lower <= r.delta <= r.delta_upper
        assert r.distance_lower <= r.distance_upper
        assert not math.isnan(r.distance_lower)
