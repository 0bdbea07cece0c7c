"""Scalar functions, grids, prompts."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ordscope import fixed_values as fv
from ordscope.functions import ids, ordinal, probability, prompts
from ordscope.operators import classify, grid
from ordscope.sources import dimensions
from ordscope.sources.images import with_patch_statistics


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


@pytest.mark.parametrize(
    "values,want",
    [
        ((None, None, None), (None, 0, 0, False)),
        ((4, None, None), (4, 1, 1, False)),
        ((3, 8, None), (6, 2, 0, False)),
        ((2, 3, None), (2, 2, 2, True)),
        ((5, 5, 9), (5, 3, 2, True)),
        ((1, 6, 11), (6, 3, 1, False)),
    ],
)
def test_consensus(spark, values, want):
    c = one(spark, ordinal.consensus([F.lit(v).cast("int") for v in values]))
    assert tuple(c) == want


def test_consensus_tolerance(spark):
    c = one(spark, ordinal.consensus([F.lit(v) for v in (3, 5, 8)], tolerance=2))
    assert (c.bin, c.n_concordant) == (5, 2)


def test_angle_mappings(spark):
    angles = [70.0, 55.0, 0.0, -50.0, -200.0, 200.0, float("nan"), None, 90.0, -90.0, 89.9]
    df = spark.createDataFrame([(a,) for a in angles], "a double")
    got = [tuple(r) for r in df.select(ordinal.angle_to_bin(F.col("a")), ordinal.angle_to_label(F.col("a"))).collect()]
    assert [b for b, _ in got[:8]] == [1, 1, 6, 11, 11, 1, 6, 6]
    assert [x for _, x in got] == [
        "very_light", "very_light", "brown", "dark", "unknown", "unknown", "unknown", "unknown", "unknown", "dark", "very_light",
    ]


def test_tone_and_palette(spark):
    df = spark.createDataFrame([(t,) for t in range(0, 12)], "t int")
    bins = [r[0] for r in df.select(ordinal.tone_to_bin(F.col("t"))).collect()]
    assert bins[0] == bins[11] == 6
    assert bins[1:11] == [round((t - 1) / 9 * 10) + 1 for t in range(1, 11)]
    codes = [" #FBF2F3", "#373028", "#123456", None]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert [r[0] for r in df.select(ordinal.palette_to_bin(F.col("c"))).collect()] == [1, 11, None, None]


def test_dominant_label(spark):
    m = F.create_map(F.lit("a"), F.lit(0.2), F.lit("b"), F.lit(0.5), F.lit("c"), F.lit(0.5))
    assert one(spark, ordinal.dominant_label(m)) == "b"


def test_stable_shard_matches_hashlib(spark):
    keys = [f"model__group__{i}" for i in range(300)] + ["ñandú"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = [r[0] for r in df.select(ids.stable_shard(F.col("k"), 7)).collect()]
    assert got == [int(hashlib.sha256(k.encode()).hexdigest()[:16], 16) % 7 for k in keys]
    assert set(got) == set(range(7))
    assert df.where(ids.in_shard(F.col("k"), 0, 1)).count() == len(keys)
    for shard, n in ((0, 0), (3, 3), (-1, 2)):
        with pytest.raises(ValueError):
            ids.in_shard(F.col("k"), shard, n)


def test_path_eta_marker(spark):
    assert one(spark, ids.safe_path_component(F.lit('a/b: c*?. .'))) == "a_b__c__._"
    assert one(spark, ids.safe_path_component(F.lit("..."))) == "_"
    eta = [one(spark, ids.format_eta(F.lit(s).cast("double"))) for s in (None, 90.0, 7200.0, 129600.0)]
    assert eta == ["—", "2 min", "2.0 h", "1.5 d"]
    s = one(spark, ids.split_marker(F.lit("marker:LatAm:a:b")))
    assert (s.marker, s.grp) == ("LatAm", "a:b")
    assert one(spark, ids.fold_seed(F.lit(202605140000123))) == 202605140000123 % 2**32


@pytest.mark.parametrize(
    "noun,want",
    [("architect", "an "), ("nurse", "a "), ("European", "a "), ("university professor", "a "), ("user", "a "),
     ("one-off", "a "), ("uncle", "an "), ("", "a ")],
)
def test_article(spark, noun, want):
    assert one(spark, prompts.english_article(F.lit(noun))) == want


@pytest.mark.parametrize(
    "key,language,want",
    [
        ("architect", "en", "a photo of an architect"),
        ("doctor", "es-ES", "una fotografía de un médico"),
        ("doctor", "es-LatAm", "una foto de un médico"),
        ("nurse", "pt-BR", "uma foto de um enfermeiro"),
        ("cook", "qu", "wayk'uq"),
        ("marker:LatAm:doctor", "en", "a photo of a Colombian doctor"),
        ("marker:EU:doctor", "en", "a photo of a European doctor"),
        ("marker:US:doctor", "en", "a photo of an American doctor"),
        ("marker:unmarked:architect", "en", "a photo of an architect"),
        ("marker:US:doctor", "pt-BR", None),
        ("farmer", "gn", None),
        ("astronaut", "en", None),
        ("doctor", "xx", None),
    ],
)
def test_prompts(spark, key, language, want):
    assert one(spark, prompts.prompt_text(F.lit(key), F.lit(language))) == want
    status = one(spark, prompts.prompt_status(F.lit(key), F.lit(language)))
    assert (status == "ok") == (want is not None)


def test_grids(spark):
    sizes = {r.grid: r["n"] for r in grid.all_grids(spark).groupBy("grid").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"main": 12000, "h5": 320, "robustness": 2400} == grid.expected_sizes()
    cells = grid.all_grids(spark)
    assert cells.select("seed").distinct().count() == 14720
    assert cells.select("image_id").distinct().count() == 14720
    poc = grid.poc_grid(spark)
    assert poc.count() == 30
    assert poc.agg(F.min("seed")).first()[0] == fv.BASE_SEED * 1000
    first = grid.main_grid(spark).orderBy(*grid.ENUMERATION_ORDER).first()
    assert (first.occupation, first.language, first.country, first.seed) == (
        "CEO", "en", "MULTI", fv.BASE_SEED * 10_000_000,
    )
    assert grid.renderable(cells).count() == 14720
    assert grid.marker_grid(spark).where("occupation like 'marker:EU:%'").count() == 80


def test_slices(spark):
    cells = grid.main_grid(spark).unionByName(grid.robustness_grid(spark))
    only_extra = cells.where(grid.slice_predicate(False, False, False, True))
    assert {r.model for r in only_extra.select("model").distinct().collect()} == set(fv.EXTRA_MODELS)
    assert cells.where(grid.slice_predicate(True, False, False, False)).select("model").distinct().count() == 1


def test_crosswalk(spark):
    assert dimensions.groups_dim(spark).count() == 25
    assert [r.grp for r in dimensions.groups_by_tier(spark, "low").collect()][:2] == ["farmer", "nanny"]
    codes = [r.minor for r in dimensions.minor_codes(spark).collect()]
    assert codes == sorted(set(codes)) and len(codes) == 23
    with pytest.raises(PySparkException):
        dimensions.lookup_groups(spark.createDataFrame([("astronaut",)], "grp string")).collect()


def test_patches_and_classification(spark):
    light = bytes([219, 231, 243]) * 64 * 64
    dark = bytes([42, 49, 58]) * 64 * 64
    black = bytes([0, 0, 0]) * 16
    df = spark.createDataFrame(
        [("light", bytearray(light), True, "#f3dad6"), ("dark", bytearray(dark), True, None),
         ("black", bytearray(black), True, None), ("empty", None, False, None)],
        "name string, data binary, has_face boolean, palette_code string",
    )
    out = {r.name: r for r in classify.classify(with_patch_statistics(df)).collect()}
    assert out["light"].ita_value > 40 and out["light"].mst_value <= 3
    assert out["dark"].mst_value >= 8 and out["dark"].ita_value < 0
    assert out["light"].n_classifiers == 3 and out["light"].consensus_bin <= 3
    assert out["dark"].n_classifiers == 2
    assert out["black"].mst_value == 5 and out["black"].ita_bin == 6
    e = out["empty"]
    assert (e.ita_label, e.consensus_bin, e.n_classifiers, e.concordant_2of3) == ("no_face", None, 0, False)


def test_extend_schema_idempotent(spark):
    df = spark.createDataFrame([("a", True, float("nan"))], "image_id string, has_face boolean, ita_value double")
    assert len(classify.added_columns(df)) == 10
    once = classify.extend_schema(df)
    assert classify.extend_schema(once).columns == once.columns and not classify.added_columns(once)
    row = classify.nan_to_null(once).first()
    assert row.has_face and row.ita_value is None and row.ita_label == "not_classified"


def test_tails_at_very_many_degrees_of_freedom():
    """The t tail becomes the normal one, the F tail with two numerator degrees an exponential."""
    for df in (1e9, 1e12, 1e14):
        for t in (-0.3, -1.0, -2.0, -5.0):
            assert probability.t_cdf(t, df) == pytest.approx(probability.normal_cdf(t), rel=2e-7)
        assert probability.f_sf(3.5, 2, df) == pytest.approx(math.exp(-3.5), rel=1e-7)
    z = np.array([-38.0, -8.0, -3.0, -1.7, -0.2, 0.0, 0.5, 3.0, 9.0])
    assert probability.normal_cdf(z) == pytest.approx([0.5 * math.erfc(-v / math.sqrt(2)) for v in z], rel=1e-12)
    assert np.isnan(probability.t_cdf(float("nan"), 5)) and np.isnan(probability.normal_cdf(float("nan")))


def test_binomial_quantile():
    rng = np.random.default_rng(1)
    for n, p in ((1, 0.5), (7, 0.3), (40, 0.999), (300, 0.02)):
        mass = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
        u = rng.random(200)
        want = [min(int(np.searchsorted(np.cumsum(mass), v)), n) for v in u]
        assert probability.binomial_quantile(u, np.full(200, n), p).tolist() == want
    assert probability.binomial_quantile(np.array([0.2, 0.9]), np.array([5, 0]), 1.0).tolist() == [5, 0]
    assert probability.binomial_quantile(np.array([0.2]), np.array([5]), 0.0).tolist() == [0]
    # Summed probabilities and the walk agree, with one or the other evaluation of the distribution function.
    u = rng.random(50)
    for n, p in ((30, 0.3), (500, 0.02), (2_000, 0.6), (20_000, 0.3)):
        kept, probability._FEW = probability._FEW, 0
        try:
            walked = probability.binomial_quantile(u, np.full(50, n), p)
        finally:
            probability._FEW = kept
        assert (walked == probability._few_trials(u, np.full(50, n), p)).all()
    large = probability.binomial_quantile(np.array([0.025, 0.5, 0.975]), np.full(3, 10**12), 0.3)
    assert (large - 3 * 10**11) / math.sqrt(0.21e12) == pytest.approx([-1.959964, 0.0, 1.959964], abs=1e-4)


def test_tail_probabilities():
    assert probability.normal_cdf(-1.959963985) == pytest.approx(0.025, abs=1e-9)
    assert probability.t_cdf(-2.228138852, 10) == pytest.approx(0.025, abs=1e-8)
    assert probability.t_cdf(0.0, 3) == pytest.approx(0.5)
    assert probability.f_sf(3.708264820, 3, 10) == pytest.approx(0.05, abs=1e-8)
    # F(1, d) is the square of t(d)
    for t, d in ((0.5, 4), (2.5, 30), (7.0, 5)):
        assert probability.f_sf(t * t, 1, d) == pytest.approx(2 * probability.t_cdf(-t, d), rel=1e-9)
    grid_ = np.linspace(0.01, 0.99, 9)
    for x in grid_:
        assert probability.incomplete_beta(2.0, 3.0, x) == pytest.approx(
            6 * x**2 - 8 * x**3 + 3 * x**4, rel=1e-12
        )


def png(width, height, kind, pixels):
    """A PNG file: colour type 0 grey, 2 RGB, 6 RGB with alpha."""
    import struct
    import zlib

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    step = len(pixels) // height
    lines = b"".join(b"\0" + pixels[i : i + step] for i in range(0, len(pixels), step))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_images_of_every_kind_stay(spark, tmp_path):
    from ordscope.sources.images import read_patches

    (tmp_path / "grey.png").write_bytes(png(2, 1, 0, bytes([10, 200])))
    (tmp_path / "rgb.png").write_bytes(png(1, 1, 2, bytes([1, 2, 3])))
    (tmp_path / "alpha.png").write_bytes(png(1, 1, 6, bytes([1, 2, 3, 77])))
    (tmp_path / "broken.png").write_bytes(b"no image")
    got = {r.path.rsplit("/", 1)[-1]: r.data for r in read_patches(spark, str(tmp_path)).collect()}
    assert got["grey.png"] == bytes([10, 10, 10, 200, 200, 200])
    assert got["rgb.png"] == got["alpha.png"] == bytes([3, 2, 1])
    assert got["broken.png"] is None


def test_batch_medians_equal_single_medians():
    from ordscope.sources.images import batch_medians, lab_of

    rng = np.random.default_rng(3)
    buffers = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 3, 4, 64, 300)] + [None, bytes(30)]
    got = batch_medians(buffers)
    for row, data in zip(got, buffers):
        rgb = np.frombuffer(data or b"", np.uint8)
        rgb = rgb[: len(rgb) // 3 * 3].reshape(-1, 3)[:, ::-1].astype(float)
        lab = lab_of(rgb)
        skin, usable = (lab[:, 0] > 20) & (lab[:, 0] < 95), (lab[:, 0] > 15) & (lab[:, 0] < 97)
        want = [np.median(lab[skin, i]) if skin.any() else np.nan for i in (0, 2)]
        want += [np.median(rgb[usable, i]) if usable.any() else np.nan for i in range(3)]
        assert row == pytest.approx(want, nan_ok=True)


def test_grey_patches_have_no_hue_in_any_batch():
    """The blue-yellow median of grey is exactly zero, and digits do not depend on the batch."""
    from ordscope.sources.images import batch_medians

    rng = np.random.default_rng(5)
    buffers = [bytes([v]) * 3 * n for v, n in zip(rng.integers(60, 220, 1000).tolist(), rng.integers(1, 40, 1000).tolist())]
    buffers[1::2] = [rng.integers(0, 256, 30, dtype=np.uint8).tobytes() for _ in buffers[1::2]]
    together = batch_medians(buffers)
    alone = np.vstack([batch_medians([b]) for b in buffers])
    assert np.array_equal(together, alone, equal_nan=True)
    assert (together[::2, 1] == 0).all()


def test_binomial_quantile_of_any_size():
    """The walk from one evaluation ends where the distribution function passes the number."""
    rng = np.random.default_rng(6)
    for n in (501, 5_000, 10**6, 10**9, 10**12):
        for p in (1e-4, 0.3, 0.5, 0.97):
            u = np.concatenate([rng.random(200), [1e-9, 1 - 1e-9]])
            k = probability.binomial_quantile(u, np.full(len(u), n), p)
            assert (probability.binomial_cdf(k, np.full(len(u), n), p) >= u - 1e-11).all()
            assert (probability.binomial_cdf(k - 1, np.full(len(u), n), p) < u + 1e-11).all()
