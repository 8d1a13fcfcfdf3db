import math

import pytest
from pyspark.sql import functions as F

from spectraloom.functions import lines, naming, spectra, vectors
from spectraloom.functions.cosmology import luminosity_distance_mpc
from spectraloom.functions.masking import random_masks
from spectraloom.functions.scores import focal_loss
from spectraloom.settings import QualityLimits, master_grid

NAN, INF = float("nan"), float("inf")


def one(spark, column, **fields):
    df = spark.createDataFrame([tuple(fields.values())], list(fields)) if fields else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


def test_distance(spark):
    df = spark.createDataFrame([(0.1,), (2.0,)], "z double").select(luminosity_distance_mpc("z").alias("d"))
    values = [r.d for r in df.collect()]
    assert values[0] == pytest.approx(460.299936, abs=1e-5)
    steps = 20000
    e = [1 / math.sqrt(0.3 * (1 + 2 * i / steps) ** 3 + 0.7) for i in range(steps + 1)]
    total = (e[0] + e[-1] + 4 * sum(e[1:-1:2]) + 2 * sum(e[2:-1:2])) * 2 / steps / 3
    assert values[1] == pytest.approx(3 * 299792.458 / 70 * total, rel=1e-11)


def test_flux_and_luminosity_ignore_missing(spark):
    rows = [(0.1, 5.0, 1.0), (NAN, 5.0, 1.0), (0.1, NAN, 1.0), (0.1, -1.0, 1.0), (0.0, 5.0, 1.0), (0.1, 5.0, NAN), (0.1, 5.0, 0.0)]
    df = spark.createDataFrame(rows, "z double, OIII_FLUX double, OIII_FLUX_ERR double")
    out = lines.luminosity_from_flux(df).collect()
    assert [r.OIII_LUM is not None for r in out] == [True, False, False, False, False, True, True]
    assert [r.OIII_SNR is not None for r in out] == [True] + [False] * 6
    assert out[0].LOG_OIII_LUM == pytest.approx(math.log10(out[0].OIII_LUM))
    back = lines.flux_from_luminosity(lines.luminosity_from_flux(df).drop("OIII_FLUX", "OIII_FLUX_ERR", "OIII_SNR"))
    first = back.first()
    assert first.OIII_FLUX == pytest.approx(5.0) and first.OIII_FLUX_ERR == pytest.approx(1.0)


def test_quality_flags_last_rule_wins(spark):
    base = {"OIII_FLUX": 50.0, "OIII_FLUX_ERR": 5.0, "OIII_LUM": 1e41, "OIII_LUM_ERR": 1e40, "OIII_SIGMA": 200.0,
            "OIII_VOFF": 0.0, "OIII_CHI2": 1.0}
    cases = [
        ({}, "valid"),
        ({"OIII_FLUX": None}, "missing_snr"),
        ({"OIII_FLUX": -1.0}, "low_snr"),
        ({"OIII_FLUX_ERR": None}, "missing_snr"),
        ({"OIII_FLUX_ERR": 0.0}, "missing_snr"),
        ({"OIII_FLUX": 24.9}, "low_snr"),
        ({"OIII_FLUX": 25.0}, "valid"),
        ({"OIII_LUM": None}, "missing_lum"),
        ({"OIII_LUM": 0.0}, "too_low_lum"),
        ({"OIII_LUM": 1e38}, "valid"),
        ({"OIII_LUM": 1e46}, "too_high_lum"),
        ({"OIII_LUM_ERR": 0.0}, "non_positive_lum_err"),
        ({"OIII_LUM_ERR": None}, "valid"),
        ({"OIII_SIGMA": 30.0}, "sigma_too_low"),
        ({"OIII_SIGMA": 1000.0}, "valid"),
        ({"OIII_SIGMA": 1000.5}, "sigma_too_high"),
        ({"OIII_SIGMA": NAN}, "valid"),
        ({"OIII_VOFF": -1000.0}, "valid"),
        ({"OIII_VOFF": -1001.0}, "voff_too_large"),
        ({"OIII_CHI2": 3.5}, "chi2_too_high"),
        ({"OIII_SIGMA": 20.0, "OIII_VOFF": 2000.0}, "voff_too_large"),
    ]
    schema = "i int, " + ", ".join(f"{c} double" for c in base)
    df = spark.createDataFrame([(i, *{**base, **c}.values()) for i, (c, _) in enumerate(cases)], schema)
    out = lines.quality_flags(df, QualityLimits(max_chi2=3.0)).orderBy("i").collect()
    assert [r.OIII_QUALITY_FLAG for r in out] == [flag for _, flag in cases]
    assert [r.OIII_VALID for r in out] == [flag == "valid" for _, flag in cases]
    kept = lines.quality_flags(df.withColumn("OIII_VALID", F.col("i") != 0)).orderBy("i").first()
    assert kept.OIII_VALID is False and kept.OIII_QUALITY_FLAG == "valid"


def test_common_flux_sources(spark):
    df = spark.createDataFrame(
        [(0.1, 5.0, 1e41), (0.1, None, 1e41), (0.1, INF, None), (None, None, 1e41)],
        "z double, OIII_FLUX double, OIII_LUM double",
    )
    out = lines.common_line_flux(df).collect()
    assert [r.OIII_FLUX_SOURCE for r in out] == ["catalog_flux", "luminosity_converted", "missing", "missing"]
    assert [r.OIII_USABLE for r in out] == [True, True, False, False]
    assert out[0].OIII_FLUX_CGS == pytest.approx(5e-17)


def test_aliases_do_not_replace_standard_columns(spark):
    df = spark.createDataFrame([(40.0, 41.0, 0.1)], "LOGL_OIII double, LOG_OIII_LUM double, ERR_LOGL_OIII double")
    row = lines.standardize_line_columns(df).first()
    assert row.LOG_OIII_LUM == 41.0 and row.OIII_LUM == pytest.approx(1e41)
    assert row.OIII_LUM_ERR == pytest.approx(math.log(10) * 1e41 * 0.1)


def test_safe_ratio_and_usable(spark):
    df = spark.createDataFrame([(2.0, -4.0), (INF, 1.0), (None, 1.0)], "a double, b double")
    got = [r.r for r in df.select(lines.safe_ratio("a", "b").alias("r")).collect()]
    assert got[0] == pytest.approx(2.0) and got[1:] == [None, None]
    words = spark.createDataFrame([("True",), ("1",), ("YES",), ("no",), (None,)], "OIII_VALID string")
    assert [r.u for r in words.select(lines.usable_flag(words).alias("u")).collect()] == [True, True, True, False, False]


def test_names(spark):
    df = spark.createDataFrame([(123456, 52000, 7)], "PLATE int, mjd int, FIBERID int")
    assert df.select(naming.spectrum_filename(df)).first()[0] == "spec-123456-52000-0007.fits"
    assert df.select(naming.legacy_filename("PLATE", "mjd", "FIBERID")).first()[0] == "spSpec-52000-123456-007.fit"
    with pytest.raises(KeyError):
        naming.spectrum_filename(df.drop("mjd"))
    assert one(spark, naming.run_name(F.lit(0.3), F.lit(1.0), F.lit(42))) == "alpha_0p30_gamma_1p0_seed_42"
    assert one(spark, naming.resolve_path("/a/", F.lit("/b/c"))) == "/b/c"
    assert one(spark, naming.resolve_path("/a/", F.lit("c"))) == "/a/c"


def test_focal_loss(spark):
    assert one(spark, focal_loss(F.lit(0.0), F.lit(1))) == pytest.approx(0.04332169878499658)
    assert one(spark, focal_loss(F.lit(-800.0), F.lit(1), 0.25, 2.0)) == pytest.approx(200.0)


def test_vector_columns(spark):
    a, b = F.lit([1.0, 2.0]), F.lit([3.0, 2.0])
    assert one(spark, vectors.fuse_pair(a, b)) == [1, 2, 3, 2, 2, 0]
    assert one(spark, vectors.signed_max_abs(F.lit([-4.0, 2.0]))) == pytest.approx([-1, 0.5])
    assert one(spark, vectors.upsample(F.lit([0.0, 1.0]), 4)) == [0, 0.25, 0.75, 1]
    assert one(spark, vectors.upsample(F.lit([3.0, 1.0, 2.0]), 3)) == [3, 1, 2]
    assert one(spark, vectors.min_max(F.lit([2.0, 4.0, 3.0]))) == pytest.approx([0, 1, 0.5])
    assert one(spark, vectors.received_weight(F.lit([[1.0, 2.0], [3.0, 4.0]]))) == [4, 6]
    assert one(spark, vectors.peak_wavelength(F.lit([1.0, 5.0, 5.0]), [10, 20, 30])) == 20
    assert one(spark, vectors.pool_mean_max(F.lit([[1.0, 3.0], [2.0, 2.0]]))) == [2, 2, 3, 2]
    got = one(spark, vectors.standardize(F.array(F.lit(1.0), F.lit(NAN), F.lit(3.0))))
    assert got[0] == pytest.approx(-1) and math.isnan(got[1])
    ones = one(spark, vectors.ablate(F.lit([1.0] * 1024), master_grid()))
    assert ones.count(0.0) == 783 and ones.count(1.0) == 241


def test_masks_repeat_and_stay_inside(spark):
    df = spark.range(200).withColumn("x", F.lit([1.0] * 1024))
    masked = df.select("id", random_masks("x", ["id"], 1, master_grid()).alias("m"))
    first = {r.id: r.m for r in masked.collect()}
    again = {r.id: r.m for r in masked.repartition(3).collect()}
    assert first == again
    lengths = [m.count(0.0) for m in first.values()]
    assert min(lengths) >= 14 and max(lengths) <= 0.6 * 169 + 60 and len(set(lengths)) > 20


def test_short_vectors_give_null(spark):
    df = spark.createDataFrame([([1.0] * 60,), ([1.0] * 200,)], "x array<double>")
    got = [r.f for r in df.select(spectra.continuum_subtracted("x").alias("f")).collect()]
    assert got[0] is None and got[1] == pytest.approx([0.0] * 200)


def test_wavelength_axis_prefers_loglam(spark):
    df = spark.createDataFrame([([1.0, 1.0], [0.0, 1.0], [5.0, 6.0], 2.0, 3.0)],
                               "flux array<double>, l array<double>, w array<double>, c double, d double")
    assert df.select(vectors.wavelength_axis("flux", "l", "w")).first()[0] == [1.0, 10.0]
    assert df.select(vectors.wavelength_axis("flux", None, "w")).first()[0] == [5.0, 6.0]
    assert df.select(vectors.wavelength_axis("flux", crval1="c", cdelt1="d")).first()[0] == [2.0, 5.0]


def test_vector_moments_merge(spark, monkeypatch):
    import numpy as np

    from spectraloom.operators import shape

    monkeypatch.setattr(shape, "FAN_IN", 2)
    rnd = np.random.default_rng(8)
    rows = [(["a", "b", None][i % 3], (1e6 + rnd.normal(size=5)).tolist()) for i in range(90)]
    rows += [("a", [None, 0.0, 1e6, 1e6, None]), ("a", None), ("b", []), ("b", [0.0, 1e6]), ("c", [None, 1.0])]
    df = spark.createDataFrame(rows, "k string, flux array<double>").repartition(9)
    got = {r.k: r for r in shape.class_profiles(df, "k").collect()}
    for k in ("a", "b", None, "c"):
        columns = [[v[i] for key, v in rows if key == k and v and len(v) > i and v[i] is not None] for i in range(5)]
        for i, x in enumerate(columns):
            if not x:
                assert i >= len(got[k].mean) or got[k].mean[i] is None
            else:
                assert got[k].mean[i] == pytest.approx(np.mean(x), rel=1e-12) and got[k].std[i] == pytest.approx(np.std(x), rel=1e-6, abs=1e-9)
    assert tuple(shape.safe_range(df, [10.0, 20.0, 30.0, 40.0, 50.0]).first()) == (30.0, 50.0, 20.0)
    assert shape.class_profiles(df.limit(0), "k").count() == 0 and shape.safe_range(df.limit(0), [1.0]).first().valid_range is None
    with_nan = spark.createDataFrame([("a", [float("nan"), 1.0]), ("a", [2.0, 3.0])], "k string, flux array<double>")
    assert np.isnan(shape.class_profiles(with_nan, "k").first().mean[0])
