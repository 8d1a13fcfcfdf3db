"""Vector operators on embeddings (64 pixels) and on runs of 100 events as raw spectra."""

from pyspark.sql import functions as F

from spectraloom.functions import spectra, vectors
from spectraloom.operators.select import RULES, clean_spectra, cleaning_report
from spectraloom.operators.shape import class_profiles, safe_range
from spectraloom.plans.diagnosis import diagnose_pairs
from spectraloom.plans.preprocessing import preprocess_spectra

from .registry import long_vector, query, rnd, table

WINDOW = 7
# 64 pixels from 4700 in steps of 32, and a range that reaches the bands of both lines
WAVE = [4700.0 + 32.0 * i for i in range(64)]
WAVE_SQL = "4700.0 + 32.0 * pos"

PIXELS = """
  px AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
"""
# running mean of 7 with mirrored edges, via an index that folds back at both ends
FLAT = f"""
  {PIXELS},
  mirrored AS (
    SELECT vec_id, pos, v FROM px
    UNION ALL SELECT vec_id, -pos, v FROM px WHERE pos BETWEEN 1 AND 3
    UNION ALL SELECT vec_id, 126 - pos, v FROM px WHERE pos BETWEEN 60 AND 62),
  means AS (SELECT vec_id, pos, avg(v) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m
            FROM mirrored),
  flat AS (SELECT px.vec_id, px.pos, px.v, v - m AS f FROM px JOIN means USING (vec_id, pos))
"""
MAD = f"""
  {FLAT},
  med AS (SELECT vec_id, quantile_disc(f, 0.5) AS med FROM flat GROUP BY vec_id),
  mad AS (SELECT vec_id, any_value(med) AS med, quantile_disc(abs(f - med), 0.5) AS mad
          FROM flat JOIN med USING (vec_id) GROUP BY vec_id),
  taper AS (SELECT pos, least(least(pos, 63 - pos) / 4.0, 1.0)::DOUBLE AS t FROM generate_series(0, 63) g(pos)),
  ind AS (SELECT vec_id, pos, v, f, (f - med) / (mad * 1.4826 + 1e-8) * t AS x FROM flat JOIN mad USING (vec_id) JOIN taper USING (pos))
"""


def embeddings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


@query("continuum_subtracted", f"WITH {FLAT} SELECT vec_id, pos, round(f, 8) + 0.0 AS value FROM flat")
def continuum(spark, sf_dir):
    df = embeddings(spark, sf_dir).withColumn("flat", spectra.continuum_subtracted("x", WINDOW))
    return long_vector(df, ["vec_id"], "flat", 8)


@query("mad_normalized", f"WITH {MAD} SELECT vec_id, pos, round(x, 6) + 0.0 AS value FROM ind")
def mad(spark, sf_dir):
    flat = spectra.continuum_subtracted("x", WINDOW)
    df = embeddings(spark, sf_dir).withColumn("n", spectra.mad_normalized(flat))
    return long_vector(df, ["vec_id"], "n.normalized", 6)


@query(
    "median_and_mad",
    f"WITH {MAD} SELECT vec_id, round(med, 9) + 0.0 AS median, round(mad, 9) AS mad FROM mad",
)
def median_mad(spark, sf_dir):
    flat = spectra.continuum_subtracted("x", WINDOW)
    df = embeddings(spark, sf_dir).withColumn("n", spectra.mad_normalized(flat))
    return df.select("vec_id", rnd("n.median", 9).alias("median"), rnd("n.mad", 9).alias("mad"))


def neighbour_pairs(spark, sf_dir):
    """Each vector with its successor, the last with the first."""
    e = embeddings(spark, sf_dir)
    count = e.select(F.count("*")).scalar()
    after = e.select(((F.col("vec_id") + count - 1) % count).alias("vec_id"), F.col("x").alias("y"))
    return e.join(after, "vec_id")


@query(
    "pair_mad_normalized",
    f"""
    WITH {FLAT}, n AS (SELECT count(*) AS n FROM embeddings),
    both_members AS (SELECT vec_id, 1 AS side, pos, f FROM flat
      UNION ALL SELECT (vec_id + n - 1) % n, 2, pos, f FROM flat, n),
    med AS (SELECT vec_id, quantile_disc(f, 0.5) AS med FROM both_members GROUP BY 1),
    mad AS (SELECT vec_id, any_value(med) AS med, quantile_disc(abs(f - med), 0.5) AS mad
            FROM both_members JOIN med USING (vec_id) GROUP BY 1)
    SELECT vec_id, round(med, 9) + 0.0 AS median, round(mad, 9) AS mad,
      round(sum((f - med) / (mad * 1.4826 + 1e-8) * least(least(pos, 63 - pos) / 4.0, 1.0)::DOUBLE)
              FILTER (side = 1), 5) + 0.0 AS first_sum,
      round(sum(abs((f - med) / (mad * 1.4826 + 1e-8)) * least(least(pos, 63 - pos) / 4.0, 1.0)::DOUBLE)
              FILTER (side = 2), 5) + 0.0 AS second_abs_sum
    FROM both_members JOIN mad USING (vec_id) GROUP BY vec_id, med, mad
    """,
)
def pair_mad(spark, sf_dir):
    df = neighbour_pairs(spark, sf_dir)
    a, b = (spectra.continuum_subtracted(c, WINDOW) for c in ("x", "y"))
    df = df.select("vec_id", spectra.pair_mad_normalized(a, b).alias("p"))

    def total(c, f):
        return F.aggregate(c, F.lit(0.0), lambda s, v: s + f(v))

    return df.select(
        "vec_id",
        rnd("p.median", 9).alias("median"),
        rnd("p.mad", 9).alias("mad"),
        rnd(total(F.col("p.first"), lambda v: v), 5).alias("first_sum"),
        rnd(total(F.col("p.second"), lambda v: F.abs(v)), 5).alias("second_abs_sum"),
    )


@query(
    "edge_taper",
    f"WITH {PIXELS} SELECT vec_id, pos, round(v * least(least(pos, 63 - pos) / 4.0, 1.0)::DOUBLE, 9) + 0.0 AS value FROM px",
)
def taper(spark, sf_dir):
    df = embeddings(spark, sf_dir).withColumn("t", vectors.edge_taper("x", 64))
    return long_vector(df, ["vec_id"], "t", 9)


@query(
    "standardized_vector",
    f"""
    WITH {PIXELS}
    SELECT vec_id, pos, round((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-8), 7) + 0.0 AS population,
           round((v - avg(v) OVER w) / (stddev_samp(v) OVER w + 1e-8), 7) + 0.0 AS sample
    FROM px WINDOW w AS (PARTITION BY vec_id)
    """,
)
def standardized(spark, sf_dir):
    df = embeddings(spark, sf_dir).select(
        "vec_id", F.arrays_zip(vectors.standardize("x").alias("p"), vectors.standardize("x", sample=True).alias("s")).alias("z")
    )
    out = df.select("vec_id", F.posexplode("z").alias("pos", "z"))
    return out.select(
        "vec_id", F.col("pos").cast("bigint").alias("pos"), rnd("z.p", 7).alias("population"), rnd("z.s", 7).alias("sample")
    )


@query(
    "line_ablation",
    f"""
    WITH {PIXELS}
    SELECT vec_id, pos, CASE WHEN {WAVE_SQL} BETWEEN 4575 AND 5550 OR {WAVE_SQL} BETWEEN 5800 AND 5950
             OR {WAVE_SQL} BETWEEN 6200 AND 6699 THEN 0 ELSE round(v, 9) + 0.0 END AS value FROM px
    """,
)
def ablated(spark, sf_dir):
    df = embeddings(spark, sf_dir).withColumn("a", vectors.ablate("x", WAVE))
    return long_vector(df, ["vec_id"], "a", 9)


@query(
    "line_flux",
    f"""
    WITH {PIXELS}, w AS (SELECT vec_id, pos, v, {WAVE_SQL} AS wave FROM px),
    c AS (SELECT vec_id, median(v) FILTER (wave BETWEEN 4670 AND 4730) AS blue1, count(*) FILTER (wave BETWEEN 4670 AND 4730) AS n1,
        median(v) FILTER (wave BETWEEN 5080 AND 5120) AS red1, count(*) FILTER (wave BETWEEN 5080 AND 5120) AS n2,
        median(v) FILTER (wave BETWEEN 6150 AND 6250) AS blue2, median(v) FILTER (wave BETWEEN 6950 AND 7150) AS red2,
        count(*) FILTER (wave BETWEEN 6950 AND 7150) AS n3 FROM w GROUP BY vec_id),
    ha AS (SELECT vec_id, wave, v - (blue2 + (red2 - blue2) * (wave - 6200) / 850.0) AS d FROM w JOIN c USING (vec_id)
           WHERE n3 >= 2 AND wave BETWEEN 6477.1 AND 6652.1),
    steps AS (SELECT vec_id, (d + lead(d) OVER o) / 2 * (lead(wave) OVER o - wave) AS s FROM ha
              WINDOW o AS (PARTITION BY vec_id ORDER BY wave)),
    hb AS (SELECT vec_id, wave, v - (blue1 + (red1 - blue1) * (wave - 4700) / 400.0) AS d FROM w JOIN c USING (vec_id)
           WHERE n1 >= 2 AND n2 >= 2 AND wave BETWEEN 4797.8 AND 4927.5)
    SELECT e.vec_id, (SELECT round(sum(s), 7) + 0.0 FROM steps WHERE steps.vec_id = e.vec_id) AS ha,
           (SELECT round(sum(d), 7) FROM hb WHERE hb.vec_id = e.vec_id) AS hb
    FROM embeddings e
    """,
)
def line_fluxes(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    return df.select(
        "vec_id",
        rnd(spectra.line_flux("x", WAVE, "ha"), 7).alias("ha"),
        rnd(spectra.line_flux("x", WAVE, "hb"), 7).alias("hb"),
    )


@query(
    "wing_score",
    f"""
    WITH {PIXELS}
    SELECT vec_id, round(avg(abs(v)) FILTER ({WAVE_SQL} BETWEEN 4797.8 AND 4840 OR {WAVE_SQL} BETWEEN 4885 AND 4927.5), 8) AS hb,
           round(avg(abs(v)) FILTER ({WAVE_SQL} BETWEEN 6477.1 AND 6535 OR {WAVE_SQL} BETWEEN 6600 AND 6652.1), 8) AS ha
    FROM px GROUP BY vec_id
    """,
)
def wings(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    return df.select(
        "vec_id",
        rnd(spectra.wing_score("x", WAVE, "hb"), 8).alias("hb"),
        rnd(spectra.wing_score("x", WAVE, "ha"), 8).alias("ha"),
    )


@query(
    "peak_above_median",
    f"""
    WITH {PIXELS}
    SELECT vec_id, round(max(v) FILTER ({WAVE_SQL} BETWEEN 4700 AND 5100) - median(v), 8) AS hb,
           round(max(v) FILTER ({WAVE_SQL} BETWEEN 6300 AND 6699) - median(v), 8) AS ha
    FROM px GROUP BY vec_id
    """,
)
def peaks(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    return df.select(
        "vec_id",
        rnd(spectra.peak_above_median("x", WAVE, "hb"), 8).alias("hb"),
        rnd(spectra.peak_above_median("x", WAVE, "ha"), 8).alias("ha"),
    )


@query(
    "safe_pixel_range",
    f"""
    WITH {PIXELS},
    z AS (SELECT pos FROM px GROUP BY pos HAVING bool_and(abs(v) > 0.0002 * (1 + 10 * (pos % 8))))
    SELECT min({WAVE_SQL})::DOUBLE AS blue_limit, max({WAVE_SQL})::DOUBLE AS red_limit,
           (max({WAVE_SQL}) - min({WAVE_SQL}))::DOUBLE AS valid_range FROM z
    """,
)
def safe_pixels(spark, sf_dir):
    limit = lambda i: 0.0002 * (1 + 10 * (i % 8))
    zeroed = F.transform("x", lambda v, i: F.when(F.abs(v) > limit(i), v).otherwise(0.0))
    return safe_range(embeddings(spark, sf_dir).withColumn("flux", zeroed), WAVE)


@query(
    "pooled_channels",
    f"""
    WITH {PIXELS}, c AS (SELECT vec_id, pos // 8 AS channel, avg(v) AS mean, max(v) AS high FROM px GROUP BY ALL)
    SELECT vec_id, channel AS pos, round(mean, 8) + 0.0 AS value FROM c
    UNION ALL SELECT vec_id, channel + 8, round(high, 8) + 0.0 FROM c
    """,
)
def pooled(spark, sf_dir):
    channels = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("x", i * 8 + 1, F.lit(8)))
    df = embeddings(spark, sf_dir).withColumn("p", vectors.pool_mean_max(channels))
    return long_vector(df, ["vec_id"], "p", 8)


@query(
    "fused_pair",
    f"""
    WITH {PIXELS}, n AS (SELECT count(*) AS n FROM embeddings),
    p AS (SELECT a.vec_id, a.pos, a.v AS x, b.v AS y FROM px a, n JOIN px b ON b.vec_id = (a.vec_id + 1) % n AND b.pos = a.pos)
    SELECT vec_id, pos, round(x, 9) + 0.0 AS value FROM p
    UNION ALL SELECT vec_id, pos + 64, round(y, 9) + 0.0 FROM p
    UNION ALL SELECT vec_id, pos + 128, round(abs(x - y), 9) + 0.0 FROM p
    """,
)
def fused(spark, sf_dir):
    df = neighbour_pairs(spark, sf_dir).withColumn("f", vectors.fuse_pair("x", "y"))
    return long_vector(df, ["vec_id"], "f", 9)


@query(
    "signed_max_abs",
    f"WITH {PIXELS} SELECT vec_id, pos, round(v / (max(abs(v)) OVER (PARTITION BY vec_id) + 1e-8), 8) + 0.0 AS value FROM px",
)
def max_abs(spark, sf_dir):
    df = embeddings(spark, sf_dir).withColumn("m", vectors.signed_max_abs("x"))
    return long_vector(df, ["vec_id"], "m", 8)


@query(
    "min_max_scaled",
    f"""
    WITH {PIXELS}
    SELECT vec_id, pos, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-8), 8) + 0.0 AS value
    FROM px WINDOW w AS (PARTITION BY vec_id)
    """,
)
def minmax(spark, sf_dir):
    df = embeddings(spark, sf_dir).withColumn("m", vectors.min_max("x"))
    return long_vector(df, ["vec_id"], "m", 8)


@query(
    "upsampled_vector",
    f"""
    WITH {PIXELS},
    place AS (SELECT i, greatest((i + 0.5) * 64 / 160.0 - 0.5, 0)::DOUBLE AS p FROM generate_series(0, 159) g(i))
    SELECT a.vec_id, i AS pos, round(a.v * (1 - (p - floor(p))) + b.v * (p - floor(p)), 8) + 0.0 AS value
    FROM place JOIN px a ON a.pos = floor(p) JOIN px b ON b.vec_id = a.vec_id AND b.pos = least(floor(p) + 1, 63)
    """,
)
def upsampled(spark, sf_dir):
    df = embeddings(spark, sf_dir).withColumn("u", vectors.upsample("x", 160))
    return long_vector(df, ["vec_id"], "u", 8)


@query(
    "received_weight",
    f"""
    WITH {PIXELS}
    SELECT vec_id, pos % 4 AS pos, round(sum(v) / 4, 8) + 0.0 AS value FROM px GROUP BY ALL
    """,
)
def received(spark, sf_dir):
    # 64 values as 4 heads of 4 x 4 weights
    def row(h, r):
        return F.slice("x", F.lit(h * 16 + r * 4 + 1), F.lit(4))

    heads = F.array(*[F.array(*[row(h, r) for r in range(4)]) for h in range(4)])
    df = embeddings(spark, sf_dir).withColumn("w", vectors.received_weight(vectors.mean_matrix(heads)))
    return long_vector(df, ["vec_id"], "w", 8)


@query(
    "peak_wavelength",
    f"WITH {PIXELS} SELECT vec_id, (4700.0 + 32.0 * arg_max(pos, v))::DOUBLE AS wavelength FROM px GROUP BY vec_id",
)
def peak_wave(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    return df.select("vec_id", vectors.peak_wavelength("x", WAVE).alias("wavelength"))


@query(
    "class_profiles",
    f"""
    WITH {PIXELS} SELECT label, pos, round(avg(v), 8) + 0.0 AS mean, round(stddev_pop(v), 8) AS std FROM px GROUP BY ALL
    """,
)
def profiles(spark, sf_dir):
    df = class_profiles(embeddings(spark, sf_dir), "label", "x")
    both = df.select("label", F.posexplode(F.arrays_zip("mean", "std")).alias("pos", "v"))
    return both.select("label", F.col("pos").cast("bigint").alias("pos"), rnd("v.mean", 8).alias("mean"), rnd("v.std", 8).alias("std"))


def cleaning_rows(spark, sf_dir):
    """Small pixels become zero, so that coverage varies; some vectors have gaps."""
    flux = F.transform(
        "x",
        lambda v, i: F.when(F.abs(v) < 0.085, 0.0).when((F.col("label") == 7) & (i < 20), F.lit(float("nan"))).otherwise(v),
    )
    flux = F.when(F.col("vec_id") % 50 == 0, F.transform("x", lambda v: F.lit(float("nan")))).otherwise(flux)
    return embeddings(spark, sf_dir).select(
        "vec_id",
        flux.alias("flux"),
        F.when(F.col("label") == 9, None).otherwise(F.col("label") + 2.0).alias("snr"),
        F.when(F.col("vec_id") % 3 == 0, "no").otherwise("True").alias("OIII_VALID"),
    )


CLEAN_SQL = f"""
  {PIXELS},
  c AS (SELECT vec_id, label, CASE WHEN vec_id % 50 = 0 THEN NULL WHEN abs(v) < 0.085 THEN 0.0
                WHEN label = 7 AND pos < 20 THEN NULL ELSE v END AS v FROM px),
  m AS (SELECT vec_id, count(*) FILTER (v = 0) / 64.0 <= 0.5 AS ok1, coalesce(max(v) <= 0.35, false) AS ok2,
          coalesce(CASE WHEN label <> 9 THEN label + 2.0 END >= 5, false) AS ok3, coalesce(min(v) >= -0.3, false) AS ok4,
          vec_id % 3 <> 0 AS ok5, count(v) > 0 AS ok6 FROM c GROUP BY vec_id, label)
"""
LIMITS = {"max_flux_outlier": 0.35, "max_neg_flux": 0.3, "require_valid_oiii": True}


@query("clean_spectra", f"WITH {CLEAN_SQL} SELECT vec_id FROM m WHERE ok1 AND ok2 AND ok3 AND ok4 AND ok5 AND ok6")
def cleaned(spark, sf_dir):
    return clean_spectra(cleaning_rows(spark, sf_dir), **LIMITS).select("vec_id")


@query(
    "cleaning_report",
    f"""
    WITH {CLEAN_SQL}
    SELECT count(*) AS original, count(*) FILTER (NOT ok1) AS dropped_coverage, count(*) FILTER (NOT ok2) AS dropped_outlier,
      count(*) FILTER (NOT ok3) AS dropped_snr, count(*) FILTER (NOT ok4) AS dropped_neg_flux,
      count(*) FILTER (NOT ok5) AS dropped_oiii, count(*) FILTER (NOT ok6) AS dropped_finite,
      count(*) FILTER (ok1 AND ok2 AND ok3 AND ok4 AND ok5 AND ok6) AS remaining FROM m
    """,
)
def report(spark, sf_dir):
    assert len(RULES) == 6
    return cleaning_report(cleaning_rows(spark, sf_dir), **LIMITS)


# ---- raw spectra: 100 consecutive events each, so that no group grows with the table


def raw_spectra(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    micro = F.unix_micros(F.col("ts").cast("timestamp")) % 1000000
    wave = 5400.0 + 4.0 * (F.col("event_id") % 100) + micro / 400000.0
    value = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    rows = e.select(
        F.floor(F.col("event_id") / 100).alias("spec_id"), F.struct(wave.alias("wave"), value.alias("flux")).alias("s")
    )
    packed = rows.groupBy("spec_id").agg(F.array_sort(F.collect_list("s")).alias("s"))  # 100 entries
    return packed.select(
        "spec_id",
        F.col("s.wave").alias("wavelength"),
        F.col("s.flux").alias("flux"),
        (F.col("spec_id") % 8 / 1000.0).alias("z"),
    )


RAW_SQL = """
  raw AS (SELECT event_id // 100 AS spec_id, (event_id // 100) % 8 / 1000.0::DOUBLE AS z,
      5400.0 + 4.0 * (event_id % 100) + (epoch_us(ts) % 1000000) / 400000.0 AS wave,
      CASE WHEN event_type <> 'error' THEN value END AS flux FROM events),
  sides AS (SELECT * FROM raw WHERE (wave > 5547.3 AND wave <= 5567.3) OR (wave >= 5587.3 AND wave < 5607.3)),
  stats AS (SELECT spec_id, median(flux) AS med, stddev_pop(flux) AS sd, count(*) AS n,
              list(wave ORDER BY wave) AS xs, list(flux ORDER BY wave) AS ys FROM sides GROUP BY 1),
  peak AS (SELECT spec_id, max(flux) AS peak FROM raw WHERE wave > 5567.3 AND wave < 5587.3 GROUP BY 1),
  hit AS (SELECT stats.* FROM stats JOIN peak USING (spec_id) WHERE n >= 2 AND sd > 0 AND peak > med + 4 * sd),
  idx AS (SELECT r.spec_id, r.wave, xs, ys, greatest(least(len(list_filter(xs, lambda x: x < r.wave)), n - 1), 1) AS i
          FROM raw r JOIN hit USING (spec_id) WHERE r.wave > 5567.3 AND r.wave < 5587.3),
  patch AS (SELECT spec_id, wave, ys[i] + (ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]) * (wave - xs[i]) AS fixed, true AS patched FROM idx),
  repaired AS (SELECT raw.spec_id, z, raw.wave, CASE WHEN patched THEN fixed ELSE flux END AS flux
               FROM raw LEFT JOIN patch ON patch.spec_id = raw.spec_id AND patch.wave = raw.wave)
"""


@query("sky_line_repaired", f"WITH {RAW_SQL} SELECT spec_id, round(wave, 6) AS wave, round(flux, 6) AS flux FROM repaired")
def sky_line(spark, sf_dir):
    df = raw_spectra(spark, sf_dir)
    fixed = spectra.repaired_sky_line("wavelength", "flux")
    out = df.select("spec_id", F.explode(F.arrays_zip("wavelength", fixed.alias("flux"))).alias("s"))
    value = F.col("s.flux")
    return out.select(
        "spec_id", rnd("s.wavelength", 6).alias("wave"), rnd(F.when(~F.isnan(value), value), 6).alias("flux")
    )


@query(
    "rest_frame",
    f"WITH {RAW_SQL} SELECT spec_id, round(wave / (1 + z), 6) AS wave, round(flux * (1 + z), 6) AS flux FROM raw",
)
def rest(spark, sf_dir):
    df = raw_spectra(spark, sf_dir)
    wave, flux = vectors.rest_frame("wavelength", "flux", "z")
    out = df.select("spec_id", F.explode(F.arrays_zip(wave.alias("w"), flux.alias("f"))).alias("s"))
    value = F.col("s.f")
    return out.select(
        "spec_id", rnd("s.w", 6).alias("wave"), rnd(F.when(~F.isnan(value), value), 6).alias("flux")
    )


@query(
    "finite_sorted_samples",
    f"""
    WITH {RAW_SQL}
    SELECT spec_id, row_number() OVER (PARTITION BY spec_id ORDER BY wave) - 1 AS pos, round(wave, 6) AS wave, flux
    FROM raw WHERE flux IS NOT NULL
    """,
)
def finite(spark, sf_dir):
    df = raw_spectra(spark, sf_dir)
    backwards = vectors.finite_sorted(F.reverse("wavelength"), F.reverse("flux"))
    out = df.select("spec_id", F.posexplode(backwards).alias("pos", "s"))
    return out.select("spec_id", F.col("pos").cast("bigint").alias("pos"), rnd("s.wave", 6).alias("wave"), "s.flux")


@query(
    "wavelength_axis",
    """
    WITH px AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
    SELECT vec_id, i AS pos, round(CASE vec_id % 4 WHEN 0 THEN pow(10, 3.6 + i / 1000.0) WHEN 1 THEN 4000.0 + 2 * i
      WHEN 2 THEN pow(10, 3.5 + i * 0.0001) ELSE 3800.0 + i * (1 + label) END, 6) AS value FROM px
    """,
)
def axis(spark, sf_dir):
    kind = F.col("vec_id") % 4
    e = embeddings(spark, sf_dir).select(
        "vec_id",
        "x",
        F.when(kind == 0, F.transform("x", lambda v, i: 3.6 + i / 1000.0)).alias("loglam"),
        F.when(kind == 1, F.transform("x", lambda v, i: 4000.0 + 2 * i)).alias("wavelength"),
        F.when(kind == 2, 3.5).alias("coeff0"),
        F.when(kind == 2, 0.0001).alias("coeff1"),
        F.lit(3800.0).alias("crval1"),
        (F.col("label") + 1.0).alias("cdelt1"),
    )
    wave = vectors.wavelength_axis("x", "loglam", "wavelength", "coeff0", "coeff1", "crval1", "cdelt1")
    return long_vector(e.select("vec_id", wave.alias("w")), ["vec_id"], "w", 6)


GRID = [5395.0 + 6.25 * i for i in range(64)]
GRID_SQL = f"""
  {RAW_SQL},
  rest AS (SELECT spec_id, wave / (1 + z) AS w, flux * (1 + z) AS f FROM repaired),
  grid AS (SELECT pos, 5395.0 + 6.25 * pos AS g FROM generate_series(0, 63) t(pos)),
  want AS (SELECT spec_id, pos, g FROM (SELECT DISTINCT spec_id FROM raw), grid),
  lo AS (SELECT want.spec_id, pos, g, w AS w0, f AS f0 FROM want ASOF JOIN rest ON want.spec_id = rest.spec_id AND want.g >= rest.w),
  hi AS (SELECT want.spec_id, pos, w AS w1, f AS f1 FROM want ASOF JOIN rest ON want.spec_id = rest.spec_id AND want.g <= rest.w),
  gridded AS (SELECT want.spec_id, want.pos, CASE WHEN w1 = w0 THEN f0 ELSE f0 + (f1 - f0) * (lo.g - w0) / (w1 - w0) END AS v
    FROM want LEFT JOIN lo USING (spec_id, pos) LEFT JOIN hi USING (spec_id, pos)),
  filled AS (SELECT spec_id, pos, coalesce(v, median(v) OVER (PARTITION BY spec_id)) AS v, v IS NULL AS gap FROM gridded)
"""


@query("resampled_to_grid", f"WITH {GRID_SQL} SELECT spec_id, pos, round(v, 6) AS value FROM gridded")
def resampled(spark, sf_dir):
    df = raw_spectra(spark, sf_dir)
    wave, flux = vectors.rest_frame("wavelength", spectra.repaired_sky_line("wavelength", "flux"), "z")
    out = df.select("spec_id", spectra.resampled(wave, flux, GRID).alias("g"))
    pixels = out.select("spec_id", F.posexplode("g").alias("pos", "v"))
    return pixels.select("spec_id", F.col("pos").cast("bigint").alias("pos"), rnd(F.when(~F.isnan("v"), F.col("v")), 6).alias("value"))


@query("gaps_filled_with_median", f"WITH {GRID_SQL} SELECT spec_id, pos, round(v, 6) AS value FROM filled")
def gap_fill(spark, sf_dir):
    df = raw_spectra(spark, sf_dir)
    wave, flux = vectors.rest_frame("wavelength", spectra.repaired_sky_line("wavelength", "flux"), "z")
    out = df.select("spec_id", spectra.filled(spectra.resampled(wave, flux, GRID)).alias("g"))
    return long_vector(out, ["spec_id"], "g", 6)


PREPROCESSED_SQL = f"""
    WITH {GRID_SQL},
    single AS (SELECT spec_id, pos, v::FLOAT::DOUBLE AS v FROM filled),
    mirrored AS (SELECT * FROM single UNION ALL SELECT spec_id, -pos, v FROM single WHERE pos BETWEEN 1 AND 3
                 UNION ALL SELECT spec_id, 126 - pos, v FROM single WHERE pos BETWEEN 60 AND 62),
    means AS (SELECT spec_id, pos, avg(v) OVER (PARTITION BY spec_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m
              FROM mirrored),
    gaps AS (SELECT spec_id, count(*) FILTER (gap) AS n_filled FROM filled GROUP BY 1)
    SELECT spec_id, pos, n_filled, round((v - m) * least(least(pos, 63 - pos) / 4.0, 1.0)::DOUBLE, 2) + 0.0 AS value
    FROM single JOIN means USING (spec_id, pos) JOIN gaps USING (spec_id)
"""


@query("preprocessed_spectra", PREPROCESSED_SQL)
def preprocessed(spark, sf_dir):
    df = raw_spectra(spark, sf_dir).select(
        F.col("spec_id").cast("string").alias("filename"),
        F.lit(1).alias("agn_type"),
        "z",
        F.lit(10.0).alias("snr"),
        "wavelength",
        "flux",
    )
    done = preprocess_spectra(df, GRID, WINDOW)
    pixels = done.select(F.col("filename").cast("bigint").alias("spec_id"), "n_filled", F.posexplode("flux").alias("pos", "v"))
    return pixels.select("spec_id", F.col("pos").cast("bigint").alias("pos"), F.col("n_filled").cast("bigint").alias("n_filled"), rnd("v", 2).alias("value"))


def full_spectra(spark, sf_dir):
    """Samples at places of one Angstrom, gaps included, from the lines of neighbouring orders."""
    place = (F.col("l_orderkey") * 7 + F.col("l_linenumber") - 1).alias("place")
    # the generated keys repeat
    lines = table(spark, sf_dir, "lineitem").groupBy(place).agg(F.min("l_quantity").alias("q"))
    value, place = F.when(F.col("q") == 13, F.lit(float("nan"))).otherwise(F.col("q")), F.col("place")
    rows = lines.select(
        F.floor(place / 2625).alias("spec_id"), F.struct((4400.0 + place % 2625).alias("wave"), value.alias("flux")).alias("s")
    )
    packed = rows.groupBy("spec_id").agg(F.array_sort(F.collect_list("s")).alias("s"))  # at most 2,625 entries
    return packed.select(
        F.col("spec_id").cast("string").alias("filename"), F.lit(1).alias("agn_type"), (F.col("spec_id") % 8 / 1000.0).alias("z"),
        F.lit(10.0).alias("snr"), F.col("s.wave").alias("wavelength"), F.col("s.flux").alias("flux"),
    )


FULL_RAW_SQL = """
  raw AS (SELECT p // 2625 AS spec_id, (p // 2625) % 8 / 1000.0::DOUBLE AS z, 4400.0::DOUBLE + p % 2625 AS wave,
      CASE WHEN q <> 13 THEN q END AS flux
      FROM (SELECT l_orderkey * 7 + l_linenumber - 1 AS p, min(l_quantity) AS q FROM lineitem GROUP BY 1)),
"""
FULL_GRID_SQL = (
    GRID_SQL.replace(RAW_SQL, FULL_RAW_SQL + RAW_SQL[RAW_SQL.index("  sides AS") :])
    .replace("5395.0 + 6.25 * pos", "4575.0::DOUBLE + pos * (2124.0::DOUBLE / 1023)")
    .replace("generate_series(0, 63)", "generate_series(0, 1023)")
)


@query(
    "preprocessed_spectra_full_grid",
    f"""
    WITH {FULL_GRID_SQL},
    single AS (SELECT spec_id, pos, v::FLOAT::DOUBLE AS v FROM filled),
    mirrored AS (SELECT * FROM single UNION ALL SELECT spec_id, -pos, v FROM single WHERE pos BETWEEN 1 AND 75
                 UNION ALL SELECT spec_id, 2046 - pos, v FROM single WHERE pos BETWEEN 948 AND 1022),
    means AS (SELECT spec_id, pos, avg(v) OVER (PARTITION BY spec_id ORDER BY pos ROWS BETWEEN 75 PRECEDING AND 75 FOLLOWING) AS m
              FROM mirrored),
    gaps AS (SELECT spec_id, count(*) FILTER (gap) AS n_filled FROM filled GROUP BY 1)
    SELECT spec_id, pos, n_filled, round((v - m) * least(least(pos, 1023 - pos) / 4.0, 1.0)::DOUBLE, 2) + 0.0 AS value
    FROM single JOIN means USING (spec_id, pos) JOIN gaps USING (spec_id)
    """,
)
def preprocessed_full(spark, sf_dir):
    """The default grid of 1,024 pixels and the default window of 151."""
    done = preprocess_spectra(full_spectra(spark, sf_dir))
    pixels = done.select(F.col("filename").cast("bigint").alias("spec_id"), "n_filled", F.posexplode("flux").alias("pos", "v"))
    return pixels.select("spec_id", F.col("pos").cast("bigint").alias("pos"), F.col("n_filled").cast("bigint").alias("n_filled"), rnd("v", 2).alias("value"))



@query(
    "pair_diagnosis",
    f"""
    WITH {MAD}, n AS (SELECT count(*) AS n FROM embeddings),
    one AS (SELECT vec_id, any_value(med) AS med, any_value(mad) AS mad FROM mad GROUP BY 1),
    side AS (SELECT vec_id, avg(abs(f)) FILTER ({WAVE_SQL} BETWEEN 4797.8 AND 4840 OR {WAVE_SQL} BETWEEN 4885 AND 4927.5) AS hb_wing,
        avg(abs(x)) FILTER ({WAVE_SQL} BETWEEN 6477.1 AND 6535 OR {WAVE_SQL} BETWEEN 6600 AND 6652.1) AS ha_ind_wing,
        max(f) FILTER ({WAVE_SQL} BETWEEN 6300 AND 6699) - median(f) AS ha_peak,
        max(x) FILTER ({WAVE_SQL} BETWEEN 4700 AND 5100) - median(x) AS hb_ind_peak FROM ind GROUP BY vec_id)
    SELECT a.vec_id AS sdssid, round(oa.med, 8) + 0.0 AS dr16_ind_median, round(ob.mad, 8) AS sdssv_ind_mad,
      round(greatest(oa.mad, ob.mad) / (least(oa.mad, ob.mad) + 1e-8), 5) AS mad_ratio_max_over_min,
      round(a.hb_wing, 8) AS hb_flat_wing_dr16, round(b.ha_ind_wing, 6) AS ha_ind_wing_sdssv,
      round(b.ha_peak, 8) AS ha_flat_peak_sdssv, round(a.hb_ind_peak, 6) AS hb_ind_peak_dr16
    FROM side a, n JOIN side b ON b.vec_id = (a.vec_id + 1) % n JOIN one oa ON oa.vec_id = a.vec_id JOIN one ob ON ob.vec_id = b.vec_id
    """,
)
def diagnosis(spark, sf_dir):
    pairs = neighbour_pairs(spark, sf_dir).select(
        F.col("vec_id").alias("sdssid"), F.col("x").alias("raw_1"), F.col("y").alias("raw_2")
    )
    df = diagnose_pairs(pairs, WAVE, WINDOW)
    digits = {
        "dr16_ind_median": 8,
        "sdssv_ind_mad": 8,
        "mad_ratio_max_over_min": 5,
        "hb_flat_wing_dr16": 8,
        "ha_ind_wing_sdssv": 6,
        "ha_flat_peak_sdssv": 8,
        "hb_ind_peak_dr16": 6,
    }
    return df.select("sdssid", *[rnd(c, d).alias(c) for c, d in digits.items()])


# 64 pixels from 4680 in steps of 40, which fill all bands of both lines
WIDE = [4680.0 + 40.0 * i for i in range(64)]
WIDE_SQL = "4680.0 + 40.0 * pos"
BOTH_FLUXES_SQL = """
  w AS (SELECT vec_id, pos, v, 4680.0 + 40.0 * pos AS wave FROM px),
  c AS (SELECT vec_id, median(v) FILTER (wave BETWEEN 4670 AND 4730) AS hb_blue, median(v) FILTER (wave BETWEEN 5080 AND 5120) AS hb_red,
      median(v) FILTER (wave BETWEEN 6150 AND 6250) AS ha_blue, median(v) FILTER (wave BETWEEN 6950 AND 7150) AS ha_red FROM w GROUP BY vec_id),
  d AS (SELECT vec_id, 'hb' AS line, wave, v - (hb_blue + (hb_red - hb_blue) * (wave - 4700) / 400.0) AS d FROM w JOIN c USING (vec_id)
          WHERE wave BETWEEN 4797.8 AND 4927.5
        UNION ALL SELECT vec_id, 'ha', wave, v - (ha_blue + (ha_red - ha_blue) * (wave - 6200) / 850.0) FROM w JOIN c USING (vec_id)
          WHERE wave BETWEEN 6477.1 AND 6652.1),
  step AS (SELECT vec_id, line, (d + lead(d) OVER o) / 2 * (lead(wave) OVER o - wave) AS s FROM d
           WINDOW o AS (PARTITION BY vec_id, line ORDER BY wave)),
  lf AS (SELECT vec_id, sum(s) FILTER (line = 'hb') AS hb, sum(s) FILTER (line = 'ha') AS ha FROM step GROUP BY vec_id)
"""


@query("line_flux_both_lines", f"WITH {PIXELS}, {BOTH_FLUXES_SQL} SELECT vec_id, round(hb, 6) + 0.0 AS hb, round(ha, 6) + 0.0 AS ha FROM lf")
def both_line_fluxes(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    return df.select("vec_id", *[rnd(spectra.line_flux("x", WIDE, line), 6).alias(line) for line in ("hb", "ha")])


def _measured_sql():
    """Every field of a diagnosis: what one vector gives, then what a pair's common scale gives."""
    wing = {
        "hb": f"({WIDE_SQL} BETWEEN 4797.8 AND 4840 OR {WIDE_SQL} BETWEEN 4885 AND 4927.5)",
        "ha": f"({WIDE_SQL} BETWEEN 6477.1 AND 6535 OR {WIDE_SQL} BETWEEN 6600 AND 6652.1)",
    }
    peak = {"hb": f"({WIDE_SQL} BETWEEN 4700 AND 5100)", "ha": f"({WIDE_SQL} BETWEEN 6300 AND 6699)"}
    alone = [f"avg(abs({x})) FILTER {wing[n]} AS {n}_{kind}_wing" for kind, x in (("flat", "f"), ("ind", "x")) for n in wing]
    alone += [f"max({x}) FILTER {peak[n]} - median({x}) AS {n}_{kind}_peak" for kind, x in (("flat", "f"), ("ind", "x")) for n in peak]
    out = []
    for side, t in (("dr16", "a"), ("sdssv", "b")):
        out += [f"round({t}.med, 8) + 0.0 AS {side}_ind_median", f"round({t}.mad, 8) AS {side}_ind_mad"]
        for n in wing:
            out.append(f"round({t}.{n}, 6) + 0.0 AS {n}_paper_flux_{side}")
            out.append(f"round({t}.{n}_flat_wing, 8) AS {n}_flat_wing_{side}, round({t}.{n}_ind_wing, 5) AS {n}_ind_wing_{side}")
            out.append(f"round({t}.{n}_flat_peak, 8) AS {n}_flat_peak_{side}, round({t}.{n}_ind_peak, 5) AS {n}_ind_peak_{side}")
            out.append(f"round(p.{n}_{side}, 5) AS {n}_pair_wing_{side}")
    ratio = lambda x, y: f"greatest(abs({x}), abs({y})) / (least(abs({x}), abs({y})) + 1e-8)"
    # flux ratios can be as large as the smaller flux is small: their logarithm is compared
    out += [f"round(ln({ratio(f'a.{n}', f'b.{n}')}), 4) + 0.0 AS {n}_paper_flux_ratio" for n in wing]
    pair = [f"avg(abs(x)) FILTER (side = '{s}' AND {wing[n]}) AS {n}_{s}" for n in wing for s in ("dr16", "sdssv")]
    return f"""
    WITH {MAD}, {BOTH_FLUXES_SQL}, n AS (SELECT count(*) AS n FROM embeddings),
    one AS (SELECT vec_id, any_value(med) AS med, any_value(mad) AS mad FROM mad GROUP BY 1),
    v1 AS (SELECT vec_id, {", ".join(alone)} FROM ind GROUP BY vec_id),
    v AS (SELECT * FROM v1 JOIN one USING (vec_id) JOIN lf USING (vec_id)),
    pr AS (SELECT vec_id AS id, vec_id, 'dr16' AS side FROM embeddings UNION ALL SELECT vec_id, (vec_id + 1) % n, 'sdssv' FROM embeddings, n),
    pf AS (SELECT id, side, pos, f FROM pr JOIN flat USING (vec_id)),
    pmed AS (SELECT id, quantile_disc(f, 0.5) AS med FROM pf GROUP BY id),
    pmad AS (SELECT id, any_value(med) AS med, quantile_disc(abs(f - med), 0.5) AS mad FROM pf JOIN pmed USING (id) GROUP BY id),
    px2 AS (SELECT id, side, pos, (f - med) / (mad * 1.4826 + 1e-8) * t AS x FROM pf JOIN pmad USING (id) JOIN taper USING (pos)),
    p AS (SELECT id, {", ".join(pair)} FROM px2 GROUP BY id)
    SELECT a.vec_id AS sdssid, a.label::DOUBLE AS z, a.label AS true_label, a.label / 10.0::DOUBLE AS prob_change,
      round(s.med, 8) + 0.0 AS pair_shared_median, round(s.mad, 8) AS pair_shared_mad,
      round({ratio("a.mad", "b.mad")}, 5) AS mad_ratio_max_over_min, {", ".join(out)}
    FROM (SELECT v.*, label FROM v JOIN embeddings USING (vec_id)) a, n JOIN v b ON b.vec_id = (a.vec_id + 1) % n
      JOIN pmad s ON s.id = a.vec_id JOIN p ON p.id = a.vec_id
    """


@query("pair_diagnosis_all_fields", _measured_sql())
def diagnosis_all_fields(spark, sf_dir):
    """All 37 fields, on a grid that fills every band."""
    pairs = neighbour_pairs(spark, sf_dir).select(
        F.col("vec_id").alias("sdssid"), F.col("label").cast("double").alias("z"), F.col("label").alias("true_label"),
        (F.col("label") / 10.0).alias("prob_change"), F.col("x").alias("raw_1"), F.col("y").alias("raw_2"),
    )
    df = diagnose_pairs(pairs, WIDE, WINDOW)
    assert len(df.columns) == 37
    digits = lambda c: 6 if "paper_flux_" in c else 5 if c == "mad_ratio_max_over_min" or "pair_wing" in c or "_ind_wing" in c or "_ind_peak" in c else 8
    value = lambda c: rnd(F.log(F.col(c)), 4) if c.endswith("flux_ratio") else rnd(c, digits(c))
    kept = ["sdssid", "z", "true_label", "prob_change"]
    return df.select(*kept, *[value(c).alias(c) for c in df.columns if c not in kept])
