"""Line fluxes, luminosities, flags and losses on lineitem, part, customer and orders."""

from pyspark.sql import functions as F

from spectraloom.functions.cosmology import luminosity_distance_mpc
from spectraloom.functions.lines import (
    common_line_flux,
    flux_from_luminosity,
    line_column_counts,
    luminosity_from_flux,
    quality_flags,
    safe_ratio,
    standardize_line_columns,
    usable_flag,
)
from spectraloom.functions.missing import nan_to_null
from spectraloom.functions.scores import decide, focal_loss, sigmoid
from spectraloom.settings import QualityLimits

from .registry import query, rnd, table

KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
KEY_SQL = ", ".join(KEYS)

# 4 pi d_L^2 in cm^2 per distinct discount, by Simpson's rule with 1,000 intervals
AREA_SQL = """
  zs AS (SELECT DISTINCT l_discount AS z FROM lineitem WHERE l_discount > 0),
  steps AS (SELECT i, CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w
            FROM generate_series(0, 1000) s(i)),
  area AS (
    SELECT z, 4 * pi() * pow((1 + z) * 299792.458 / 70.0 * z / 3000.0
               * sum(w / sqrt(0.3 * pow(1 + z * i / 1000.0, 3) + 0.7)) * 3.085677581491367e24, 2) AS a
    FROM zs, steps GROUP BY z)
"""


def line_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        *KEYS,
        F.col("l_discount").alias("z"),
        F.col("l_extendedprice").alias("OIII_FLUX"),
        F.col("l_quantity").alias("OIII_FLUX_ERR"),
        "l_tax",
    )


@query(
    "luminosity_distance",
    """
    WITH steps AS (SELECT i, CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w
                   FROM generate_series(0, 1000) s(i)),
    p AS (SELECT p_partkey, p_retailprice / 4000.0 AS z FROM part)
    SELECT p_partkey, round((1 + z) * 299792.458 / 70.0 * z / 3000.0
             * sum(w / sqrt(0.3 * pow(1 + z * i / 1000.0, 3) + 0.7)), 5) AS distance_mpc
    FROM p, steps GROUP BY p_partkey, z
    """,
)
def luminosity_distance(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 4000.0).alias("z"))
    return part.select("p_partkey", rnd(luminosity_distance_mpc("z"), 5).alias("distance_mpc"))


@query(
    "luminosity_from_line_flux",
    f"""
    WITH {AREA_SQL}
    SELECT {KEY_SQL},
      round(CASE WHEN l_extendedprice > 0 THEN a * l_extendedprice * 1e-17 END / 1e40, 4) AS lum_e40,
      round(CASE WHEN l_extendedprice > 0 AND l_quantity > 0 THEN a * l_quantity * 1e-17 END / 1e38, 4) AS lum_err_e38,
      round(CASE WHEN l_extendedprice > 0 THEN log10(a * l_extendedprice * 1e-17) END, 8) AS log_lum,
      round(CASE WHEN a IS NOT NULL AND l_extendedprice > 0 AND l_quantity > 0
                 THEN l_extendedprice / l_quantity END, 9) AS snr
    FROM lineitem LEFT JOIN area ON z = l_discount
    """,
)
def luminosity_from_line_flux(spark, sf_dir):
    df = luminosity_from_flux(line_rows(spark, sf_dir))
    return df.select(
        *KEYS,
        rnd(F.col("OIII_LUM") / 1e40, 4).alias("lum_e40"),
        rnd(F.col("OIII_LUM_ERR") / 1e38, 4).alias("lum_err_e38"),
        rnd("LOG_OIII_LUM", 8).alias("log_lum"),
        rnd("OIII_SNR", 9).alias("snr"),
    )


@query(
    "line_flux_from_luminosity",
    f"""
    WITH {AREA_SQL},
    f AS (SELECT {KEY_SQL},
      CASE WHEN a IS NOT NULL THEN l_extendedprice * 1e37 / a / 1e-17 END AS flux,
      CASE WHEN a IS NOT NULL AND l_quantity > 10 THEN (l_quantity - 10) * 1e36 / a / 1e-17 END AS err
      FROM lineitem LEFT JOIN area ON z = l_discount)
    SELECT {KEY_SQL}, round(flux, 5) AS flux, round(err, 5) AS err,
           round(CASE WHEN err > 0 THEN flux / err END, 6) AS snr
    FROM f
    """,
)
def line_flux_from_luminosity(spark, sf_dir):
    df = line_rows(spark, sf_dir).select(
        *KEYS,
        "z",
        (F.col("OIII_FLUX") * 1e37).alias("OIII_LUM"),
        ((F.col("OIII_FLUX_ERR") - 10) * 1e36).alias("OIII_LUM_ERR"),
    )
    return flux_from_luminosity(df).select(
        *KEYS,
        rnd("OIII_FLUX", 5).alias("flux"),
        rnd("OIII_FLUX_ERR", 5).alias("err"),
        rnd("OIII_SNR", 6).alias("snr"),
    )


def alias_rows(spark, sf_dir):
    """Catalogue spellings with gaps of every kind."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(size % 10 == 1, -1.0).when(size % 5 != 0, price / 25.0).alias("LOGL_OIII_5007"),
        F.when(size % 3 != 0, size / 100.0 - 0.05).alias("ERR_LOGL_OIII"),
        F.when(size % 2 == 0, price * 1e38).alias("OIII_5007_LUM"),
        F.when(size % 7 != 0, price * 1e36).alias("ERR_OIII_LUM"),
        size.cast("double").alias("EW_OIII_5007"),
    )


ALIAS_SQL = """
  raw AS (SELECT p_partkey,
      CASE WHEN p_size % 10 = 1 THEN -1.0 WHEN p_size % 5 <> 0 THEN p_retailprice / 25.0 END AS ll,
      CASE WHEN p_size % 3 <> 0 THEN p_size / 100.0 - 0.05 END::DOUBLE AS ell,
      CASE WHEN p_size % 2 = 0 THEN p_retailprice * 1e38 END AS lum0,
      CASE WHEN p_size % 7 <> 0 THEN p_retailprice * 1e36 END AS el0,
      p_size::DOUBLE AS ew FROM part),
  a AS (SELECT *, CASE WHEN ll > 0 THEN pow(10, ll) ELSE lum0 END AS lum FROM raw),
  b AS (SELECT *, CASE WHEN ll IS NULL AND lum > 0 THEN log10(lum) ELSE ll END AS log_lum,
          CASE WHEN ell > 0 AND lum > 0 THEN ln(10) * lum * ell ELSE el0 END AS lum_err FROM a),
  std AS (SELECT *, CASE WHEN ell IS NULL AND lum_err > 0 AND lum > 0 THEN lum_err / (ln(10) * lum)
          ELSE ell END AS log_err FROM b)
"""


@query(
    "standard_line_columns",
    f"""
    WITH {ALIAS_SQL}
    SELECT p_partkey, round(log_lum, 8) AS log_lum, round(log_err, 8) AS log_err,
           round(log10(lum), 8) AS lum, round(log10(lum_err), 8) AS lum_err, ew AS "OIII_EW",
           NULL::DOUBLE AS "OIII_SIGMA"
    FROM std
    """,
)
def standard_line_columns(spark, sf_dir):
    df = standardize_line_columns(alias_rows(spark, sf_dir))
    return df.select(
        "p_partkey",
        rnd("LOG_OIII_LUM", 8).alias("log_lum"),
        rnd("LOG_OIII_LUM_ERR", 8).alias("log_err"),
        rnd(F.log10("OIII_LUM"), 8).alias("lum"),
        rnd(F.log10("OIII_LUM_ERR"), 8).alias("lum_err"),
        "OIII_EW",
        "OIII_SIGMA",
    )


@query(
    "line_column_counts",
    f"""
    WITH {ALIAS_SQL}
    SELECT count(log_lum) AS "LOG_OIII_LUM", count(log_err) AS "LOG_OIII_LUM_ERR",
           count(lum) AS "OIII_LUM", count(lum_err) AS "OIII_LUM_ERR" FROM std
    """,
)
def line_counts(spark, sf_dir):
    return line_column_counts(standardize_line_columns(alias_rows(spark, sf_dir)))


def mixed_flux_rows(spark, sf_dir):
    n = F.col("l_linenumber")
    return line_rows(spark, sf_dir).select(
        *KEYS,
        "z",
        F.when(n % 3 == 0, None).when(n % 3 == 1, F.col("OIII_FLUX")).otherwise(-F.col("OIII_FLUX")).alias("OIII_FLUX"),
        F.when(n % 2 == 0, 38 + F.col("l_tax") * 10).alias("LOG_OIII_LUM"),
    )


@query(
    "common_line_flux",
    f"""
    WITH {AREA_SQL},
    m AS (SELECT {KEY_SQL}, a,
        CASE WHEN l_linenumber % 3 = 1 THEN l_extendedprice WHEN l_linenumber % 3 = 2 THEN -l_extendedprice END AS flux,
        CASE WHEN l_linenumber % 2 = 0 THEN pow(10, 38 + l_tax * 10) END AS lum
      FROM lineitem LEFT JOIN area ON z = l_discount),
    c AS (SELECT *, CASE WHEN flux > 0 THEN flux * 1e-17 WHEN a IS NOT NULL AND lum > 0 THEN lum / a END AS cgs,
        CASE WHEN flux > 0 THEN 'catalog_flux' WHEN a IS NOT NULL AND lum > 0 THEN 'luminosity_converted'
             ELSE 'missing' END AS source FROM m)
    SELECT {KEY_SQL}, round(cgs * 1e17, 5) AS cgs_e17, source, (cgs IS NOT NULL AND cgs > 0)::INT AS usable FROM c
    """,
)
def common_flux(spark, sf_dir):
    df = common_line_flux(mixed_flux_rows(spark, sf_dir))
    return df.select(
        *KEYS,
        rnd(F.col("OIII_FLUX_CGS") * 1e17, 5).alias("cgs_e17"),
        F.col("OIII_FLUX_SOURCE").alias("source"),
        F.col("OIII_USABLE").cast("int").alias("usable"),
    )


def flag_rows(spark, sf_dir):
    q = F.col("OIII_FLUX_ERR")
    n = F.col("l_linenumber")
    lum = luminosity_from_flux(line_rows(spark, sf_dir))
    return lum.withColumns(
        {
            "OIII_FLUX": F.when(F.col("l_partkey") % 11 == 0, None)
            .when(F.col("l_partkey") % 13 == 0, -F.col("OIII_FLUX"))
            .otherwise(F.col("OIII_FLUX")),
            "OIII_FLUX_ERR": F.when(F.col("l_partkey") % 17 == 0, None)
            .when(F.col("l_partkey") % 19 == 0, F.lit(0.0))
            .when(n == 7, q * 999)
            .otherwise(q),
            "OIII_LUM": F.when(n == 6, F.col("OIII_LUM") * 1e-6).when(n == 5, F.col("OIII_LUM") * 1e5).otherwise(
                F.col("OIII_LUM")
            ),
            "OIII_SIGMA": q * 30,
            "OIII_VOFF": F.when(F.col("l_suppkey") % 5 != 0, (F.col("l_suppkey") % 60 - 25) * 40.0),
            "OIII_CHI2": F.col("l_tax") * 100,
        }
    )


FLAG_SQL = f"""
  base AS (SELECT {KEY_SQL}, l_tax, l_quantity, a,
      CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 13 = 0 THEN -l_extendedprice ELSE l_extendedprice END AS flux,
      CASE WHEN l_partkey % 17 = 0 THEN NULL WHEN l_partkey % 19 = 0 THEN 0.0
           WHEN l_linenumber = 7 THEN l_quantity * 999 ELSE l_quantity END AS err,
      a * l_extendedprice * 1e-17 * CASE WHEN l_linenumber = 6 THEN 1e-6 WHEN l_linenumber = 5 THEN 1e5 ELSE 1 END AS lum,
      a * l_quantity * 1e-17 AS lum_err,
      CASE WHEN a IS NOT NULL THEN l_extendedprice / l_quantity END AS snr0,
      l_quantity * 30 AS sigma,
      CASE WHEN l_suppkey % 5 <> 0 THEN (l_suppkey % 60 - 25) * 40.0 END AS voff,
      l_tax * 100 AS chi2
    FROM lineitem LEFT JOIN area ON z = l_discount),
  s AS (SELECT *, CASE WHEN flux IS NOT NULL AND err > 0 THEN flux / err ELSE snr0 END AS snr FROM base),
  flagged AS (SELECT *, CASE
      WHEN chi2 > 7.5 THEN 'chi2_too_high' WHEN abs(voff) > 1000 THEN 'voff_too_large'
      WHEN sigma > 1000 THEN 'sigma_too_high' WHEN sigma <= 30 THEN 'sigma_too_low'
      WHEN lum_err <= 0 THEN 'non_positive_lum_err' WHEN lum > 1e45 THEN 'too_high_lum'
      WHEN lum < 1e38 THEN 'too_low_lum' WHEN lum <= 0 THEN 'non_positive_lum' WHEN lum IS NULL THEN 'missing_lum'
      WHEN snr < 5 THEN 'low_snr' WHEN snr IS NULL THEN 'missing_snr' WHEN err <= 0 THEN 'non_positive_flux_err'
      WHEN err IS NULL THEN 'missing_flux_err' WHEN flux <= 0 THEN 'non_positive_flux'
      WHEN flux IS NULL THEN 'missing_flux' ELSE 'valid' END AS flag FROM s)
"""
FLAG_LIMITS = QualityLimits(max_chi2=7.5)


@query(
    "line_quality_flags",
    f"""
    WITH {AREA_SQL}, {FLAG_SQL}
    SELECT {KEY_SQL}, flag AS quality_flag, (flag = 'valid')::INT AS valid, round(snr, 9) AS snr FROM flagged
    """,
)
def flags(spark, sf_dir):
    df = quality_flags(flag_rows(spark, sf_dir), FLAG_LIMITS)
    return df.select(
        *KEYS,
        F.col("OIII_QUALITY_FLAG").alias("quality_flag"),
        F.col("OIII_VALID").cast("int").alias("valid"),
        rnd("OIII_SNR", 9).alias("snr"),
    )


@query(
    "quality_flag_counts",
    f"""
    WITH {AREA_SQL}, {FLAG_SQL}
    SELECT flag AS quality_flag, count(*) AS n, count(snr) AS n_snr FROM flagged GROUP BY flag
    """,
)
def flag_counts(spark, sf_dir):
    df = quality_flags(nan_to_null(flag_rows(spark, sf_dir)), FLAG_LIMITS)
    return df.groupBy(F.col("OIII_QUALITY_FLAG").alias("quality_flag")).agg(
        F.count("*").alias("n"), F.count("OIII_SNR").alias("n_snr")
    )


@query(
    "usable_line_flag",
    """
    SELECT o_orderkey,
      (lower(o_orderpriority) IN ('1-urgent', 'true', '1', 'yes'))::INT AS other,
      (CASE o_orderstatus WHEN 'F' THEN 'TRUE' WHEN 'O' THEN 'no' ELSE 'Yes' END IN ('TRUE', 'Yes'))::INT AS usable,
      (o_totalprice > 250000)::INT AS by_flux
    FROM orders
    """,
)
def usable(spark, sf_dir):
    status = F.col("o_orderstatus")
    words = F.when(status == "F", "TRUE").when(status == "O", "no").otherwise("Yes")
    df = table(spark, sf_dir, "orders").withColumn("OIII_USABLE", words)
    flux = df.drop("OIII_USABLE").withColumn("OIII_FLUX_CGS", (F.col("o_totalprice") - 250000) * 1e-17)
    by_flux = flux.select("o_orderkey", usable_flag(flux).cast("int").alias("by_flux"))
    text = df.select(
        "o_orderkey",
        F.lower("o_orderpriority").isin("1-urgent", "true", "1", "yes").cast("int").alias("other"),
        usable_flag(df).cast("int").alias("usable"),
    )
    return text.join(by_flux, "o_orderkey")


@query(
    "safe_ratio",
    """
    SELECT c_custkey, round(greatest(abs(c_acctbal), abs(c_nationkey - 12.0))
             / (least(abs(c_acctbal), abs(c_nationkey - 12.0)) + 1e-8), 4) AS ratio
    FROM customer WHERE c_nationkey <> 12
    UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_nationkey = 12
    """,
)
def ratio(spark, sf_dir):
    other = F.when(F.col("c_nationkey") == 12, F.lit(float("inf"))).otherwise(F.col("c_nationkey") - 12.0)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", rnd(safe_ratio(F.col("c_acctbal"), other), 4).alias("ratio")
    )


@query(
    "sigmoid_decision",
    """
    SELECT o_orderkey, round(1 / (1 + exp(-(o_totalprice - 250000) / 50000)), 9) AS prob,
           (1 / (1 + exp(-(o_totalprice - 250000) / 50000)) >= 0.5)::INT AS pred FROM orders
    """,
)
def sigmoid_decision(spark, sf_dir):
    prob = sigmoid((F.col("o_totalprice") - 250000) / 50000)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", rnd(prob, 9).alias("prob"), decide(prob).alias("pred")
    )


FOCAL_SQL = """
  x AS (SELECT o_orderkey, o_orderpriority, (o_totalprice - 250000) / 50000 AS x,
               CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS t FROM orders),
  p AS (SELECT *, 1 / (1 + exp(-x)) AS p FROM x),
  loss AS (SELECT *, (t * 0.25 + (1 - t) * 0.75) * pow(1 - (p * t + (1 - p) * (1 - t)), 2)
             * -(t * ln(p) + (1 - t) * ln(1 - p)) AS loss FROM p)
"""


@query("focal_loss", f"WITH {FOCAL_SQL} SELECT o_orderkey, round(loss, 8) AS loss FROM loss")
def focal(spark, sf_dir):
    return _focal_rows(spark, sf_dir).select("o_orderkey", rnd("loss", 8).alias("loss"))


@query(
    "focal_loss_reduced",
    f"""
    WITH {FOCAL_SQL}
    SELECT o_orderpriority, round(avg(loss), 8) AS mean_loss, round(sum(loss), 4) AS sum_loss
    FROM loss GROUP BY o_orderpriority
    """,
)
def focal_reduced(spark, sf_dir):
    return _focal_rows(spark, sf_dir).groupBy("o_orderpriority").agg(
        rnd(F.avg("loss"), 8).alias("mean_loss"), rnd(F.sum("loss"), 4).alias("sum_loss")
    )


def _focal_rows(spark, sf_dir):
    logit = (F.col("o_totalprice") - 250000) / 50000
    target = (F.col("o_orderstatus") == "F").cast("int")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", focal_loss(logit, target).alias("loss")
    )
