"""Catalogue selections, naming and column handling on customer, part, orders and pages."""

from pyspark.sql import functions as F

from spectraloom.functions.missing import nan_to_null
from spectraloom.functions.naming import archive_url, legacy_filename, resolve_path, run_name, spectrum_filename
from spectraloom.operators.joins import side_by_side
from spectraloom.operators.select import redshift_window, select_type1, select_type2, split_processed, two_line_snr
from spectraloom.operators.shape import (
    array_to_long,
    array_to_wide,
    class_target,
    decode_strings,
    keep_renamed,
    spectrum_by_filename,
    spectrum_by_ordinal,
    wide_to_array,
)
from spectraloom.operators.split import scaled_redshift
from spectraloom.plans.candidates import (
    TYPE1_KEYS,
    download_manifest,
    download_status,
    find_candidates,
    type1_candidates,
    type2_candidates,
    unique_targets,
)
from spectraloom.session import scratch_path
from spectraloom.sources.results import write_lookup_catalogue
from spectraloom.sources.tables import checked_manifest, scalar_columns

from .registry import query, rnd, table


def quasars(spark, sf_dir):
    """customer as a quasar table with missing values of both kinds."""
    c = table(spark, sf_dir, "customer")
    hb = F.when(F.col("c_custkey") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal") / 500)
    return c.select(
        F.col("c_custkey").alias("row_idx"),
        F.encode(F.concat(F.lit("  "), F.col("c_name"), F.lit(" \t")), "UTF-8").alias("SDSS_NAME"),
        (F.col("c_custkey") % 360).cast("double").alias("RA"),
        F.col("c_nationkey").cast("double").alias("DEC"),
        (F.abs("c_acctbal") / 15000).alias("REDSHIFT"),
        (F.col("c_custkey") % 9000 + 51000).cast("int").alias("MJD"),
        (F.col("c_custkey") * 37 % 120000).cast("int").alias("PLATE"),
        (F.col("c_nationkey") * 41 + 1).cast("int").alias("FIBER"),
        (F.col("c_nationkey") % 3).alias("BAL_FLAG"),
        hb.alias("LINE_MED_SN_HB"),
        F.when(F.col("c_custkey") % 7 == 0, None).otherwise(F.col("c_nationkey") - 5.0).alias("LINE_MED_SN_HA"),
        (F.col("c_acctbal") / 1000 + 35).alias("LOGL_OIII_5007"),
        F.when(F.col("c_custkey") % 4 != 0, F.lit(0.05)).alias("LOGL_OIII_5007_ERR"),
        F.array(F.lit(1.0)).alias("ALL_FLUXES"),
    )


QUASAR_SQL = """
  quasar AS (SELECT c_custkey AS row_idx, c_name, (c_custkey % 360)::DOUBLE AS ra, c_nationkey::DOUBLE AS dec,
      abs(c_acctbal) / 15000 AS z, (c_custkey % 9000 + 51000)::INT AS mjd, (c_custkey * 37 % 120000)::INT AS plate,
      (c_nationkey * 41 + 1)::INT AS fiber, c_nationkey % 3 AS bal,
      CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal / 500 END AS hb,
      CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey - 5.0 END::DOUBLE AS ha,
      c_acctbal / 1000 + 35 AS log_lum, CASE WHEN c_custkey % 4 <> 0 THEN 0.05 END::DOUBLE AS log_err
    FROM customer),
  strong AS (SELECT * FROM quasar WHERE (hb <= 0 OR hb >= 5) AND (ha <= 0 OR ha >= 5) AND (hb >= 5 OR ha >= 5))
"""


@query("two_line_snr_rule", f"WITH {QUASAR_SQL} SELECT row_idx, round(hb, 6) AS hb, ha FROM strong")
def two_lines(spark, sf_dir):
    df = quasars(spark, sf_dir).filter(two_line_snr("LINE_MED_SN_HB", "LINE_MED_SN_HA", 5))
    return df.select("row_idx", rnd("LINE_MED_SN_HB", 6).alias("hb"), F.col("LINE_MED_SN_HA").alias("ha"))


@query("type1_selection", f"WITH {QUASAR_SQL} SELECT row_idx, round(z, 8) AS z FROM strong WHERE bal = 0 AND z < 0.4")
def type1_selection(spark, sf_dir):
    df = select_type1(quasars(spark, sf_dir), 0.4, 5)
    return df.select("row_idx", rnd("REDSHIFT", 8).alias("z"))


@query(
    "type1_candidates",
    f"""
    WITH {QUASAR_SQL},
    sel AS (SELECT * FROM strong WHERE bal = 0 AND z < 0.4),
    steps AS (SELECT i, CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w
              FROM generate_series(0, 1000) s(i)),
    area AS (SELECT row_idx, 4 * pi() * pow((1 + z) * 299792.458 / 70.0 * z / 3000.0
               * sum(w / sqrt(0.3 * pow(1 + z * i / 1000.0, 3) + 0.7)) * 3.085677581491367e24, 2) AS a
             FROM sel, steps WHERE z > 0 GROUP BY row_idx, z),
    f AS (SELECT sel.*, a, CASE WHEN log_lum > 0 THEN pow(10, log_lum) END AS lum,
            CASE WHEN log_lum > 0 AND log_err > 0 THEN ln(10) * pow(10, log_lum) * log_err END AS lum_err
          FROM sel LEFT JOIN area USING (row_idx)),
    g AS (SELECT *, lum / a / 1e-17 AS flux, lum_err / a / 1e-17 AS err FROM f),
    h AS (SELECT *, CASE WHEN err > 0 THEN flux / err END AS s FROM g)
    SELECT printf('spSpec-%05d-%04d-%03d.fit', mjd, plate, fiber) AS filename, c_name AS "SDSS_NAME",
      round(z, 8) AS z, mjd, plate AS "PLATE", fiber, round(hb, 6) AS snr,
      round(flux, 6) AS flux, round(err, 6) AS err, round(s, 6) AS line_snr,
      CASE WHEN lum > 1e45 THEN 'too_high_lum' WHEN lum < 1e38 THEN 'too_low_lum' WHEN lum IS NULL THEN 'missing_lum'
           WHEN s < 5 THEN 'low_snr' WHEN s IS NULL THEN 'missing_snr' WHEN err IS NULL THEN 'missing_flux_err'
           WHEN flux IS NULL THEN 'missing_flux' ELSE 'valid' END AS flag
    FROM h
    """,
)
def type1(spark, sf_dir):
    df = type1_candidates(quasars(spark, sf_dir))
    return df.select(
        "filename",
        "SDSS_NAME",
        rnd("z", 8).alias("z"),
        "mjd",
        "PLATE",
        "fiber",
        rnd("snr", 6).alias("snr"),
        rnd("OIII_FLUX", 6).alias("flux"),
        rnd("OIII_FLUX_ERR", 6).alias("err"),
        rnd("OIII_SNR", 6).alias("line_snr"),
        F.col("OIII_QUALITY_FLAG").alias("flag"),
    )


@query(
    "candidate_search",
    f"""
    WITH {QUASAR_SQL}
    SELECT printf('spSpec-%05d-%04d-%03d.fit', mjd, plate, fiber) AS filename,
           '  ' || c_name || ' ' || chr(9) AS "SDSS_NAME", ra AS "RA", dec AS "DEC", round(z, 8) AS "REDSHIFT", mjd,
           plate AS "PLATE", fiber AS "FIBER"
    FROM strong WHERE bal = 0 AND z < 0.5
    """,
)
def search(spark, sf_dir):
    df = find_candidates(quasars(spark, sf_dir), z_threshold=0.5, snr_threshold=5)
    return df.withColumn("REDSHIFT", rnd("REDSHIFT", 8))


def galaxy_tables(spark, sf_dir):
    """part as three row-aligned tables."""
    p = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    base = p.withColumn("row_idx", key)
    class_df = base.select(
        "row_idx",
        (key % 3000 + 1).cast("int").alias("PLATE"),
        (key + 52000).cast("int").alias("MJD"),
        (size * 12).cast("int").alias("FIBERID"),
        F.when(size % 4 != 0, 4).otherwise(3).alias("I_CLASS"),
        F.array(F.lit(0.0), F.lit(1.0)).alias("COEFFS"),
    )
    info_df = base.select(
        "row_idx",
        (key + 52001).cast("int").alias("MJD"),
        (size * 12 + 1).cast("int").alias("FIBERID"),
        (size / 100.0).alias("Z"),
        F.when(size % 6 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice") / 180).alias("SN_MEDIAN"),
        (key % 5 - 1).cast("int").alias("Z_WARNING"),
        F.encode(F.when(F.col("p_type") == "PROMO", "QSO  ").otherwise("GALAXY  "), "UTF-8").alias("SPECTROTYPE"),
        F.when(size % 5 == 0, None).otherwise(F.encode(F.when(F.col("p_name").contains("ring"), "AGN BROADLINE ").otherwise("AGN"), "UTF-8")).alias("SUBCLASS"),
    )
    line_df = base.select(
        "row_idx",
        (F.col("p_retailprice") * 3).alias("OIII_FLUX"),
        (size * 10.0).alias("OIII_FLUX_ERR"),
        (size * 25.0).alias("OIII_SIGMA"),
    )
    return class_df, info_df, line_df


GALAXY_SQL = """
  galaxy AS (SELECT p_partkey AS row_idx, (p_partkey % 3000 + 1)::INT AS plate, (p_partkey + 52000)::INT AS mjd_c,
      (p_size * 12)::INT AS fib_c, (p_partkey + 52001)::INT AS mjd_i, (p_size * 12 + 1)::INT AS fib_i,
      p_size / 100.0::DOUBLE AS z, p_retailprice / 180 AS sn,
      CASE WHEN p_size % 5 = 0 THEN '' WHEN p_name LIKE '%ring%' THEN 'AGN BROADLINE' ELSE 'AGN' END AS sub,
      p_retailprice * 3 AS flux, p_size * 10.0::DOUBLE AS err, p_size * 25.0::DOUBLE AS sigma,
      p_size % 4 <> 0 AND p_partkey % 5 = 1 AND p_type <> 'PROMO' AND p_size % 6 <> 0 AS ok
    FROM part),
  picked AS (SELECT * FROM galaxy WHERE ok AND sn >= 5 AND sub NOT LIKE '%BROADLINE%')
"""


@query(
    "side_by_side_tables",
    f"""
    WITH {GALAXY_SQL}
    SELECT row_idx, plate AS "PLATE", mjd_c AS "MJD_class_table", mjd_i AS "MJD_info_table",
           fib_c AS "FIBERID_class_table", fib_i AS "FIBERID_info_table", round(sigma, 3) AS "OIII_SIGMA" FROM galaxy
    """,
)
def aligned(spark, sf_dir):
    tables = [scalar_columns(t) for t in galaxy_tables(spark, sf_dir)]
    df = side_by_side(tables, ["class_table", "info_table", "line_table"])
    return df.select(
        "row_idx", "PLATE", "MJD_class_table", "MJD_info_table", "FIBERID_class_table", "FIBERID_info_table",
        rnd("OIII_SIGMA", 3).alias("OIII_SIGMA"),
    )


@query("type2_selection", f"WITH {GALAXY_SQL} SELECT row_idx, round(z, 6) AS z, sub AS subclass FROM picked")
def type2_selection(spark, sf_dir):
    class_df, info_df, _ = galaxy_tables(spark, sf_dir)
    joined = class_df.select("row_idx", "I_CLASS").join(info_df, "row_idx")
    df = select_type2(decode_strings(nan_to_null(joined)), 5)
    return df.select("row_idx", rnd("z", 6).alias("z"), F.col("SUBCLASS").alias("subclass"))


@query(
    "type2_candidates",
    f"""
    WITH {GALAXY_SQL},
    steps AS (SELECT i, CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w
              FROM generate_series(0, 1000) s(i)),
    area AS (SELECT row_idx, 4 * pi() * pow((1 + z) * 299792.458 / 70.0 * z / 3000.0
               * sum(w / sqrt(0.3 * pow(1 + z * i / 1000.0, 3) + 0.7)) * 3.085677581491367e24, 2) AS a
             FROM picked, steps WHERE z > 0 GROUP BY row_idx, z)
    SELECT row_idx, plate AS "PLATE", mjd_c AS "MJD_class_table", fib_c AS "FIBERID_class_table",
      round(log10(a * flux * 1e-17), 8) AS log_lum, round(flux / err, 8) AS line_snr,
      CASE WHEN sigma > 1000 THEN 'sigma_too_high' WHEN sigma <= 30 THEN 'sigma_too_low'
           WHEN flux / err < 5 THEN 'low_snr' ELSE 'valid' END AS flag, NULL::DOUBLE AS "OIII_CHI2"
    FROM picked LEFT JOIN area USING (row_idx)
    """,
)
def type2(spark, sf_dir):
    df = type2_candidates(*galaxy_tables(spark, sf_dir))
    return df.select(
        "row_idx",
        "PLATE",
        "MJD_class_table",
        "FIBERID_class_table",
        rnd("LOG_OIII_LUM", 8).alias("log_lum"),
        rnd("OIII_SNR", 8).alias("line_snr"),
        F.col("OIII_QUALITY_FLAG").alias("flag"),
        "OIII_CHI2",
    )


def order_targets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("row_idx"),
        (F.col("o_custkey") * 131 % 12000).cast("int").alias("PLATE"),
        (F.col("o_custkey") % 60 + 52000).cast("int").alias("mjd"),
        (F.col("o_custkey") % 1000).cast("int").alias("fiber"),
        "o_totalprice",
    )


TARGET_SQL = """
  target AS (SELECT o_orderkey AS row_idx, (o_custkey * 131 % 12000)::INT AS plate, (o_custkey % 60 + 52000)::INT AS mjd,
      (o_custkey % 1000)::INT AS fiber, o_totalprice FROM orders),
  named AS (SELECT *, printf('spec-%04d-%05d-%04d.fits', plate, mjd, fiber) AS filename FROM target)
"""


@query(
    "spectrum_names",
    f"""
    WITH {TARGET_SQL}
    SELECT row_idx, filename, printf('spSpec-%05d-%04d-%03d.fit', mjd, plate, fiber) AS legacy,
      'https://data.sdss.org/sas/dr17/sdss/spectro/redux/26/spectra/lite/' || printf('%04d', plate) || '/' || filename AS url
    FROM named
    """,
)
def names(spark, sf_dir):
    df = order_targets(spark, sf_dir)
    return df.select(
        "row_idx",
        spectrum_filename(df).alias("filename"),
        legacy_filename("PLATE", "mjd", "fiber").alias("legacy"),
        archive_url("PLATE", "mjd", "fiber").alias("url"),
    )


@query(
    "column_name_priority",
    """
    SELECT p_partkey, printf('spec-%04d-%05d-%04d.fits', p_size, p_partkey, p_size * 7) AS both_names,
           printf('spec-%04d-%05d-%04d.fits', p_size, p_partkey + 1, p_size * 7 + 1) AS table_names
    FROM part
    """,
)
def name_priority(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_size").alias("PLATE"),
        F.col("p_partkey").alias("mjd"),
        (F.col("p_size") * 7).alias("FIBER"),
        (F.col("p_partkey") + 1).alias("MJD_class_table"),
        (F.col("p_size") * 7 + 1).alias("FIBERID_class_table"),
    )
    other = p.drop("mjd", "FIBER")
    return p.select("p_partkey", spectrum_filename(p).alias("both_names")).join(
        other.select("p_partkey", spectrum_filename(other).alias("table_names")), "p_partkey"
    )


@query(
    "resolved_paths",
    """
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/abs/' || page_id ELSE '/survey/dr16/' || url END AS path FROM pages
    """,
)
def paths(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/abs/"), F.col("page_id"))).otherwise(F.col("url"))
    return p.select("page_id", resolve_path("/survey/dr16/", name).alias("path"))


@query(
    "run_names",
    """
    SELECT p_partkey, replace(printf('alpha_%.2f_gamma_%.1f_seed_%d', p_size / 64.0 + 0.0001, p_size / 4.0 + 0.01, p_partkey), '.', 'p')
             AS run_name FROM part
    """,
)
def run_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = run_name(F.col("p_size") / 64.0 + 0.0001, F.col("p_size") / 4.0 + 0.01, F.col("p_partkey"))
    return p.select("p_partkey", name.alias("run_name"))


@query(
    "decoded_strings",
    """
    SELECT c_custkey, 'key ' || c_name AS trimmed, '  key ' || c_name || ' ' || chr(9) AS untrimmed FROM customer
    """,
)
def decoded(spark, sf_dir):
    raw = F.encode(F.concat(F.lit("  key "), F.col("c_name"), F.lit(" \t")), "UTF-8")
    c = table(spark, sf_dir, "customer").select("c_custkey", raw.alias("trimmed"), raw.alias("untrimmed"))
    return decode_strings(decode_strings(c, ["trimmed"]), ["untrimmed"], strip=False)


@query(
    "kept_and_renamed_columns",
    "SELECT o_orderkey, o_totalprice AS price, o_orderstatus, o_orderpriority FROM orders",
)
def kept(spark, sf_dir):
    return keep_renamed(
        table(spark, sf_dir, "orders"),
        ["o_orderkey", "o_totalprice", "o_orderstatus"],
        {"o_totalprice": "price"},
        optional=("o_orderpriority", "o_comment"),
    )


@query("scalar_columns_only", "SELECT vec_id, label FROM embeddings")
def scalars(spark, sf_dir):
    return scalar_columns(table(spark, sf_dir, "embeddings"))


@query(
    "manifest_columns",
    "SELECT vec_id AS sdssid, label / 10.0::DOUBLE AS z, 'a' || vec_id AS specname_dr16, 'b' || vec_id AS specname_sdssv, "
    "-1 AS label FROM embeddings",
)
def manifest(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sdssid"),
        (F.col("label") / 10.0).alias("z"),
        F.concat(F.lit("a"), F.col("vec_id")).alias("specname_dr16"),
        F.concat(F.lit("b"), F.col("vec_id")).alias("specname_sdssv"),
    )
    return checked_manifest(e, require_label=False)


@query(
    "wide_and_long_layout",
    """
    SELECT vec_id, pos, round(v, 9) + 0.0 AS value
    FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
    """,
)
def layouts(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("filename"), F.col("embedding").alias("flux")
    )
    wide = array_to_wide(e, [4575.0 + 2.5 * i for i in range(64)])
    pixels = array_to_long(wide_to_array(wide), ["filename"])
    return pixels.select(
        F.col("filename").cast("bigint").alias("vec_id"), F.col("pos").cast("bigint").alias("pos"), rnd("value", 9).alias("value")
    )


@query("class_target", "SELECT vec_id, (label % 2 + 1 = 2)::INT AS target FROM embeddings")
def target(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("agn_type", F.col("label") % 2 + 1)
    return e.select("vec_id", class_target().alias("target"))


@query(
    "scaled_redshift",
    """
    SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / (stddev_pop(o_totalprice) OVER () + 1e-6), 7) + 0.0
             AS z_scaled FROM orders
    """,
)
def zscore(spark, sf_dir):
    df = scaled_redshift(table(spark, sf_dir, "orders"), "o_totalprice", eps=1e-6)
    return df.select("o_orderkey", rnd("z_scaled", 7).alias("z_scaled"))


@query("redshift_window", "SELECT p_partkey, p_size FROM part WHERE p_size / 100.0 > 0.15 AND p_size / 100.0 < 0.22")
def window(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("z", F.col("p_size") / 100.0)
    return redshift_window(p).select("p_partkey", "p_size")


LOOKUP_SQL = """
    SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS total
    FROM embeddings WHERE vec_id IN (SELECT max(vec_id) // 2 FROM embeddings)
"""


def looked_up(spark, sf_dir, find):
    """A catalogue stored for lookups, and the spectrum in its middle."""
    path = scratch_path(spark, "lookups")
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(
        F.col("vec_id").alias("row_idx"), F.concat(F.lit("spec-"), "vec_id").alias("filename"), "vec_id", "label", F.col("embedding").alias("flux")
    )
    write_lookup_catalogue(rows, path)
    middle = e.select(F.floor(F.max("vec_id") / 2)).first()[0]
    found = find(spark.read.parquet(path), middle)
    total = F.aggregate("flux", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    return found.select("vec_id", "label", rnd(total, 6).alias("total"))


@query("spectrum_lookup_by_name", LOOKUP_SQL)
def lookup_by_name(spark, sf_dir):
    return looked_up(spark, sf_dir, lambda df, middle: spectrum_by_filename(df, f"spec-{middle}"))


@query("spectrum_lookup_by_ordinal", LOOKUP_SQL)
def lookup_by_ordinal(spark, sf_dir):
    return looked_up(spark, sf_dir, spectrum_by_ordinal)


@query("spectrum_lookup", "SELECT event_id, event_type, value FROM events WHERE event_id = (SELECT max(event_id) FROM events)")
def lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = e.select(F.max("event_id").cast("string")).scalar()
    named = e.withColumn("filename", F.col("event_id").cast("string"))
    return spectrum_by_filename(named, last).select("event_id", "event_type", "value")


@query(
    "failed_spectra_removed",
    """
    SELECT (SELECT count(*) FROM events WHERE event_type <> 'error') AS kept,
           (SELECT count(*) FROM events WHERE event_type = 'error') AS failed
    """,
)
def failures(spark, sf_dir):
    bad = F.col("event_type") == "error"
    df = table(spark, sf_dir, "events").select("event_id", F.when(~bad, F.array("value")).alias("flux"))
    good, failed = split_processed(df)
    count = failed.agg(F.count("*")).scalar()
    return good.agg(F.count("*").alias("kept")).withColumn("failed", count)


@query(
    "failed_spectra_listed",
    "SELECT event_id, CASE WHEN event_type <> 'error' THEN 'kept' ELSE 'failed' END AS part, "
    "CASE WHEN event_type <> 'error' THEN value END AS value FROM events",
)
def failures_listed(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "error", F.array("value")).alias("flux"))
    parts = [part.withColumn("part", F.lit(name)) for part, name in zip(split_processed(df), ("kept", "failed"))]
    return parts[0].unionByName(parts[1]).select("event_id", "part", F.get("flux", F.lit(0)).alias("value"))


@query(
    "unique_targets",
    f"WITH {TARGET_SQL} SELECT plate, mjd, fiber, min(row_idx) AS row_idx FROM target GROUP BY ALL",
)
def unique(spark, sf_dir):
    df = unique_targets(order_targets(spark, sf_dir), TYPE1_KEYS)
    return df.select(F.col("PLATE").alias("plate"), "mjd", "fiber", "row_idx")


@query(
    "download_manifest",
    f"""
    WITH {TARGET_SQL},
    present AS (SELECT DISTINCT filename FROM named WHERE o_totalprice > 400000)
    SELECT DISTINCT plate, mjd, fiber, filename,
      'https://data.sdss.org/sas/dr17/sdss/spectro/redux/26/spectra/lite/' || printf('%04d', plate) || '/' || filename AS url
    FROM named WHERE filename NOT IN (SELECT filename FROM present)
    """,
)
def downloads(spark, sf_dir):
    df = order_targets(spark, sf_dir)
    present = df.filter("o_totalprice > 400000").select(spectrum_filename(df).alias("filename"))
    return download_manifest(df, present)


@query(
    "download_status",
    f"""
    WITH {TARGET_SQL},
    present AS (SELECT DISTINCT filename FROM named WHERE o_totalprice > 400000)
    SELECT CASE WHEN filename IN (SELECT filename FROM present) THEN 'downloaded' ELSE 'pending' END AS status,
           count(*) AS count FROM (SELECT DISTINCT filename FROM named) GROUP BY 1
    """,
)
def status(spark, sf_dir):
    df = order_targets(spark, sf_dir)
    named = df.select(spectrum_filename(df).alias("filename"), "o_totalprice")
    return download_status(named.select("filename").distinct(), named.filter("o_totalprice > 400000"))
