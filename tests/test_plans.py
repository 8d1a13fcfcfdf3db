"""Shape of physical plans that matter at scale."""

import re

from pyspark.sql import functions as F

from spectraloom.functions.lines import luminosity_from_flux
from spectraloom.operators.dedup import keep_first, keep_last
from spectraloom.operators.metrics import threshold_sweep
from spectraloom.operators.neighbours import nearest_partners
from spectraloom.operators.shape import class_profiles, safe_range, vector_moments
from spectraloom.operators.ordering import with_positions, with_running_totals
from spectraloom.operators.select import clean_spectra, redshift_window, select_type1, select_type2, split_processed
from spectraloom.plans.candidates import find_candidates, type1_candidates, type2_candidates
from spectraloom.plans.preprocessing import build_catalogue, preprocess_spectra
from spectraloom.sources.tables import processed_schema


def plan(df):
    return df._jdf.queryExecution().toString()


def test_no_cross_products(spark):
    df = spark.range(100).select(F.col("id").alias("row_idx"), (F.col("id") % 2).alias("cls"), F.rand(1).alias("z"), F.rand(2).alias("snr"), F.col("id").cast("string").alias("obj"))
    q = df.select(F.col("cls").alias("q_class"), F.col("z").alias("q_z"), F.col("snr").alias("q_snr"), F.col("obj").alias("q_obj"))
    scores = df.select(F.col("z").alias("prob"), F.lit(1).alias("label"))
    for text in (plan(nearest_partners(q, df, 3)), plan(threshold_sweep(scores))):
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_catalogue_queries_do_not_read_flux(spark, tmp_path):
    path = str(tmp_path / "catalogue")
    spark.createDataFrame([], processed_schema()).write.parquet(path)
    df = redshift_window(spark.read.parquet(path)).groupBy("agn_type").count()
    text = plan(df)
    assert "flux" not in text.split("ReadSchema")[1]
    assert {"GreaterThan(z,0.15)", "LessThan(z,0.22)"} <= pushed(df)


def pushed(df):
    """Filters that reach the Parquet scans of a plan."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")
    df = df.select("*")  # planned anew, with the whole text
    found = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", plan(df).split("== Physical Plan ==")[1])
    return {f for text in found for f in re.findall(r"\w+\((?:[^()]|\([^()]*\)|\((?:[^()]|\([^()]*\))*\))*\)", text)}


def stored(spark, tmp_path, name, columns):
    path = str(tmp_path / name)
    spark.createDataFrame([], ", ".join(columns)).write.parquet(path)
    return spark.read.parquet(path)


TYPE1 = [
    "SDSS_NAME binary", "RA double", "DEC double", "REDSHIFT double", "MJD int", "PLATE int", "FIBER int", "BAL_FLAG int",
    "LINE_MED_SN_HB double", "LINE_MED_SN_HA double", "LOGL_OIII_5007 double", "LOGL_OIII_5007_ERR double",
]


def test_filters_of_the_selections_reach_the_scan(spark, tmp_path):
    quasars = stored(spark, tmp_path, "type1", TYPE1)
    lines = {"Or(LessThanOrEqual(LINE_MED_SN_HB,0.0),GreaterThanOrEqual(LINE_MED_SN_HB,5.0))"}
    limits = {"EqualTo(BAL_FLAG,0)", "LessThan(REDSHIFT,0.4)"} | lines
    assert limits <= pushed(select_type1(quasars))
    assert limits <= pushed(type1_candidates(quasars))
    assert limits <= pushed(find_candidates(quasars, 0.4, 5.0))
    classes = stored(spark, tmp_path, "class", ["row_idx long", "PLATE int", "MJD int", "FIBERID int", "I_CLASS int"])
    info = stored(
        spark, tmp_path, "info",
        ["row_idx long", "Z double", "SN_MEDIAN double", "Z_WARNING int", "SPECTROTYPE string", "SUBCLASS string", "MJD int", "FIBERID int"],
    )
    one_side = {"EqualTo(I_CLASS,4)"}
    other = {"EqualTo(Z_WARNING,0)", "GreaterThanOrEqual(SN_MEDIAN,5.0)", "EqualTo(SPECTROTYPE,GALAXY)"}
    assert one_side | other <= pushed(type2_candidates(classes, info))
    assert other <= pushed(select_type2(info.withColumn("I_CLASS", F.lit(4))))
    catalogue = spark.createDataFrame([], processed_schema())
    catalogue.write.parquet(str(tmp_path / "spectra"))
    assert {"GreaterThanOrEqual(snr,5.0)"} <= pushed(clean_spectra(spark.read.parquet(str(tmp_path / "spectra"))))


def test_distance_is_computed_once(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("z"), F.lit(1.0).alias("OIII_FLUX"), F.lit(1.0).alias("OIII_FLUX_ERR"))
    physical = plan(luminosity_from_flux(df)).split("== Physical Plan ==")[1]
    assert physical.count("SQRT") == 16


def test_dedup_combines_before_the_shuffle(spark):
    text = plan(keep_first(spark.range(10).withColumn("k", F.col("id") % 2), "k", "id"))
    assert "partial_min_by" in text and "Window" not in text


def test_vectors_stay_out_of_dedup_aggregates(spark):
    wide = spark.range(10).select((F.col("id") % 2).alias("k"), "id", F.array(F.lit(1.0)).alias("flux"))
    for df in (keep_first(wide, "k", "id"), keep_last(wide, "k", "id")):
        text = plan(df).split("== Physical Plan ==")[1]
        assert not [line for line in text.splitlines() if "Aggregate" in line and "flux" in line]
        assert sorted(df.select("k").collect()) == [(0,), (1,)]
    nulls = wide.withColumn("k", F.when(F.col("k") == 1, 1)).unionByName(wide)
    assert sorted((r.k is None, r.id) for r in keep_first(nulls, "k", "id").collect()) == [(False, 0), (False, 1), (True, 0)]


def test_kernel_runs_once_for_catalogue_and_log(spark):
    raw = spark.createDataFrame(
        [("f", 1, 0.1, 9.0, [5000.0, 6000.0], [1.0, 2.0])],
        "filename string, agn_type int, z double, snr double, wavelength array<double>, flux array<double>",
    )
    meta = spark.createDataFrame([], "row_idx int, PLATE int, mjd int, fiber int, z double, OIII_FLUX double, OIII_VALID boolean")
    for df in build_catalogue(raw, meta, meta):
        assert "ArrowEvalPython" not in plan(df) and "Scan parquet" in plan(df)


def test_kernel_runs_once_per_spectrum(spark):
    raw = spark.createDataFrame(
        [("f", 1, 0.1, 9.0, [5000.0, 6000.0], [1.0, 2.0])],
        "filename string, agn_type int, z double, snr double, wavelength array<double>, flux array<double>",
    )
    good, _ = split_processed(preprocess_spectra(raw))
    physical = plan(good).split("== Physical Plan ==")[1]
    assert physical.count("ArrowEvalPython") == 1


def test_running_totals_are_made_where_the_ranges_are_stored(spark):
    df = spark.range(100).withColumn("k", F.col("id") * 7 % 100)
    physical = plan(with_running_totals(df, "k", {"t": F.col("id")})).split("== Physical Plan ==")[1]
    assert "Exchange" not in physical and "Sort" not in physical and "Window" not in physical and "MapInArrow" in physical


def test_vector_aggregates_shuffle_a_row_per_task_and_class(spark):
    flux = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: (x * F.col("id")).cast("double"))
    df = spark.range(1000, numPartitions=5).select((F.col("id") % 2).alias("k"), flux.alias("flux"))
    for text in (plan(class_profiles(df, "k")), plan(safe_range(df, list(range(64))))):
        assert "Generate" not in text.split("== Physical Plan ==")[1].split("Exchange")[-1]
    assert vector_moments(df, "k").count() == 10 and vector_moments(df).count() == 5


def test_partition_offsets_do_not_use_a_global_window(spark):
    df = spark.range(100).withColumn("k", F.col("id") * 7 % 100)
    for text in (plan(with_positions(df, "k")), plan(with_running_totals(df, "k", {"t": F.col("id")}))):
        assert "SinglePartition" not in text
