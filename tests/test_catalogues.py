import pytest
from pyspark.sql import Row, functions as F

from spectraloom.operators.dedup import best_by_snr, keep_first, keep_last
from spectraloom.operators.joins import attach_metadata, pairs_with_files, side_by_side
from spectraloom.operators.select import clean_spectra, cleaning_report, redshift_window, two_line_snr
from spectraloom.operators.shape import array_to_wide, flux_columns, get_spectrum, wide_to_array
from spectraloom.plans.candidates import TYPE1_BASE, TYPE1_LINES, download_manifest, type1_candidates, type2_candidates
from spectraloom.plans.preprocessing import build_catalogue, preprocess_spectra, run_preprocessing
from spectraloom.settings import master_grid
from spectraloom.sources.tables import checked_manifest
from spectraloom.sources.results import write_lookup_catalogue
from spectraloom.streaming.ingest import ingest_batch, stream_catalogue

NAN, INF = float("nan"), float("inf")


def test_two_line_rule(spark):
    cases = [(6.0, 6.0, 1), (6.0, -1.0, 1), (6.0, 0.0, 1), (6.0, 3.0, 0), (0.0, 0.0, 0), (5.0, 5.0, 1), (None, 6.0, 0), (NAN, 6.0, 0), (INF, 6.0, 1)]
    df = spark.createDataFrame(cases, "hb double, ha double, want int")
    assert df.filter(two_line_snr("hb", "ha", 5).cast("int") != F.col("want")).count() == 0


def galaxies(spark):
    info = [
        # row_idx, MJD, Z, Z_WARNING, SN_MEDIAN, SPECTROTYPE, SUBCLASS
        (0, 1, 0.1, 0, 6.0, b"GALAXY ", None),
        (1, 1, 0.1, 1, 6.0, b"GALAXY", b"x"),
        (2, 1, 0.1, 0, 4.9, b"GALAXY", b"x"),
        (3, 1, 0.1, 0, NAN, b"GALAXY", b"x"),
        (4, 1, 0.1, 0, 5.0, b"QSO", b"x"),
        (5, 1, 0.1, 0, 5.0, b"GALAXY", b"AGN BROADLINE"),
        (6, 1, 0.1, 0, 5.0, b"GALAXY", b"STARFORMING"),
        (7, 1, 0.1, 0, 5.0, b"GALAXY", b"x"),
    ]
    info_df = spark.createDataFrame(
        info, "row_idx long, MJD int, Z double, Z_WARNING int, SN_MEDIAN double, SPECTROTYPE binary, SUBCLASS binary"
    )
    class_df = info_df.select(
        "row_idx", F.lit(7).alias("PLATE"), F.lit(52000).alias("MJD"), F.lit(3).alias("FIBERID"),
        F.when(F.col("row_idx") == 7, 3).otherwise(4).alias("I_CLASS"), F.array(F.lit(1.0)).alias("VECTOR"),
    )
    line_df = info_df.select("row_idx", F.lit(100.0).alias("OIII_FLUX"), F.lit(10.0).alias("OIII_FLUX_ERR"))
    return class_df, info_df, line_df


def test_type2_candidates(spark):
    class_df, info_df, line_df = galaxies(spark)
    df = type2_candidates(class_df, info_df, line_df)
    assert sorted(r.row_idx for r in df.collect()) == [0, 6]
    assert {"MJD_class_table", "MJD_info_table", "z", "OIII_SIGMA"} <= set(df.columns) and "VECTOR" not in df.columns
    assert df.filter("row_idx = 0").first().SUBCLASS == ""
    without = type2_candidates(class_df, info_df)
    assert without.first().OIII_FLUX is None and without.first().OIII_QUALITY_FLAG == "missing_lum"


def test_type1_candidates_layout(spark):
    rows = [(b" J1 ", 1.0, 2.0, 0.2, 52000, 123456, 7, 0, 8.0, -1.0, 42.0), (b"J2", 1.0, 2.0, 0.4, 1, 1, 1, 0, 8.0, 8.0, 42.0)]
    df = spark.createDataFrame(
        rows,
        "SDSS_NAME binary, RA double, DEC double, REDSHIFT double, MJD int, PLATE int, FIBER int, BAL_FLAG int, "
        "LINE_MED_SN_HB double, LINE_MED_SN_HA double, LOGL_OIII_5007 double",
    )
    out = type1_candidates(df)
    row = out.collect()
    assert len(row) == 1 and row[0].SDSS_NAME == "J1" and row[0].filename == "spSpec-52000-123456-007.fit"
    assert len(out.columns) == len(TYPE1_BASE + TYPE1_LINES) and {"mjd", "fiber", "snr"} <= set(out.columns)
    assert row[0].OIII_FLUX > 0 and row[0].OIII_QUALITY_FLAG == "missing_snr" or row[0].OIII_QUALITY_FLAG == "missing_flux_err"


def test_dedup_order_and_repartitioning(spark):
    df = spark.createDataFrame([("a", i, NAN if i == 1 else float(i % 5)) for i in range(50)] + [("b", 99, None)], "obj_id string, row_idx long, snr double")
    for parts in (1, 7):
        d = df.repartition(parts)
        assert {r.obj_id: r.row_idx for r in keep_first(d, "obj_id", "row_idx").collect()} == {"a": 0, "b": 99}
        assert {r.obj_id: r.row_idx for r in keep_last(d, "obj_id", "row_idx").collect()} == {"a": 49, "b": 99}
        assert {r.obj_id: r.row_idx for r in best_by_snr(d, tie="row_idx").collect()} == {"a": 4, "b": 99}


def test_side_by_side_keeps_unmatched_rows(spark):
    a = spark.createDataFrame([(0, 1), (1, 2)], "row_idx long, x int")
    b = spark.createDataFrame([(0, 5)], "row_idx long, X int")
    out = side_by_side([a, b], ["one", "two"])
    assert out.columns == ["row_idx", "x_one", "X_two"] and out.count() == 2


def test_metadata_last_row_counts(spark):
    spectra = spark.createDataFrame([(1, "f"), (2, "f"), (1, "g")], "agn_type int, filename string")
    meta = spark.createDataFrame([(1, "f", 0, 10), (1, "f", 1, 11)], "agn_type int, filename string, row_idx long, v int")
    out = attach_metadata(spectra, meta)
    assert {(r.agn_type, r.filename): r.v for r in out.collect()} == {(1, "f"): 11, (2, "f"): None, (1, "g"): None}


def test_manifest_and_missing_files(spark):
    pairs = spark.createDataFrame([(1, "/a", "/b"), (2, "/x", "/b"), (3, "/a", "/x"), (4, "/x", "/y")], "sdssid long, dr16_path string, sdssv_path string")
    listing = spark.createDataFrame([("/a",), ("/b",), ("/b",)], "path string")
    kept, log = pairs_with_files(pairs, listing)
    assert [r.sdssid for r in kept.collect()] == [1]
    assert {r.sdssid: r.missing_side for r in log.collect()} == {2: "dr16", 3: "sdssv", 4: "dr16+sdssv"}
    with pytest.raises(ValueError, match="specname_dr16"):
        checked_manifest(pairs)


def test_download_manifest(spark):
    rows = [(0, 1, 52000, 3), (1, 1, 52000, 3), (2, 2, 52000, 3)]
    df = spark.createDataFrame(rows, "row_idx long, PLATE int, mjd int, fiber int")
    present = spark.createDataFrame([("spec-0002-52000-0003.fits",)], "filename string")
    out = download_manifest(df, present).collect()
    assert len(out) == 1 and out[0].url.endswith("/0001/spec-0001-52000-0003.fits")


def test_layouts_and_lookup(spark):
    df = spark.createDataFrame([("f", "o", 1, 0.1, 9.0, [1.0, 2.0, 3.0], 0)], "filename string, obj_id string, agn_type int, z double, snr double, flux array<float>, row_idx long")
    grid = [4575.0, 4577.076246334311, 6699.0]
    wide = array_to_wide(df.drop("row_idx"), grid)
    assert flux_columns(wide) == (["4575.0", "4577.076246334311", "6699.0"], grid)
    assert wide_to_array(wide).first().flux == [1, 2, 3]
    assert get_spectrum(df, "f", grid)[1] == [1, 2, 3] and get_spectrum(df, 0, grid)[2]["snr"] == 9.0
    with pytest.raises(ValueError):
        get_spectrum(df, "nothing", grid)
    with pytest.raises(TypeError):
        get_spectrum(df, 1.5, grid)


def test_redshift_window_is_open(spark):
    df = spark.createDataFrame([(0.15,), (0.2,), (0.22,), (NAN,), (None,)], "z double")
    assert [r.z for r in redshift_window(df).collect()] == [0.2]


def test_cleaning(spark):
    rows = [
        (0, [1.0, 2.0, 0.0, 0.0], 5.0),
        (1, [0.0, 0.0, 0.0, 1.0], 9.0),
        (2, [1.0, 1.0, 1.0, 1.0], 4.9),
        (3, [1.0, 1.0, 1.0, 1.0], NAN),
        (4, [NAN] * 4, 9.0),
        (5, [NAN, 1.0, 60.0, -3.0], 9.0),
    ]
    df = spark.createDataFrame(rows, "i int, flux array<double>, snr double")
    assert sorted(r.i for r in clean_spectra(df).collect()) == [0, 5]
    assert sorted(r.i for r in clean_spectra(df, max_flux_outlier=50).collect()) == [0]
    assert sorted(r.i for r in clean_spectra(df, max_neg_flux=2).collect()) == [0]
    report = cleaning_report(df, max_flux_outlier=50, require_valid_oiii=True).first()
    assert (report.original, report.dropped_coverage, report.dropped_snr, report.dropped_finite) == (6, 1, 2, 1)
    assert (report.dropped_outlier, report.dropped_oiii, report.remaining) == (2, 6, 0)


def raw(spark, names, shift=0.0):
    wave = [4500.0 + 5 * i for i in range(560)]
    rows = []
    for i, name in enumerate(names):
        flux = [10.0 + shift + (j * (i + 3) % 17) for j in range(560)]
        rows.append(Row(filename=name, obj_id=f"o-{name}", agn_type=i % 2 + 1, z=0.05 if i != 3 else None, snr=9.0, wavelength=wave, flux=flux))
    return spark.createDataFrame(
        rows, "filename string, obj_id string, agn_type int, z double, snr double, wavelength array<double>, flux array<double>"
    )


def no_meta(spark):
    schema = "row_idx long, PLATE int, mjd int, fiber int, z double, OIII_FLUX double, OIII_VALID boolean"
    return spark.createDataFrame([(0, 1, 52000, 3, 0.05, 4.0, True)], schema)


def test_preprocessing_writes_1024_pixels_and_logs_failures(spark):
    names = [f"spec-{i:04d}-52000-0003.fits" for i in range(6)]
    done = preprocess_spectra(raw(spark, names)).collect()
    good = [r for r in done if r.flux is not None]
    assert len(good) == 5 and all(len(r.flux) == 1024 and r.flux[0] == 0 == r.flux[-1] for r in good)
    assert [r.error for r in done if r.flux is None] == ["missing redshift or SNR"]
    catalogue, log = build_catalogue(raw(spark, names), no_meta(spark), no_meta(spark))
    sources = {r.filename: r.OIII_FLUX_SOURCE for r in catalogue.collect()}
    assert sources[names[1]] == "catalog_flux" and sources[names[0]] is None
    assert [r.filename for r in log.collect()] == [names[3]]


def test_run_modes(spark, tmp_path):
    names = [f"n{i}" for i in range(6)]
    first, _ = run_preprocessing(raw(spark, names[:4]), no_meta(spark), no_meta(spark), str(tmp_path / "a"))
    assert first.count() == 3
    merged, _ = run_preprocessing(
        raw(spark, names, shift=5.0), no_meta(spark), no_meta(spark), str(tmp_path / "b"), "merge", first
    )
    assert sorted(r.filename for r in merged.collect()) == ["n0", "n1", "n2", "n4", "n5"]
    old = {r.filename: r.flux for r in first.collect()}
    assert all(r.flux == old[r.filename] for r in merged.collect() if r.filename in old)
    with pytest.raises(ValueError):
        run_preprocessing(raw(spark, names), no_meta(spark), no_meta(spark), str(tmp_path / "c"), "other")


def test_stream_adds_each_file_once(spark, tmp_path):
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    empty = build_catalogue(raw(spark, ["x"]), no_meta(spark), no_meta(spark))[0]
    meta = empty.select("agn_type", "filename", F.lit(0).alias("row_idx"), "OIII_VALID").limit(0)
    names = [f"n{i}" for i in range(4)]
    raw(spark, names[:3]).write.parquet(source)
    schema = spark.read.parquet(source).schema

    def run(checkpoint):
        stream_catalogue(spark, source, schema, meta, output, str(tmp_path / checkpoint)).awaitTermination()
        return spark.read.parquet(output)

    assert run("c1").count() == 3
    raw(spark, names[:3] + ["skip", "late"]).write.mode("append").parquet(source)
    assert sorted(r.filename for r in run("c1").collect()) == ["late", "n0", "n1", "n2"]
    assert run("c2").count() == 4  # all files again
    ingest_batch(raw(spark, names[:3]), meta, output)
    assert spark.read.parquet(output).count() == 4


def test_master_grid_length():
    assert len(master_grid()) == 1024


def rows_read(df):
    """Rows that the scan of a collected query handed on, after row groups were skipped."""
    found = []

    def visit(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return visit(node.executedPlan())
        if name.startswith("Scan"):
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i))

    visit(df._jdf.queryExecution().executedPlan())
    return sum(found)


def test_lookups_read_few_row_groups(spark, tmp_path):
    flux = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda x: F.rand(3))
    df = spark.range(20_000, numPartitions=2).select(
        F.col("id").alias("row_idx"), F.concat(F.lit("spec-"), F.md5(F.col("id").cast("string"))).alias("filename"),
        F.concat(F.lit("o"), F.col("id") % 9000).alias("obj_id"), flux.alias("flux"),
    )
    path = str(tmp_path / "lookups")
    write_lookup_catalogue(df, path, row_group_mb=1)
    stored = spark.read.parquet(path)
    name = stored.filter("row_idx = 12345").first()["filename"]
    for found in (stored.filter(F.col("filename") == name), stored.filter(F.col("row_idx") == 12345)):
        assert [r.row_idx for r in found.collect()] == [12345]
        assert 0 < rows_read(found) <= 3000
    absent = stored.filter("filename = 'spec-none'")
    assert absent.collect() == [] and rows_read(absent) <= 3000
    objects = stored.filter("obj_id = 'o77'")
    assert len(objects.collect()) == 3 and rows_read(objects) <= 9000
    everything = stored.filter("filename like '%x-none'")
    assert everything.collect() == [] and rows_read(everything) == 20_000
