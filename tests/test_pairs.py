import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spectraloom.operators import neighbours
from spectraloom.operators.neighbours import nearest_partners
from spectraloom.operators.ordering import with_group_positions, with_positions, with_running_totals
from spectraloom.operators.ranking import diagnostic_sample
from spectraloom.operators.split import first_per_class, stratified_split
from spectraloom.plans.diagnosis import diagnose_pairs, diagnose_sample
from spectraloom.plans.evaluation import Model, evaluate_pairs, score_pairs
from spectraloom.plans.pairs import (
    check_pair_parameters,
    matched_partners,
    pair_vectors,
    prepare_spectra,
    preprocess_pairs,
    resolve_pairs,
    sample_pairs,
)


def brute(rows, queries, k, z_std, snr_std):
    want = {}
    for cls, z, snr, obj in {tuple(q) for q in queries}:
        near = rows[(rows.cls == cls) & (rows.obj != obj)]
        dz, ds = (near.z - z) / z_std, (near.snr - snr) / snr_std
        order = pd.DataFrame({"d": dz * dz + ds * ds, "i": near.row_idx}).sort_values(["d", "i"]).head(k)
        want[(cls, z, snr, obj)] = order.i.tolist()
    return want


def clustered(seed, n=1500):
    """A third of the rows at one point, a third of one object, a tight cluster, an outlier."""
    rng = np.random.default_rng(seed)
    z, snr = rng.random(n), rng.normal(20, 5, n).round(1)
    obj = np.array([f"o{i}" for i in rng.integers(0, n, n)], dtype=object)
    third = n // 3
    z[:third], snr[:third] = 0.25, 20.0
    obj[third : 2 * third] = "hot"
    z[2 * third : 2 * third + 150] = 0.75 + rng.random(150) * 1e-7
    snr[-1] = 1e6
    cls = rng.integers(1, 3, n)
    frame = pd.DataFrame({"row_idx": np.arange(n), "obj": obj, "cls": cls, "z": z, "snr": snr})
    return frame.sample(frac=1, random_state=seed)


@pytest.mark.parametrize("seed,k", [(1, 1), (2, 7)])
def test_neighbours_equal_brute_force(spark, seed, k, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "FANOUT", 4)
    rows = clustered(seed)
    df = spark.createDataFrame(rows)
    queries = df.select((3 - F.col("cls")).alias("q_class"), F.col("z").alias("q_z"), F.col("snr").alias("q_snr"), F.col("obj").alias("q_obj"))
    if k > 1:
        monkeypatch.setattr(neighbours, "BROADCAST_NODES", 0)  # the way taken by large tables
    found = nearest_partners(queries, df.repartition(5), k)
    got = {}
    for r in found.orderBy("rank").collect():
        got.setdefault((r.q_class, r.q_z, r.q_snr, r.q_obj), []).append(r.row_idx)
    want = brute(rows, queries.collect(), k, rows.z.std() + 1e-8, rows.snr.std() + 1e-8)
    assert got == want


def test_neighbours_with_too_few_partners(spark):
    rows = [(i, "a" if i < 40 else f"b{i}", 1, float(i), 1.0) for i in range(43)]
    df = spark.createDataFrame(rows, "row_idx long, obj string, cls int, z double, snr double")
    q = spark.createDataFrame([(1, 3.0, 1.0, "a"), (1, 3.0, 1.0, "other"), (2, 3.0, 1.0, "a")], "q_class int, q_z double, q_snr double, q_obj string")
    got = {}
    for r in nearest_partners(q, df, 5).orderBy("rank").collect():
        got.setdefault((r.q_class, r.q_obj), []).append(r.row_idx)
    assert got == {(1, "a"): [40, 41, 42], (1, "other"): [3, 2, 4, 1, 5]}


def catalogue(spark, n=300):
    rng = np.random.default_rng(5)
    rows = [(i, f"f{i}", f"o{i % 120}", int(i % 3 == 0) + 1, float(rng.random()), float(rng.integers(5, 40)), [float(i), 1.0, 2.0]) for i in range(n)]
    return spark.createDataFrame(rows, "row_idx long, filename string, obj_id string, agn_type int, z double, snr double, flux array<float>")


def test_pair_sampling_rules(spark):
    df = catalogue(spark)
    meta = {r.row_idx: r for r in df.collect()}
    train = sample_pairs(df, 400, 20, "train", 0.4, seed=3).collect()
    assert len(train) == 400 and 100 < sum(r.label for r in train) < 220
    for r in train:
        a, b = meta[r.first_idx], meta[r.second_idx]
        assert a.obj_id != b.obj_id and (a.agn_type != b.agn_type) == bool(r.label)
    again = sample_pairs(df.repartition(9), 400, 20, "train", 0.4, seed=3).collect()
    assert sorted(map(tuple, train)) == sorted(map(tuple, again))
    other = sample_pairs(df, 400, 20, "train", 0.4, seed=3, epoch=1).collect()
    assert sorted(map(tuple, train)) != sorted(map(tuple, other))


def test_test_mode_takes_the_nearest(spark):
    df = catalogue(spark)
    rows = df.toPandas().rename(columns={"obj_id": "obj", "agn_type": "cls"})
    meta = rows.set_index("row_idx")
    pairs = sample_pairs(df, 50, mode="test", change_prob=0.5).collect()
    for r in pairs:
        a, b = meta.loc[r.first_idx], meta.loc[r.second_idx]
        want = brute(rows, [(b.cls, a.z, a.snr, a.obj)], 1, rows.z.std() + 1e-8, rows.snr.std() + 1e-8)
        assert list(want.values()) == [[r.second_idx]]


def test_pair_parameters():
    for mode, prob, sizes in (("fit", 0.1, {1: 1, 2: 1}), ("train", 1.5, {1: 1, 2: 1}), ("train", 0.1, {1: 1})):
        with pytest.raises(ValueError):
            check_pair_parameters(mode, prob, sizes)


def test_anchor_without_partner_raises(spark):
    df = spark.createDataFrame([(0, "a", 1, 0.1, 5.0), (1, "b", 2, 0.1, 5.0)], "row_idx long, obj_id string, agn_type int, z double, snr double")
    anchors = df.select(F.col("row_idx").alias("anchor_idx"), "z", "snr", "obj_id", F.col("agn_type").alias("partner_type"))
    with pytest.raises(Exception, match="no partner"):
        matched_partners(anchors, df, 1).collect()


def test_pair_vectors_ablation(spark):
    df = catalogue(spark)
    pairs = spark.createDataFrame([(0, 1, 5, 6)], "pair_id long, label int, first_idx long, second_idx long")
    row = pair_vectors(pairs, df, [4600.0, 5600.0, 6300.0], mask_lines=True).first()
    assert row.flux_1 == [0, 1, 0] and row.flux_2 == [0, 1, 0]


def test_split_quotas_and_repartitioning(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, 2).otherwise(1).alias("cls"))
    out = stratified_split(df, "cls", "id", 7)
    sizes = {(r["cls"], r["split"]): r["count"] for r in out.groupBy("cls", "split").count().collect()}
    assert sizes == {(1, "train"): 630, (1, "val"): 135, (1, "test"): 135, (2, "train"): 70, (2, "val"): 15, (2, "test"): 15}
    first = {r.id: r.split for r in out.collect()}
    assert first == {r.id: r.split for r in stratified_split(df.repartition(6), "cls", "id", 7).collect()}
    assert first != {r.id: r.split for r in stratified_split(df, "cls", "id", 8).collect()}


def test_first_per_class(spark):
    df = spark.range(300).withColumn("cls", F.col("id") % 3)
    out = first_per_class(df, "cls", "id", 20, 1, F.col("id") > 100).collect()
    assert len(out) == 60 and min(r.id for r in out) > 100


def test_prepared_spectra(spark):
    grid = [4600.0 + 35 * i for i in range(60)]
    df = spark.range(200).select(
        F.concat(F.lit("f"), "id").alias("filename"), (F.col("id") % 2 + 1).alias("agn_type"), (F.col("id") / 100.0).alias("z"),
        F.lit([1.0] * 60).alias("flux"),
    )
    out, weight = prepare_spectra(df, grid)
    rows = out.collect()
    assert {r.split for r in rows} == {"train", "val", "test"} and weight.first().pos_weight == 1
    assert all((0.0 in r.flux) == (r.split == "train") for r in rows)
    assert abs(sum(r.z_scaled for r in rows)) < 1e-9


def test_positions_and_totals(spark):
    df = spark.range(500).select("id", (F.col("id") * 7919 % 500).alias("k"), (F.col("id") < 450).cast("int").alias("g"))
    assert all(r.position == r.k for r in with_positions(df, "k", partitions=7).collect())
    grouped = with_group_positions(df, "g", "k", partitions=7).toPandas()
    assert (grouped.sort_values("k").groupby("g").cumcount() == grouped.sort_values("k").position).all()
    totals = with_running_totals(df, "k", {"total": F.col("k")}, partitions=7).collect()
    assert all(r.total == r.k * (r.k + 1) // 2 for r in totals)


def wavy(spark, paths):
    wave = [4400.0 + 4 * i for i in range(800)]
    rows = [(p, wave, [50.0 + (j * (i + 2) % 23) - 0.01 * j for j in range(800)]) for i, p in enumerate(paths)]
    return spark.createDataFrame(rows, "path string, wavelength array<double>, flux array<double>")


def test_real_pairs_end_to_end(spark):
    manifest = spark.createDataFrame(
        [(1, 0.05, "a", "b", 1), (2, 0.05, "a", "c", 0), (3, 0.05, "a", "zz", 0), (4, None, "b", "c", 1), (5, 9.0, "b", "c", 1), (6, 0.05, "/v/b", "c", 1)],
        "sdssid long, z double, specname_dr16 string, specname_sdssv string, label int",
    )
    spectra = wavy(spark, ["/v/a", "/v/b", "/v/c"])
    good, log = preprocess_pairs(resolve_pairs(manifest, "/v", "/v"), spectra, keep_raw=True)
    assert sorted(r.sdssid for r in good.collect()) == [1, 2, 6]
    reasons = {r.sdssid: (r.skip_reason, r.missing_side, r.error) for r in log.collect()}
    assert reasons[3] == ("missing_file", "sdssv", None)
    assert reasons[4][2] == "invalid redshift" and reasons[5][2] == "no wavelength overlap"

    def gap(a, b):
        x, y = (c.flatten().to_numpy().reshape(len(c), -1) for c in (a, b))
        return 1 / (1 + np.exp(-np.abs(x - y).mean(axis=1) + 3))

    report = evaluate_pairs(score_pairs(good, gap), 0.5)
    assert report["metrics"].count() == 1 and report["sweep"].count() == 99
    assert report["summary"].first().n == 3
    diagnosis = diagnose_sample(diagnostic_sample(report["predictions"]), good, log)
    rows = diagnosis.collect()
    assert len(rows) == 3 and len(diagnosis.columns) == 37 + 2
    assert all(r.hb_paper_flux_dr16 is not None and r.ha_paper_flux_dr16 is None for r in rows)


def test_diagnostic_sample_keeps_first_group(spark):
    rows = [(i, f"a{i}", f"b{i}", int(i % 2 == 0), i / 100) for i in range(100)]
    pred = spark.createDataFrame(rows, "sdssid long, specname_dr16 string, specname_sdssv string, true_label int, prob_change double")
    pred = pred.withColumn("pred_label", (F.col("prob_change") >= 0.5).cast("int"))
    out = {r.sdssid: r.diagnostic_group for r in diagnostic_sample(pred).collect()}
    assert len(out) == 40
    assert out[0] == "false_negative_lowest_prob" and out[98] == "true_change_highest_prob" and out[99] == "static_highest_prob"


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    def loads(folder):
        """A model that leaves a mark whenever it is loaded."""
        import tempfile

        handle, _ = tempfile.mkstemp(prefix=f"{os.getpid()}-", dir=folder)
        os.close(handle)
        return folder

    def first_values(model, a, b):
        return [x[0] + y[0] for x, y in zip(a.to_pylist(), b.to_pylist())]

    rows = [(i, [float(i), 1.0], [2.0, 3.0]) for i in range(400)]
    pairs = spark.createDataFrame(rows, "id int, flux_1 array<double>, flux_2 array<double>").repartition(16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        model = Model(spark, loads, first_values, weights=str(tmp_path))
        got = {r.id: r.prob_change for r in score_pairs(pairs, model).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    assert got == {i: i + 2.0 for i in range(400)}
    workers = [name.split("-")[0] for name in os.listdir(tmp_path)]
    # 16 tasks and 80 batches, but one load in each worker process
    assert len(workers) == len(set(workers)) <= 4


def test_pairs_meet_their_members_by_key(spark):
    wave = [4500.0 + 5 * i for i in range(560)]
    spectra = spark.createDataFrame(
        [(f"/d/s{i}", wave, [10.0 + (j * (i + 3) % 17) for j in range(560)]) for i in range(4)], "path string, wavelength array<double>, flux array<double>"
    )
    rows = [(1, 0.05, "s0", "s1"), (2, 0.05, "s1", "s2"), (2, 0.05, "s1", "s2"), (3, None, "s0", "s2"), (4, 0.06, "s0", "gone"), (5, 0.05, "s1", "s1")]
    manifest = resolve_pairs(spark.createDataFrame(rows, "sdssid bigint, z double, specname_dr16 string, specname_sdssv string"), "/d", "/d")
    good, log = preprocess_pairs(manifest, spectra)
    text = good._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert not [x for x in text.splitlines() if "Aggregate" in x and "flux" in x]
    got = {}
    for r in good.collect():
        got.setdefault(r.sdssid, []).append((tuple(r.flux_1), tuple(r.flux_2)))
    assert {k: len(v) for k, v in got.items()} == {1: 1, 2: 2, 5: 1}
    assert got[1][0][1] == got[2][0][0] == got[5][0][0] == got[5][0][1] != got[1][0][0]
    assert sorted((r.sdssid, r.skip_reason) for r in log.collect()) == [(3, "preprocessing_failed"), (4, "missing_file")]


def test_diagnosis_takes_one_python_hop(spark):
    rows = [(1, [float(i % 7) for i in range(64)], [float(i % 5) for i in range(64)]), (2, None, [1.0] * 64), (3, [2.0] * 64, [1.0] * 3), (4, [1.0] * 3, None)]
    pairs = spark.createDataFrame(rows, "sdssid bigint, raw_1 array<double>, raw_2 array<double>")
    df = diagnose_pairs(pairs, [4680.0 + 40.0 * i for i in range(64)], 7)
    physical = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert physical.count("ArrowEvalPython") == 1
    got = {r.sdssid: r for r in df.collect()}
    assert got[1].pair_shared_mad is not None and got[1].hb_paper_flux_ratio is not None
    assert got[2].dr16_ind_mad is None and got[2].sdssv_ind_mad == 0 and got[2].pair_shared_mad is None
    assert got[3].hb_paper_flux_dr16 == 0 and got[3].hb_paper_flux_sdssv is None and got[3].pair_shared_median is None
    assert all(v is None for c, v in got[4].asDict().items() if c != "sdssid")
