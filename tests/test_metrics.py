import random

import pytest
from pyspark.sql import functions as F

from spectraloom.operators import metrics as m
from spectraloom.operators.metrics import median, threshold_sweep
from spectraloom.operators.ordering import ranked_values
from spectraloom.operators.ranking import best_epoch, best_run
from spectraloom.plans.evaluation import recomputed_metrics
from spectraloom.settings import PUBLISHED_RULE, ThresholdRule, threshold_grid
from checks.tables_and_joins import run_documents
from spectraloom.sources.results import read_run_results

# published confusion counts (tn, fp, fn, tp) with the scores stored beside them
RUNS = [
    ("alpha_0p30_gamma_1p0_seed_42", (675, 4, 12, 2563), 0.9925876697686152, 0.9947243948124741),
    ("alpha_0p45_gamma_1p0_seed_42", (672, 7, 1, 2574), 0.9962656249282733, 0.9946511860674607),
]


def test_published_scores_follow_from_their_counts(spark):
    rows = [(i, name, *counts) for i, (name, counts, _, _) in enumerate(RUNS)]
    df = spark.createDataFrame(rows, "run_order int, run_name string, tn long, fp long, fn long, tp long")
    runs = df.select(
        "run_order",
        "run_name",
        F.struct(F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix")).alias("test_metrics"),
    )
    got = {r.run_name: r for r in recomputed_metrics(runs).collect()}
    for name, _, macro_f1, balanced in RUNS:
        assert got[name].macro_f1 == pytest.approx(macro_f1, abs=1e-15)
        assert got[name].balanced_accuracy == pytest.approx(balanced, abs=1e-15)
    again = recomputed_metrics(runs).select("run_name", F.struct("macro_f1", "balanced_accuracy").alias("test_metrics"))
    assert best_run(runs.drop("test_metrics").join(again, "run_name")).first().run_name == RUNS[1][0]


def test_published_threshold_scores(spark):
    counts = spark.createDataFrame([(9794, 0, 61, 145)], "tn long, fp long, fn long, tp long")
    row = m.pair_metrics(counts).first()
    assert row.fbeta_change == pytest.approx(0.9223918575063613, abs=1e-15)
    assert row.recall_change == pytest.approx(0.7038834951456311, abs=1e-15)
    assert row.false_negative_rate == pytest.approx(0.29611650483999435, abs=1e-15)
    assert row.predicted_positive_fraction == 0.0145


def scores(spark, n=400, seed=1):
    rng = random.Random(seed)
    grid = threshold_grid()
    rows = [(rng.choice(grid + [rng.random()] * 50), int(rng.random() < 0.3)) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "prob double, label int")


def test_sweep_equals_counting_each_threshold(spark):
    rows, df = scores(spark)
    sweep = {r.threshold: r for r in m.threshold_sweep(df).collect()}
    assert sorted(sweep) == threshold_grid()
    for t in threshold_grid():
        tp = sum(1 for p, y in rows if p >= t and y)
        fp = sum(1 for p, y in rows if p >= t and not y)
        assert (sweep[t].tp, sweep[t].fp) == (tp, fp)
        assert sweep[t].tp + sweep[t].fn == sum(y for _, y in rows)


def test_rank_metrics_against_pairs(spark):
    rows, df = scores(spark, 300, 3)
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    ap, before = 0.0, 0.0
    for t in sorted({p for p, _ in rows}, reverse=True):
        hit = sum(p >= t for p in pos)
        recall = hit / len(pos)
        ap += (recall - before) * hit / sum(p >= t for p, _ in rows)
        before = recall
    for partitions in (1, 5):
        row = m.rank_metrics(df, partitions=partitions).first()
        assert row.roc_auc == pytest.approx(auc) and row.average_precision == pytest.approx(ap)


def test_one_class_only(spark):
    df = spark.createDataFrame([(0.2, 1), (0.7, 1)], "prob double, label int")
    row = m.rank_metrics(df).first()
    assert row.roc_auc is None and row.average_precision is None
    low = m.threshold_metrics(df, 0.9).first()
    assert low.precision_change == 0 and low.recall_change == 0 and low.balanced_accuracy == 0


def test_threshold_rule_and_fallback(spark):
    _, df = scores(spark)
    sweep = m.threshold_sweep(df)
    rows = [r.asDict() for r in sweep.collect()]
    for rule in (PUBLISHED_RULE, ThresholdRule(), ThresholdRule(0.5, 0.2, 0.9)):
        valid = [r for r in rows if r["recall_change"] >= rule.min_recall and r["false_positive_rate"] <= rule.max_fpr]
        best = max(
            sorted(valid or rows, key=lambda r: r["threshold"]),
            key=lambda r: (r["fbeta_change"], r["precision_change"], -r["false_positive_rate"], r["recall_change"]),
        )
        got = m.choose_threshold(sweep, rule).first()
        assert got.threshold == best["threshold"] and got.used_fallback == (not valid)


def test_best_epoch_is_the_first_best(spark):
    rows = [("a", 1, 0.5, 0.1), ("a", 2, 0.7, 0.1), ("a", 3, 0.7, 0.1), ("b", 1, 0.2, 0.3), ("b", 2, 0.2, 0.1)]
    log = spark.createDataFrame(rows, "run_name string, epoch int, fbeta double, fpr double")
    got = {r.run_name: r.epoch for r in best_epoch(log, scores=("fbeta", "-fpr")).collect()}
    assert got == {"a": 2, "b": 2}


def test_report_of_three_classes(spark):
    rows = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 4 + [(1, 2)] + [(2, 0)] * 2
    out = {r.entry: r for r in m.classification_report(spark.createDataFrame(rows, "label int, pred int")).collect()}
    assert out["1"].precision == pytest.approx(4 / 6) and out["1"].recall == pytest.approx(0.8)
    assert out["2"].f1 == 0 and out["2"].support == 2
    assert out["accuracy"].f1 == pytest.approx(9 / 14)
    assert out["macro avg"].recall == pytest.approx((5 / 7 + 0.8 + 0) / 3)


def test_run_results_from_json(spark, tmp_path):
    text = """[{"run_name": "a", "seed": 42, "test_metrics": {"macro_f1": 0.5, "confusion_matrix": [[1, 2], [3, 4]]}},
               {"run_name": "b", "seed": 42, "test_metrics": {"macro_f1": 0.7, "confusion_matrix": [[1, 2], [3, 4]]}}]"""
    (tmp_path / "sweep.json").write_text(text)
    rows = read_run_results(spark, str(tmp_path / "sweep.json")).collect()
    assert [r.run_name for r in rows] == ["a", "b"] and rows[1].test_metrics.confusion_matrix == [[1, 2], [3, 4]]


def test_run_results_of_one_run_and_of_a_sweep_side_by_side(spark, tmp_path):
    (tmp_path / "result.json").write_text('{\n "run_name": "a",\n "seed": 42,\n "test_metrics": {\n  "macro_f1": 0.5\n }\n}')
    (tmp_path / "sweep.json").write_text('[ {\n "run_name": "b"\n}, {\n "run_name": "c",\n "seed": 43\n}, { } ]')
    rows = read_run_results(spark, str(tmp_path)).collect()
    assert {(r.run_name, r.seed) for r in rows} == {("a", 42), ("b", None), ("c", 43), (None, None)} and len(rows) == 4


def test_files_of_run_documents_do_not_grow_with_the_runs(spark, tmp_path):
    rows = [(i, f"m {i}" if i % 7 else None, i % 25 if i % 5 else None, i / 4 if i % 3 else None) for i in range(2500)] + [(None, "x\n\"y\"", 3, 1.0)]
    suppliers = spark.createDataFrame(rows, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")
    suppliers.coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    out = run_documents(spark, str(tmp_path))
    want = [
        (k is None or f"run_{k}", None if n is None else n / 100, k, n, a, name)
        for k, name, n, a in rows
    ]
    got = [(r.run_name is None or r.run_name, r.focal_alpha, r.tn, r.fp, r.macro_f1, r.model_path) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len(out.inputFiles()) <= 6


def test_ranked_values_by_histogram(spark):
    rnd = random.Random(4)
    inf = float("inf")
    tables = [
        [rnd.random() for _ in range(501)],
        [0.5] * 400,
        [rnd.choice([1e-320, 2e-320, 5e-324, 0.0, -0.0]) for _ in range(100)],
        [1.7e308, -1.7e308, 1.0, 1.0 + 2**-52, 1.0 - 2**-53, 3.0, inf, -inf, inf],
        [10.0 ** rnd.randint(-300, 300) * rnd.choice([1, -1]) for _ in range(300)],
        [2.0],
    ]
    for values in tables:
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double").repartition(4)
        ranks = sorted({0, len(values) // 3, (len(values) - 1) // 2, len(values) // 2, len(values) - 1})
        got = ranked_values(df, "v", *[lambda n, r=r: r for r in ranks])
        assert got == [sorted(values)[r] for r in ranks]
    assert ranked_values(spark.createDataFrame([(None,)], "v double"), "v", lambda n: 0) == [None]
    assert median(spark.createDataFrame([(1.0,), (4.0,), (2.0,), (9.0,)], "v double"), "v") == 3.0


def test_sweep_counts_by_halving(spark):
    thresholds = [0.2, 0.1, 0.5, 0.9, 0.50000001]
    rows = [(p, i % 2) for i, p in enumerate([0.0, 0.1, 0.19, 0.2, 0.5, 0.50000001, 0.7, 0.9, 1.0, None, float("nan"), 0.0999999])]
    got = {r.threshold: (r.tp, r.fp) for r in threshold_sweep(spark.createDataFrame(rows, "prob double, label int"), thresholds).collect()}
    for t in thresholds:
        hit = [y for p, y in rows if p is not None and p >= t]
        assert got[t] == (sum(hit), len(hit) - sum(hit))
