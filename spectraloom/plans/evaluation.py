"""Scoring with a supplied model and the evaluation of scores."""

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F

from ..functions.naming import run_name
from ..functions.scores import decide
from ..functions.vectors import ablate
from ..operators.metrics import (
    class_metrics,
    classification_report,
    label_predictions,
    metrics_from_matrix,
    rank_metrics,
    score_summary,
    threshold_metrics,
    threshold_sweep,
)
from ..operators.ranking import diagnostic_sample
from ..session import freeze
from ..settings import master_grid

PREDICTION_META = ("sdssid", "z", "specname_dr16", "specname_sdssv", "dr16_path", "sdssv_path")


class Model:
    """A scorer with weights: `load(weights)` makes the model once per Python worker, `score(model, *arrays)` uses it.

    The weights (anything picklable, or None) are shipped to every executor once, as a broadcast; they
    are a model's, so their size does not grow with the data.
    """

    def __init__(self, spark, load, score, weights=None):
        self.key = uuid.uuid4().hex
        self.load, self.score, self.weights = load, score, spark.sparkContext.broadcast(weights)

    def __call__(self, *arrays):
        if self.key not in _LOADED:
            _LOADED[self.key] = self.load(self.weights.value)
        return self.score(_LOADED[self.key], *arrays)


#: models of this Python worker
_LOADED = {}


def _scored(scorer, *columns):
    """Column of scores by a batch function; batches stream through it, one model for all of a task's."""
    if len(columns) == 1:

        @F.arrow_udf("double")
        def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for a in batches:
                yield pa.array(scorer(a), type=pa.float64())
    else:

        @F.arrow_udf("double")
        def apply(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for arrays in batches:
                yield pa.array(scorer(*arrays), type=pa.float64())

    # not deterministic for the optimizer, so that a filter on the score does not run the model again
    return apply.asNondeterministic()(*columns)


def score_pairs(pairs, scorer, first="flux_1", second="flux_2", name="prob_change"):
    """Add a score per pair.

    `scorer` is a Column, a `Model`, or a batch function of two Arrow list arrays that returns one
    number per row; the last two run on the executors, once per Arrow batch.
    """
    if isinstance(scorer, Column):
        return pairs.withColumn(name, scorer.cast("double"))
    return pairs.withColumn(name, _scored(scorer, F.col(first), F.col(second)))


def score_spectra(df, scorer, flux="flux", name="prob", mask_lines=False, grid=None):
    """Add a score per spectrum, optionally with the diagnostic regions zeroed first."""
    x = ablate(flux, master_grid() if grid is None else grid) if mask_lines else F.col(flux)
    if isinstance(scorer, Column):
        return df.withColumn(flux, x).withColumn(name, scorer.cast("double"))

    return df.withColumn(name, _scored(scorer, x))


def prediction_table(scored, threshold, meta=PREDICTION_META, label="label"):
    """Manifest columns with label, score, decision and error flags."""
    kept = [c for c in meta if c in scored.columns]
    base = scored.select(*kept, F.col(label).cast("int").alias("true_label"), "prob_change")
    return label_predictions(base, threshold)


def evaluate_pairs(scored, threshold, beta=0.5, label="label", meta=PREDICTION_META):
    """Everything reported for scored pairs, each as a DataFrame.

    The predictions are frozen, so that the scorer runs once and not for every report.
    """
    pred = freeze(prediction_table(scored, threshold, meta, label))
    columns = {"label": "true_label", "prob": "prob_change"}
    ranks = rank_metrics(pred, **columns).select(F.struct("*").alias("r")).scalar()
    metrics = threshold_metrics(pred, threshold, beta=beta, **columns).withColumns(
        {"roc_auc": ranks["roc_auc"], "average_precision": ranks["average_precision"]}
    )
    return {
        "predictions": pred,
        "metrics": metrics,
        "report": classification_report(pred, "true_label", "pred_label"),
        "sweep": threshold_sweep(pred, beta=beta, **columns),
        "diagnostic_sample": diagnostic_sample(pred),
        "summary": score_summary(pred, **columns),
    }


def evaluate_spectra(scored, label="label", prob="prob", threshold=0.5):
    """Class metrics of single-spectrum scores."""
    return class_metrics(scored.select(label, decide(prob, threshold).alias("pred")), label, "pred")


def with_run_names(results):
    return results.withColumn("run_name", run_name("focal_alpha", "focal_gamma", "seed"))


def leaderboard(results, order="run_order"):
    """One line per run of a sweep, in run order."""
    m = "test_metrics"
    return results.select(
        order,
        "run_name",
        *[F.col(f"{m}.{c}").alias(c) for c in ("macro_f1", "balanced_accuracy", "type1_recall", "type2_recall")],
        "best_epoch",
    )


def recomputed_metrics(results, which="test_metrics"):
    """Metrics of each run recomputed from its stored confusion matrix."""
    cell = F.col(f"{which}.confusion_matrix")
    counts = results.select(
        "run_name",
        cell[0][0].alias("tn"),
        cell[0][1].alias("fp"),
        cell[1][0].alias("fn"),
        cell[1][1].alias("tp"),
    )
    return metrics_from_matrix(counts, keep=["run_name"])

