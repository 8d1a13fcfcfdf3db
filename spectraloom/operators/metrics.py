"""Confusion counts and everything derived from them, threshold sweeps, rank metrics."""

from functools import reduce

from pyspark.sql import Window as W, functions as F

from ..functions.missing import number
from ..functions.scores import decide
from ..settings import EPS, ThresholdRule, threshold_grid
from .ordering import ranked_values, with_running_totals


def _count(condition):
    return F.coalesce(F.sum(F.coalesce(condition, F.lit(False)).cast("bigint")), F.lit(0))


def confusion_counts(df, label="label", pred="pred"):
    """One row: tn, fp, fn, tp."""
    y, p = F.col(label), F.col(pred)
    return df.agg(
        _count((y == 0) & (p == 0)).alias("tn"),
        _count((y == 0) & (p == 1)).alias("fp"),
        _count((y == 1) & (p == 0)).alias("fn"),
        _count((y == 1) & (p == 1)).alias("tp"),
    )


def _ratio(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def pair_metrics(counts, beta=0.5, fbeta_name="fbeta_change"):
    """Accuracy, precision, recall, F scores and rates from tn, fp, fn, tp columns."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    b2 = F.lit(float(beta) ** 2)
    total = tn + fp + fn + tp
    recalls = [F.try_divide(tp.cast("double"), tp + fn), F.try_divide(tn.cast("double"), tn + fp)]
    present = reduce(lambda a, b: a + b, [r.isNotNull().cast("int") for r in recalls])
    balanced = F.try_divide(reduce(lambda a, b: a + b, [F.coalesce(r, F.lit(0.0)) for r in recalls]), present)
    return counts.withColumns(
        {
            "accuracy": _ratio(tp + tn, total),
            "balanced_accuracy": balanced,
            "precision_change": _ratio(tp, tp + fp),
            "recall_change": _ratio(tp, tp + fn),
            "f1_change": _ratio(2 * tp, 2 * tp + fp + fn),
            fbeta_name: _ratio((b2 + 1) * tp, (b2 + 1) * tp + b2 * fn + fp),
            "false_positive_rate": fp / (fp + tn + F.lit(EPS)),
            "false_negative_rate": fn / (fn + tp + F.lit(EPS)),
            "num_predicted_positive": tp + fp,
            "predicted_positive_fraction": _ratio(tp + fp, total),
        }
    )


def threshold_metrics(df, threshold, label="label", prob="prob", beta=0.5):
    decided = df.select(label, decide(prob, threshold).alias("__pred"))
    counts = confusion_counts(decided, label, "__pred").withColumn("threshold", F.lit(float(threshold)))
    return pair_metrics(counts, beta)


def label_predictions(df, threshold, label="true_label", prob="prob_change"):
    """pred_label with flags for both kinds of error."""
    pred = F.col("pred_label")
    return df.withColumn("pred_label", decide(prob, threshold)).withColumns(
        {
            "is_false_positive": ((F.col(label) == 0) & (pred == 1)).cast("int"),
            "is_false_negative": ((F.col(label) == 1) & (pred == 0)).cast("int"),
        }
    )


def _reached(value, thresholds, low=0):
    """How many of the sorted thresholds a value reaches, by halving; none if it is missing."""
    if not thresholds:
        return F.lit(low)
    middle = len(thresholds) // 2
    upper = _reached(value, thresholds[middle + 1 :], low + middle + 1)
    return F.when(value >= thresholds[middle], upper).otherwise(_reached(value, thresholds[:middle], low))


def threshold_sweep(df, thresholds=None, label="label", prob="prob", beta=0.5, fbeta_name="fbeta_change"):
    """Pair metrics at every threshold from one pass over the scores.

    Each score is counted in the bin of the thresholds it reaches; the counts at a
    threshold are sums over a table of bins, whose size is the number of thresholds.
    A missing score (NULL or NaN) reaches no threshold.
    """
    thresholds = sorted(threshold_grid() if thresholds is None else (float(t) for t in thresholds))
    grid = F.lit(thresholds)
    reached = _reached(F.col("__p"), thresholds)
    bins = (
        df.select(F.col(label).alias("__y"), number(prob).alias("__p"))
        .groupBy(reached.alias("__bin"))
        .agg(_count(F.col("__y") == 1).alias("pos"), _count(F.col("__y") == 0).alias("neg"))
    )
    empty = df.sparkSession.range(len(thresholds)).select(
        (F.col("id").cast("int") + 1).alias("__bin"),
        F.lit(0).cast("bigint").alias("pos"),
        F.lit(0).cast("bigint").alias("neg"),
    )
    # from here on at most two rows per threshold
    filled = bins.unionByName(empty).groupBy("__bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    upwards = W.orderBy(F.desc("__bin")).rowsBetween(W.unboundedPreceding, 0)
    whole = W.orderBy(F.desc("__bin")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    counts = filled.select(
        "__bin",
        F.sum("pos").over(upwards).alias("tp"),
        F.sum("neg").over(upwards).alias("fp"),
        F.sum("pos").over(whole).alias("__pos"),
        F.sum("neg").over(whole).alias("__neg"),
    ).filter(F.col("__bin") > 0)
    counts = counts.select(
        F.element_at(grid, F.col("__bin")).alias("threshold"),
        (F.col("__neg") - F.col("fp")).alias("tn"),
        "fp",
        (F.col("__pos") - F.col("tp")).alias("fn"),
        "tp",
    )
    return pair_metrics(counts, beta, fbeta_name)


def choose_threshold(sweep, rule=ThresholdRule(), fbeta="fbeta_change"):
    """Best threshold under the constraints, else the best of all with `used_fallback`."""
    valid = (F.col("recall_change") >= rule.min_recall) & (F.col("false_positive_rate") <= rule.max_fpr)
    best = sweep.withColumn("used_fallback", ~valid).orderBy(
        F.asc("used_fallback"),
        F.desc(fbeta),
        F.desc("precision_change"),
        F.asc("false_positive_rate"),
        F.desc("recall_change"),
        F.asc("threshold"),
    )
    return best.limit(1)


def class_counts(df, label="label", pred="pred"):
    """Rows per (label, prediction) pair: the confusion matrix in long form."""
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_report(counts):
    """Precision, recall, F1 and support per class from `class_counts`."""
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    n = F.col("n")

    def side(name, tp, support, chosen):
        return counts.select(
            F.col(name).alias("cls"), tp.alias("tp"), support.alias("support"), chosen.alias("chosen")
        )

    true_side, pred_side = side("label", hit, n, zero), side("pred", zero, zero, n)
    sums = true_side.unionByName(pred_side).groupBy("cls").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("chosen").alias("chosen")
    )
    tp, support, chosen = F.col("tp"), F.col("support"), F.col("chosen")
    return sums.select(
        "cls",
        _ratio(tp, chosen).alias("precision"),
        _ratio(tp, support).alias("recall"),
        _ratio(2 * tp, support + chosen).alias("f1"),
        "support",
        "tp",
    )


def classification_report(df, label="label", pred="pred"):
    """Per-class rows followed by accuracy, macro and weighted averages."""
    per_class = class_report(class_counts(df, label, pred))
    names = ("precision", "recall", "f1")
    averages = per_class.agg(
        *[F.avg(n).alias(f"macro_{n}") for n in names],
        *[
            F.try_divide(F.sum(F.col(n) * F.col("support")), F.sum("support")).alias(f"weighted_{n}")
            for n in names
        ],
        F.sum("support").alias("support"),
        F.try_divide(F.sum("tp").cast("double"), F.sum("support")).alias("accuracy"),
    )

    def line(name, values):
        fields = [F.lit(name).alias("entry")]
        fields += [v.alias(n) for n, v in zip(names, values)]
        return F.struct(*fields, F.col("support").alias("support"))

    none = F.lit(None).cast("double")
    summary = averages.select(
        F.explode(
            F.array(
                line("accuracy", [none, none, F.col("accuracy")]),
                line("macro avg", [F.col(f"macro_{n}") for n in names]),
                line("weighted avg", [F.col(f"weighted_{n}") for n in names]),
            )
        ).alias("r")
    ).select("r.*")
    rows = per_class.select(F.col("cls").cast("string").alias("entry"), *names, "support")
    return rows.unionByName(summary)


def class_metrics(df, label="label", pred="pred"):
    """Macro F1, balanced accuracy, both recalls and the 2 x 2 matrix, in one row."""
    return metrics_from_matrix(confusion_counts(df, label, pred))


def metrics_from_matrix(counts, keep=()):
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    f1_one, f1_zero = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fp + fn)
    type1, type2 = _ratio(tn, tn + fp), _ratio(tp, tp + fn)
    # a class that occurs neither as label nor as prediction does not count
    has_zero, has_one = (tn + fp + fn) > 0, (tp + fp + fn) > 0
    classes = has_zero.cast("int") + has_one.cast("int")
    labels = ((tn + fp) > 0).cast("int") + ((tp + fn) > 0).cast("int")
    return counts.select(
        *keep,
        F.try_divide(f1_zero + f1_one, classes).alias("macro_f1"),
        F.try_divide(type1 + type2, labels).alias("balanced_accuracy"),
        type1.alias("type1_recall"),
        type2.alias("type2_recall"),
        F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix"),
    )


def rank_metrics(df, label="label", prob="prob", partitions=None):
    """ROC-AUC and average precision, exact with ties; NULL when a class is absent.

    Rows without a score (NULL or NaN) have no rank and are left out.
    """
    per_score = (
        df.select(F.col(label).alias("y"), number(prob).alias("p"))
        .filter(F.col("p").isNotNull())
        .groupBy((-F.col("p")).alias("down"))
        .agg(_count(F.col("y") == 1).alias("pos"), _count(F.col("y") == 0).alias("neg"))
    )
    # from the highest score down: positives and negatives at or above each score
    totals = with_running_totals(
        per_score, "down", {"tp": F.col("pos"), "fp": F.col("neg")}, partitions
    )
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    sums = totals.agg(
        F.sum("pos").alias("all_pos"),
        F.sum("neg").alias("all_neg"),
        # a negative loses to every positive above it and to half of those tied with it
        F.sum(neg * (tp - pos + pos / F.lit(2.0))).alias("wins"),
        F.sum(pos * F.try_divide(tp.cast("double"), tp + fp)).alias("area"),
    )
    both = (F.col("all_pos") > 0) & (F.col("all_neg") > 0)
    return sums.select(
        F.when(both, F.try_divide(F.col("wins"), F.col("all_pos").cast("double") * F.col("all_neg"))).alias(
            "roc_auc"
        ),
        F.when(both, F.try_divide(F.col("area"), F.col("all_pos"))).alias("average_precision"),
    )


def score_summary(df, label="label", prob="prob"):
    """Row count, positives, and mean and median of the scores that are not missing."""
    middle = median(df, prob)
    return df.agg(
        F.count("*").alias("n"),
        F.sum(F.col(label).cast("bigint")).alias("positives"),
        F.avg(F.col(label).cast("double")).alias("positive_fraction"),
        F.avg(number(prob)).alias("mean_prob"),
        F.lit(middle).cast("double").alias("median_prob"),
    )


def median(df, col):
    """Exact median of a column; NULL if it has no value."""
    low, high = ranked_values(df, col, lambda n: (n - 1) // 2, lambda n: n // 2)
    return None if low is None else (low + high) / 2


def category_counts(df, column):
    return df.groupBy(column).agg(F.count("*").alias("count"))
