"""Best runs, best epochs and the diagnostic sample of predictions."""

from pyspark.sql import functions as F

from ..functions.missing import number
from .dedup import keep_first


def best_run(results, select_on="test", order="run_order"):
    """Run with the highest macro F1, then balanced accuracy; the earliest on ties, missing values last."""
    values = [number(f"{select_on}_metrics.{name}") for name in ("macro_f1", "balanced_accuracy")]
    return results.orderBy(*[v.desc_nulls_last() for v in values], F.asc(order)).limit(1)


def best_epoch(log, run="run_name", epoch="epoch", scores=("fbeta", "precision_change")):
    """Per run the first epoch with the highest score tuple; prefix '-' to minimise one.

    A missing score (NULL or NaN) is below every other.
    """
    kinds, parts = dict(log.dtypes), []
    for i, name in enumerate(scores):
        column = name.removeprefix("-")
        value = number(column) if kinds[column] in ("float", "double") else F.col(column)
        value = -value if name.startswith("-") else value
        parts.append(value.alias(f"s{i}"))
    rank = F.struct(*parts, (-F.col(epoch)).alias("e"))
    rest = [c for c in log.columns if c != run]
    best = log.groupBy(run).agg(F.max_by(F.struct(*rest), rank).alias("__row"))
    return best.select(run, "__row.*")


GROUP_KEYS = ("sdssid", "specname_dr16", "specname_sdssv")


def diagnostic_sample(
    pred,
    n_false_negatives=20,
    n_true_positives=10,
    n_false_positives=10,
    n_top_candidates=10,
    keys=GROUP_KEYS,
):
    """Lowest-scored misses and highest-scored positives, negatives and pairs overall.

    A pair that qualifies for several groups is kept in the first of them. Pairs without a score
    (NULL or NaN) come last in every group.
    """
    keys = list(keys)
    prob = number("prob_change")

    def top(rows, order, n, rank, name):
        chosen = rows.orderBy(order, *keys).limit(n)
        return chosen.withColumns({"diagnostic_group": F.lit(name), "group_rank": F.lit(rank)})

    positive, negative = F.col("true_label") == 1, F.col("true_label") == 0
    missed = pred.filter(positive & (F.col("pred_label") == 0))
    groups = [
        top(missed, prob.asc_nulls_last(), n_false_negatives, 1, "false_negative_lowest_prob"),
        top(pred.filter(positive), prob.desc_nulls_last(), n_true_positives, 2, "true_change_highest_prob"),
        top(pred.filter(negative), prob.desc_nulls_last(), n_false_positives, 3, "static_highest_prob"),
        top(pred, prob.desc_nulls_last(), n_top_candidates, 4, "top_candidates_overall"),
    ]
    sample = groups[0]
    for group in groups[1:]:
        sample = sample.unionByName(group)
    return keep_first(sample, keys, ["group_rank", "prob_change"])
