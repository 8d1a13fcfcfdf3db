"""Logits, decisions and the focal loss."""

from pyspark.sql import functions as F

from .missing import number


def sigmoid(logit):
    logit = F.col(logit) if isinstance(logit, str) else logit
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def decide(prob, threshold=0.5):
    """1 where the score reaches the threshold; a missing score (NULL or NaN) reaches none."""
    threshold = threshold if not isinstance(threshold, (int, float)) else F.lit(float(threshold))
    return F.coalesce((number(prob) >= threshold).cast("int"), F.lit(0))


def focal_loss(logit, target, alpha=0.25, gamma=2.0):
    """Binary focal loss of one logit; aggregate with avg or sum for a reduction."""
    x = (F.col(logit) if isinstance(logit, str) else logit).cast("double")
    t = (F.col(target) if isinstance(target, str) else target).cast("double")
    # log(1 + e^-|x|) keeps the cross entropy stable for large |x|
    entropy = F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))
    p = sigmoid(x)
    p_true = p * t + (F.lit(1.0) - p) * (F.lit(1.0) - t)
    weight = t * F.lit(float(alpha)) + (F.lit(1.0) - t) * F.lit(1.0 - alpha)
    return weight * F.pow(F.lit(1.0) - p_true, F.lit(float(gamma))) * entropy
