"""Random masks, derived from a row key so that a rerun masks the same pixels."""

import numpy as np
from pyspark.sql import functions as F

from ..settings import (
    EXTRA_MASK_LENGTHS,
    EXTRA_MASK_PROBABILITY,
    RANDOM_MASK_MAX_FRACTION,
    RANDOM_MASK_MIN_FRACTION,
    RANDOM_MASK_REGIONS,
)
from .hashing import integer_below, uniform
from .vectors import zero_span


def line_mask_span(keys, seed, grid, regions=RANDOM_MASK_REGIONS, stream="line"):
    """(start, length) of a random stretch inside one randomly chosen region."""
    grid = np.asarray(grid)
    spans = []
    for low, high in regions:
        inside = np.flatnonzero((grid >= low) & (grid <= high))
        spans.append((int(inside[0]) if len(inside) else 0, len(inside)))
    choice = integer_below(uniform(keys, seed, stream + "/region"), len(regions))
    length_u = uniform(keys, seed, stream + "/length")
    start_u = uniform(keys, seed, stream + "/start")
    start, length = None, None
    for i, (first, count) in enumerate(spans):
        if count < 2:
            continue
        low = max(2, int(RANDOM_MASK_MIN_FRACTION * count))
        high = max(low, int(RANDOM_MASK_MAX_FRACTION * count))
        n = F.lit(low) + integer_below(length_u, high - low + 1)
        s = F.lit(first) + integer_below(start_u, F.lit(count) - n + 1)
        start = F.when(choice == i, s) if start is None else start.when(choice == i, s)
        length = F.when(choice == i, n) if length is None else length.when(choice == i, n)
    if start is None:
        return F.lit(None).cast("int"), F.lit(None).cast("int")
    return start, length


def extra_mask_span(
    keys, seed, size, probability=EXTRA_MASK_PROBABILITY, lengths=EXTRA_MASK_LENGTHS, stream="extra"
):
    """(start, length) anywhere in the vector, drawn with the given probability."""
    low, high = lengths[0], min(lengths[1], size - 1)
    if size <= low:
        return F.lit(None).cast("int"), F.lit(None).cast("int")
    drawn = uniform(keys, seed, stream + "/draw") <= probability
    n = F.lit(low) + integer_below(uniform(keys, seed, stream + "/length"), high - low + 1)
    s = integer_below(uniform(keys, seed, stream + "/start"), F.lit(size) - n + 1)
    return F.when(drawn, s), F.when(drawn, n)


def random_masks(x, keys, seed, grid):
    """The line mask, then the extra mask."""
    masked = zero_span(x, *line_mask_span(keys, seed, grid))
    return zero_span(masked, *extra_mask_span(keys, seed, len(grid)))
