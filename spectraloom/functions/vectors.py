"""Element-wise vector columns in built-in higher-order functions."""

import numpy as np
from pyspark.sql import functions as F

from ..settings import ABLATION_REGIONS, EPS, TAPER_LEN


def doubles(values):
    """A constant vector as a literal array column."""
    return F.lit([float(v) for v in values])


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def wavelength_axis(flux, loglam=None, wavelength=None, coeff0=None, coeff1=None, crval1=None, cdelt1=None):
    """Wavelengths from 10^loglam, else as given, else from a linear or log-linear header."""
    index = F.sequence(F.lit(0), F.size(_col(flux)) - 1)
    options = []
    if loglam is not None:
        options.append(F.transform(_col(loglam), lambda x: F.pow(F.lit(10.0), x)))
    if wavelength is not None:
        options.append(_col(wavelength).cast("array<double>"))
    if coeff0 is not None:
        start, step = _col(coeff0), _col(coeff1)
        log_linear = F.transform(index, lambda i: F.pow(F.lit(10.0), start + i * step))
        options.append(F.when(start.isNotNull(), log_linear))
    if crval1 is not None:
        first, width = _col(crval1), _col(cdelt1)
        options.append(F.when(first.isNotNull(), F.transform(index, lambda i: first + i * width)))
    return F.coalesce(*options)


def finite_sorted(wave, flux):
    """Array of (wave, flux) with non-finite samples dropped, ordered by wavelength."""
    infinity = F.lit(float("inf"))

    def good(x):
        return ~F.isnan(x) & (F.abs(x) < infinity)

    zipped = F.zip_with(
        _col(wave).cast("array<double>"),
        _col(flux).cast("array<double>"),
        lambda w, f: F.struct(w.alias("wave"), f.alias("flux")),
    )
    kept = F.filter(zipped, lambda s: F.coalesce(good(s["wave"]) & good(s["flux"]), F.lit(False)))
    return F.array_sort(kept)


def rest_frame(wave, flux, z):
    """wave/(1+z) and flux*(1+z)."""
    stretch = F.lit(1.0) + _col(z)
    return (
        F.transform(_col(wave), lambda w: w / stretch),
        F.transform(_col(flux), lambda f: f * stretch),
    )


def taper_weights(size, taper_len=TAPER_LEN):
    """Distance to the nearer edge in steps of the fade, at most 1."""
    place = np.arange(size)
    edge = np.minimum(place, size - 1 - place)
    return np.minimum(edge / max(taper_len - 1, 0.5), 1.0)


def edge_taper(x, size, taper_len=TAPER_LEN):
    return F.zip_with(_col(x), doubles(taper_weights(size, taper_len)), lambda v, w: v * w)


def ablate(x, grid, regions=ABLATION_REGIONS):
    """Zero the pixels inside the closed wavelength regions."""
    grid = np.asarray(grid)
    keep = np.ones(len(grid), dtype=bool)
    for low, high in regions:
        keep &= ~((grid >= low) & (grid <= high))
    mask = F.lit([bool(k) for k in keep])
    return F.zip_with(_col(x), mask, lambda v, k: F.when(k, v).otherwise(F.lit(0)))


def let(values, body):
    """Evaluate the named columns once per row and hand them to `body` as a struct.

    An outer expression used inside a lambda is evaluated again for every element,
    which would turn a linear pass over a spectrum into a quadratic one.
    """
    bound = F.array(F.struct(*[value.alias(name) for name, value in values.items()]))
    return F.get(F.transform(bound, body), F.lit(0))


def zero_span(x, start, length):
    """Zero `length` values from position `start`; missing start leaves `x` unchanged.

    Three slices put together: nothing is evaluated per value.
    """
    x, start, length = _col(x), _col(start).cast("int"), _col(length).cast("int")
    size = F.size(x)
    first = F.least(F.greatest(start, F.lit(0)), size)
    stop = F.least(F.greatest(start + length, first), size)
    zeros = F.array_repeat(F.lit(0), stop - first)
    cut = F.concat(F.slice(x, F.lit(1), first), zeros, F.slice(x, stop + 1, size - stop))
    return F.when(start.isNull() | length.isNull(), x).otherwise(cut)


def _total(x):
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def standardize(x, sample=False):
    """(x - mean) / (std + eps), ignoring NaN; population std unless `sample`."""
    x = _col(x).cast("array<double>")
    valid = F.filter(x, lambda v: v.isNotNull() & ~F.isnan(v))

    def centred(s):
        n = F.size(s["valid"])
        return let({"x": s["x"], "valid": s["valid"], "mean": F.try_divide(_total(s["valid"]), n)}, scaled)

    def scaled(s):
        squares = F.transform(s["valid"], lambda v: (v - s["mean"]) * (v - s["mean"]))
        n = F.size(s["valid"]) - (1 if sample else 0)
        std = F.sqrt(F.try_divide(_total(squares), n))
        return let({"x": s["x"], "mean": s["mean"], "std": std}, result)

    def result(s):
        return F.transform(s["x"], lambda v: (v - s["mean"]) / (s["std"] + F.lit(EPS)))

    return let({"x": x, "valid": valid}, centred)


def pool_mean_max(channels):
    """Per-channel means followed by per-channel maxima of an array of channels."""
    channels = _col(channels)
    return F.concat(
        F.transform(channels, lambda c: _total(c.cast("array<double>")) / F.size(c)),
        F.transform(channels, lambda c: F.array_max(c).cast("double")),
    )


def fuse_pair(a, b):
    """a, b and |a - b| in one vector."""
    a, b = _col(a), _col(b)
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def signed_max_abs(x):
    """Divide by the largest magnitude, keeping the sign."""
    x = _col(x).cast("array<double>")
    peak = F.array_max(F.transform(x, lambda v: F.abs(v))) + F.lit(EPS)
    return let({"x": x, "peak": peak}, lambda s: F.transform(s["x"], lambda v: v / s["peak"]))


def min_max(x):
    x = _col(x).cast("array<double>")

    def body(s):
        width = (s["high"] - s["low"]) + F.lit(EPS)
        return F.transform(s["x"], lambda v: (v - s["low"]) / width)

    return let({"x": x, "low": F.array_min(x), "high": F.array_max(x)}, body)


def upsample(x, size):
    """Linear resampling to `size` values, half-pixel centres, edges clamped."""

    def body(s):
        def at(i):
            position = F.greatest((i + 0.5) * s["n"] / F.lit(float(size)) - 0.5, F.lit(0.0))
            left = F.floor(position).cast("int")
            right = F.least(left + 1, s["n"] - 1)
            share = position - left
            return F.get(s["x"], left) * (1 - share) + F.get(s["x"], right) * share

        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at)

    x = _col(x).cast("array<double>")
    return let({"x": x, "n": F.size(x)}, body)


def mean_matrix(stack):
    """Element-wise mean of a stack of equally sized matrices (one per head)."""

    def add(a, b):
        return F.zip_with(a, b, lambda r, s: F.zip_with(r, s, lambda x, y: x + y))

    def body(s):
        rest = F.slice(s["stack"], F.lit(2), F.greatest(s["heads"] - 1, F.lit(0)))
        total = F.aggregate(rest, F.get(s["stack"], F.lit(0)), add)
        return F.transform(total, lambda row: F.transform(row, lambda v: v / s["heads"]))

    stack = _col(stack).cast("array<array<array<double>>>")
    return let({"stack": stack, "heads": F.size(stack)}, body)


def received_weight(matrix):
    """Column sums of a matrix given as an array of rows."""
    matrix = _col(matrix).cast("array<array<double>>")
    rest = F.slice(matrix, F.lit(2), F.greatest(F.size(matrix) - 1, F.lit(0)))
    return F.aggregate(rest, F.get(matrix, F.lit(0)), lambda a, row: F.zip_with(a, row, lambda x, y: x + y))


def peak_wavelength(x, grid):
    """Wavelength at the first maximum."""
    x = _col(x)
    return F.element_at(doubles(grid), F.array_position(x, F.array_max(x)).cast("int"))
