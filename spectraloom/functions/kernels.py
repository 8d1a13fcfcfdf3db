"""NumPy kernels over a batch of spectra (rows x pixels); no Spark in here.

They run inside Arrow batches: Spark partitions the rows, NumPy works on each batch.
"""

import numpy as np

from ..settings import (
    EPS,
    LINE_BANDS,
    MAD_TO_SIGMA,
    PEAK_REGION,
    SKY_LINE_CENTER,
    SKY_LINE_THRESHOLD,
    SKY_LINE_WINDOW,
    WING_WINDOWS,
)
from .vectors import taper_weights


def repair_sky_line(
    wave, flux, center=SKY_LINE_CENTER, window=SKY_LINE_WINDOW, threshold=SKY_LINE_THRESHOLD
):
    """Replace a spike at the night-sky line by a line through its side bands."""
    core = (wave > center - window / 2) & (wave < center + window / 2)
    blue = (wave > center - window * 1.5) & (wave <= center - window / 2)
    red = (wave >= center + window / 2) & (wave < center + window * 1.5)
    side = blue | red
    if not core.any() or side.sum() < 2:
        return flux
    around, peak = flux[side], flux[core]
    if np.isnan(around).all() or np.isnan(peak).all():
        return flux
    spread = np.nanstd(around)
    if not (spread > 0 and np.nanmax(peak) > np.nanmedian(around) + threshold * spread):
        return flux
    order = np.argsort(wave[side], kind="stable")
    xs, ys = wave[side][order], around[order]
    at = wave[core]
    right = np.clip(np.searchsorted(xs, at), 1, len(xs) - 1)
    left = right - 1
    slope = (ys[right] - ys[left]) / (xs[right] - xs[left])
    repaired = flux.copy()
    repaired[core] = ys[left] + slope * (at - xs[left])
    return repaired


def resample(wave, flux, grid):
    """Linear interpolation onto `grid`, NaN outside the covered range."""
    if len(wave) == 0:
        return np.full(len(grid), np.nan)
    order = np.argsort(wave, kind="stable")
    return np.interp(grid, wave[order], flux[order], left=np.nan, right=np.nan)


def fill_missing(x):
    """NaN pixels become the median of the row's valid ones; also returns how many."""
    gaps = np.isnan(x)
    middle = np.full(len(x), np.nan)
    some = ~gaps.all(axis=1)
    if some.any():
        middle[some] = np.nanmedian(x[some], axis=1)
    filled = np.where(gaps, middle[:, None], x)
    # infinities become the largest finite value, as in the reference's fill
    filled = np.where(np.isinf(filled), np.copysign(np.finfo(float).max, filled), filled)
    return filled, gaps.sum(axis=1), middle


def box_mean(x, window):
    """Running mean with mirrored edges (edge pixel not repeated)."""
    half = window // 2
    if x.shape[1] <= half:
        raise ValueError(f"needs more than {half} pixels, got {x.shape[1]}")
    padded = np.pad(x, ((0, 0), (half, half)), mode="reflect")
    clean = np.isfinite(padded).all(axis=1)
    out = np.empty_like(x)
    if clean.any():
        sums = np.cumsum(padded[clean], axis=1)
        sums = np.concatenate([np.zeros((len(sums), 1)), sums], axis=1)
        out[clean] = (sums[:, window:] - sums[:, :-window]) / window
    if not clean.all():
        # a gap must only reach the windows that contain it
        views = np.lib.stride_tricks.sliding_window_view(padded[~clean], window, axis=1)
        out[~clean] = views.mean(axis=-1)
    return out


def subtract_continuum(x, window):
    return x - box_mean(x, window)


def lower_median(x):
    """The lower of the two middle values for even counts; NaN if a row holds one."""
    k = (x.shape[1] - 1) // 2
    middle = np.partition(x, k, axis=1)[:, k]
    return np.where(np.isnan(x).any(axis=1), np.nan, middle)


def median_and_mad(x):
    middle = lower_median(x)
    return middle, lower_median(np.abs(x - middle[:, None]))


def scale_by_mad(x, middle, mad):
    return (x - middle[:, None]) / (mad[:, None] * MAD_TO_SIGMA + EPS)


def taper(x, taper_len):
    return x * taper_weights(x.shape[1], taper_len)


def _inside(wave, band):
    return (wave >= band[0]) & (wave <= band[1])


def _row_median(x):
    out = np.full(len(x), np.nan)
    some = ~np.isnan(x).all(axis=1)
    if some.any():
        out[some] = np.nanmedian(x[some], axis=1)
    return out


def line_flux(x, wave, line):
    """Integral over the line band above a straight continuum between the side bands."""
    blue_band, red_band, line_band = LINE_BANDS[line]
    blue, red, core = (_inside(wave, b) for b in (blue_band, red_band, line_band))
    if min(blue.sum(), red.sum(), core.sum()) < 2:
        return np.full(len(x), np.nan)
    left, right = sum(blue_band) / 2, sum(red_band) / 2
    low, high = _row_median(x[:, blue]), _row_median(x[:, red])
    at = wave[core]
    share = np.clip((at - left) / (right - left), 0.0, 1.0)
    above = x[:, core] - (low[:, None] + (high - low)[:, None] * share)
    return ((above[:, 1:] + above[:, :-1]) / 2 * np.diff(at)).sum(axis=1)


def wing_score(x, wave, line):
    """Mean magnitude in the two windows beside the narrow core."""
    near, far = WING_WINDOWS[line]
    mask = _inside(wave, near) | _inside(wave, far)
    if not mask.any():
        return np.full(len(x), np.nan)
    return np.abs(x[:, mask]).mean(axis=1)


def peak_above_median(x, wave, line):
    mask = _inside(wave, PEAK_REGION[line])
    out = np.full(len(x), np.nan)
    if not mask.any():
        return out
    above = x[:, mask] - _row_median(x)[:, None]
    some = ~np.isnan(above).all(axis=1)
    if some.any():
        out[some] = np.nanmax(above[some], axis=1)
    return out
