"""Spectrum columns computed by Arrow UDFs over whole batches."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..settings import (
    CONTINUUM_WINDOW,
    SKY_LINE_CENTER,
    SKY_LINE_THRESHOLD,
    SKY_LINE_WINDOW,
    TAPER_LEN,
)
from . import kernels


def _lists(column):
    """Offsets, flat values (NaN for NULL) and validity of an Arrow list array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy(zero_copy_only=False)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    return offsets, values, column.is_valid().to_numpy(zero_copy_only=False)


# rows per matrix: keeps a kernel's temporaries at some MB however large the Arrow batch is
CHUNK = 1024


def _by_length(columns):
    """Yield (row numbers, one matrix per column) for groups of equally long rows."""
    parts = [_lists(c) for c in columns]
    lengths = [np.diff(p[0]) for p in parts]
    usable = np.logical_and.reduce([p[2] for p in parts])
    for other in lengths[1:]:
        usable &= lengths[0] == other
    for size in np.unique(lengths[0][usable]) if usable.any() else ():
        found = np.flatnonzero(usable & (lengths[0] == size))
        index = np.arange(size)
        for start in range(0, len(found), CHUNK):
            rows = found[start : start + CHUNK]
            yield rows, [p[1][p[0][rows][:, None] + index] for p in parts]


def _pack_lists(count, blocks, kind=pa.float64()):
    """Build a list array of `count` rows from (rows, matrix) blocks; other rows are NULL."""
    lengths = np.zeros(count, dtype=np.int64)
    valid = np.zeros(count, dtype=bool)
    for rows, matrix in blocks:
        lengths[rows] = matrix.shape[1]
        valid[rows] = True
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    values = np.empty(offsets[-1], dtype=float)
    for rows, matrix in blocks:
        values[offsets[rows][:, None] + np.arange(matrix.shape[1])] = matrix
    return pa.ListArray.from_arrays(
        pa.array(offsets.astype(np.int32)),
        pa.array(values).cast(kind),
        mask=pa.array(~valid),
    )


def _numbers(values):
    """Float array with NaN as NULL."""
    return pa.array(values, type=pa.float64(), mask=np.isnan(values))


def _once(udf):
    """Keep the optimizer from evaluating a costly kernel twice.

    A filter on the result of a deterministic UDF is moved below the projection and takes a
    copy of the call along. Filter on other columns before calling these kernels.
    """
    return udf.asNondeterministic()


def _matrix_udf(kernel, min_pixels=1):
    """Apply `kernel` to the rows with enough pixels; the others become NULL."""

    @F.arrow_udf("array<double>")
    def apply(x: pa.Array) -> pa.Array:
        groups = [(rows, m) for rows, (m,) in _by_length([x]) if m.shape[1] >= min_pixels]
        return _pack_lists(len(x), [(rows, kernel(m)) for rows, m in groups])

    return _once(apply)


def continuum_subtracted(x, window=CONTINUUM_WINDOW):
    """x minus its mirrored running mean; NULL where the vector is too short to mirror."""

    return _matrix_udf(lambda m: kernels.subtract_continuum(m, window), window // 2 + 1)(x)


def filled(x):
    """NaN pixels replaced by the row median."""
    return _matrix_udf(lambda m: kernels.fill_missing(m)[0])(x)


def mad_normalized(x, taper_len=TAPER_LEN):
    """Struct of the robustly scaled, tapered vector with its median and MAD."""

    @F.arrow_udf("struct<normalized: array<double>, median: double, mad: double>")
    def apply(x: pa.Array) -> pa.Array:
        middle, mad, blocks = np.full(len(x), np.nan), np.full(len(x), np.nan), []
        for rows, (m,) in _by_length([x]):
            middle[rows], mad[rows] = kernels.median_and_mad(m)
            blocks.append((rows, kernels.taper(kernels.scale_by_mad(m, middle[rows], mad[rows]), taper_len)))
        return pa.StructArray.from_arrays(
            [_pack_lists(len(x), blocks), _numbers(middle), _numbers(mad)], ["normalized", "median", "mad"]
        )

    return _once(apply)(x)


def pair_mad_normalized(first, second, taper_len=TAPER_LEN):
    """Both vectors scaled by one median and MAD over their concatenation."""

    @F.arrow_udf("struct<first: array<double>, second: array<double>, median: double, mad: double>")
    def apply(first: pa.Array, second: pa.Array) -> pa.Array:
        n = len(first)
        middle, mad, left, right = np.full(n, np.nan), np.full(n, np.nan), [], []
        for rows, (a, b) in _by_length([first, second]):
            middle[rows], mad[rows] = kernels.median_and_mad(np.concatenate([a, b], axis=1))
            for m, out in ((a, left), (b, right)):
                out.append((rows, kernels.taper(kernels.scale_by_mad(m, middle[rows], mad[rows]), taper_len)))
        return pa.StructArray.from_arrays(
            [_pack_lists(n, left), _pack_lists(n, right), _numbers(middle), _numbers(mad)],
            ["first", "second", "median", "mad"],
        )

    return _once(apply)(first, second)


def _measure_udf(kernel, grid, line):
    grid = np.asarray(grid, dtype=float)

    @F.arrow_udf("double")
    def apply(x: pa.Array) -> pa.Array:
        out = np.full(len(x), np.nan)
        for rows, (m,) in _by_length([x]):
            if m.shape[1] == len(grid):
                out[rows] = kernel(m, grid, line)
        return _numbers(out)

    return apply


def line_flux(x, grid, line):
    return _measure_udf(kernels.line_flux, grid, line)(x)


def wing_score(x, grid, line):
    return _measure_udf(kernels.wing_score, grid, line)(x)


def peak_above_median(x, grid, line):
    return _measure_udf(kernels.peak_above_median, grid, line)(x)


#: a pair's measurements: one Python hop for all of them
SIDES = ("dr16", "sdssv")
LINES = ("hb", "ha")
SCALINGS = ("flat", "ind", "pair")
MEASUREMENTS = (
    *[f"{s}_ind_{m}" for s in SIDES for m in ("median", "mad")],
    "pair_shared_median",
    "pair_shared_mad",
    *[f"{line}_paper_flux_{s}" for line in LINES for s in SIDES],
    *[f"{line}_{kind}_wing_{s}" for kind in SCALINGS for line in LINES for s in SIDES],
    *[f"{line}_{kind}_peak_{s}" for kind in SCALINGS[:2] for line in LINES for s in SIDES],
)


def pair_measurements(first, second, grid, window=CONTINUUM_WINDOW, taper_len=TAPER_LEN):
    """Struct of `MEASUREMENTS` of a pair of grid spectra; NULL where a vector is missing or does not fit."""
    grid = np.asarray(grid, dtype=float)

    def bands(out, rows, x, kind, side, peak=True):
        if x.shape[1] == len(grid):
            for line in LINES:
                out[f"{line}_{kind}_wing_{side}"][rows] = kernels.wing_score(x, grid, line)
                if peak:
                    out[f"{line}_{kind}_peak_{side}"][rows] = kernels.peak_above_median(x, grid, line)

    def one_side(out, rows, raw, side):
        """Fills in what one spectrum gives alone; returns it without continuum, or None if it is too short."""
        if raw.shape[1] == len(grid):
            for line in LINES:
                out[f"{line}_paper_flux_{side}"][rows] = kernels.line_flux(raw, grid, line)
        if raw.shape[1] <= window // 2:
            return None
        flat = kernels.subtract_continuum(raw, window)
        middle, mad = kernels.median_and_mad(flat)
        out[f"{side}_ind_median"][rows], out[f"{side}_ind_mad"][rows] = middle, mad
        bands(out, rows, flat, "flat", side)
        bands(out, rows, kernels.taper(kernels.scale_by_mad(flat, middle, mad), taper_len), "ind", side)
        return flat

    @F.arrow_udf("struct<" + ", ".join(f"{m}: double" for m in MEASUREMENTS) + ">")
    def apply(first: pa.Array, second: pa.Array) -> pa.Array:
        n = len(first)
        out = {m: np.full(n, np.nan) for m in MEASUREMENTS}
        both = np.zeros(n, dtype=bool)
        for rows, pair in _by_length([first, second]):
            both[rows] = True
            flats = [one_side(out, rows, m, s) for m, s in zip(pair, SIDES)]
            if flats[0] is not None:
                middle, mad = kernels.median_and_mad(np.concatenate(flats, axis=1))
                out["pair_shared_median"][rows], out["pair_shared_mad"][rows] = middle, mad
                for flat, side in zip(flats, SIDES):
                    bands(out, rows, kernels.taper(kernels.scale_by_mad(flat, middle, mad), taper_len), "pair", side, peak=False)
        for column, side in zip((first, second), SIDES):
            for rows, (m,) in _by_length([column]):
                alone = ~both[rows]
                if alone.any():
                    one_side(out, rows[alone], m[alone], side)
        return pa.StructArray.from_arrays([_numbers(out[m]) for m in MEASUREMENTS], list(MEASUREMENTS))

    return _once(apply)(first, second)


def pixel_stats(x):
    """Struct of zero fraction, largest and smallest value and whether any pixel is finite."""

    @F.arrow_udf("struct<zero_fraction: double, high: double, low: double, any_finite: boolean>")
    def apply(x: pa.Array) -> pa.Array:
        n = len(x)
        zero, high, low = (np.full(n, np.nan) for _ in range(3))
        some = np.zeros(n, dtype=bool)
        for rows, (m,) in _by_length([x]):
            if m.shape[1] == 0:
                continue
            zero[rows] = (m == 0).mean(axis=1)
            gaps = np.isnan(m)
            known = ~gaps.all(axis=1)
            high[rows] = np.where(known, np.where(gaps, -np.inf, m).max(axis=1), np.nan)
            low[rows] = np.where(known, np.where(gaps, np.inf, m).min(axis=1), np.nan)
            some[rows] = np.isfinite(m).any(axis=1)
        return pa.StructArray.from_arrays(
            [_numbers(zero), _numbers(high), _numbers(low), pa.array(some)],
            ["zero_fraction", "high", "low", "any_finite"],
        )

    return apply(x)


def _row(parts, i):
    offsets, values, _ = parts
    return values[offsets[i] : offsets[i + 1]]


def repaired_sky_line(
    wave, flux, center=SKY_LINE_CENTER, window=SKY_LINE_WINDOW, threshold=SKY_LINE_THRESHOLD
):
    @F.arrow_udf("array<double>")
    def apply(wave: pa.Array, flux: pa.Array) -> pa.Array:
        waves, fluxes = _lists(wave), _lists(flux)
        blocks = []
        for i in np.flatnonzero(waves[2] & fluxes[2]):
            fixed = kernels.repair_sky_line(_row(waves, i), _row(fluxes, i), center, window, threshold)
            blocks.append((np.array([i]), fixed[None, :]))
        return _pack_lists(len(wave), blocks)

    return _once(apply)(wave, flux)


def resampled(wave, flux, grid):
    """Values on `grid` by linear interpolation; NaN where the input does not reach."""
    grid = np.asarray(grid, dtype=float)

    @F.arrow_udf("array<double>")
    def apply(wave: pa.Array, flux: pa.Array) -> pa.Array:
        waves, fluxes = _lists(wave), _lists(flux)
        rows = np.flatnonzero(waves[2] & fluxes[2])
        matrix = np.empty((len(rows), len(grid)))
        for at, i in enumerate(rows):
            matrix[at] = kernels.resample(_row(waves, i), _row(fluxes, i), grid)
        return _pack_lists(len(wave), [(rows, matrix)])

    return _once(apply)(wave, flux)


PREPARED = "struct<flux: array<float>, raw: array<float>, n_filled: int, error: string>"


def prepared_spectrum(
    wave,
    flux,
    z,
    grid,
    window=CONTINUUM_WINDOW,
    taper_len=TAPER_LEN,
    mad_scaling=False,
    sanitize=False,
    keep_raw=False,
):
    """Observed spectrum to processed vector in one pass over each Arrow batch.

    Sky-line repair, rest frame, interpolation, median fill, continuum subtraction,
    optional robust scaling, taper. `sanitize` drops non-finite samples first and makes
    a spectrum without overlap an error, as for real pairs. Rows that cannot be
    processed have a NULL vector and an error text.
    """
    grid = np.asarray(grid, dtype=float)

    def one(w, f, redshift):
        if len(w) != len(f) or len(w) == 0:
            raise ValueError("wavelength and flux differ in length" if len(w) != len(f) else "empty spectrum")
        if sanitize:
            good = np.isfinite(w) & np.isfinite(f)
            order = np.argsort(w[good], kind="stable")
            w, f = w[good][order], f[good][order]
        f = kernels.repair_sky_line(w, f)
        return kernels.resample(w / (1 + redshift), f * (1 + redshift), grid)

    @F.arrow_udf(PREPARED)
    def apply(wave: pa.Array, flux: pa.Array, z: pa.Array) -> pa.Array:
        waves, fluxes = _lists(wave), _lists(flux)
        redshifts = z.cast(pa.float64()).to_numpy(zero_copy_only=False)
        n = len(redshifts)
        errors, rows, grids = [None] * n, [], []
        for i in range(n):
            if not (waves[2][i] and fluxes[2][i]):
                errors[i] = "no wavelength or flux"
            elif np.isnan(redshifts[i]) or (sanitize and np.isinf(redshifts[i])):
                errors[i] = "invalid redshift"
            else:
                try:
                    grids.append(one(_row(waves, i), _row(fluxes, i), redshifts[i]))
                    rows.append(i)
                except Exception as problem:  # one bad spectrum must not end the job
                    errors[i] = str(problem) or type(problem).__name__
        counts = np.zeros(n, dtype=np.int32)
        done, raws = [], []
        for start in range(0, len(rows), CHUNK):
            chunk = np.array(rows[start : start + CHUNK])
            x, gaps, middle = kernels.fill_missing(np.stack(grids[start : start + CHUNK]))
            counts[chunk] = gaps
            if sanitize:
                overlap = np.isfinite(middle)
                for i in chunk[~overlap]:
                    errors[i] = "no wavelength overlap"
                chunk, x = chunk[overlap], x[overlap]
            if not len(chunk):
                continue
            # single precision from here on, as the stored vectors are
            x = x.astype(np.float32).astype(float)
            if keep_raw:
                raws.append((chunk, x))
            try:
                y = kernels.subtract_continuum(x, window)
            except ValueError as problem:
                for i in chunk:
                    errors[i] = str(problem)
                continue
            if mad_scaling:
                y = kernels.scale_by_mad(y, *kernels.median_and_mad(y))
            done.append((chunk, kernels.taper(y, taper_len)))
        ok = np.zeros(n, dtype=bool)
        for used, _ in done:
            ok[used] = True
        return pa.StructArray.from_arrays(
            [
                _pack_lists(n, done, pa.float32()),
                _pack_lists(n, raws, pa.float32()),
                pa.array(counts, type=pa.int32(), mask=~ok),
                pa.array(errors, type=pa.string()),
            ],
            ["flux", "raw", "n_filled", "error"],
        )

    return _once(apply)(wave, flux, z)
