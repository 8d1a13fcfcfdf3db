"""Line, scaling and wing diagnostics of selected pairs."""

from pyspark.sql import functions as F

from ..functions.lines import safe_ratio
from ..functions.spectra import LINES, MEASUREMENTS, SIDES, pair_measurements
from ..operators.joins import counted_side, with_errors
from ..session import freeze
from ..settings import CONTINUUM_WINDOW, TAPER_LEN, master_grid


def diagnose_pairs(pairs, grid=None, window=CONTINUUM_WINDOW, taper_len=TAPER_LEN, keep=()):
    """One row of measurements per pair with raw grid spectra raw_1 and raw_2.

    All measurements come from one kernel, so that the vectors go to Python once.
    """
    grid = master_grid() if grid is None else grid
    ids = [c for c in ("sdssid", "z", "true_label", "prob_change") if c in pairs.columns]
    kept = [c for c in keep if c in pairs.columns and c not in ids]
    measured = pairs.select(*ids, *kept, pair_measurements("raw_1", "raw_2", grid, window, taper_len).alias("m"))
    measured = measured.select(*ids, *kept, *[F.col("m")[name].alias(name) for name in MEASUREMENTS])
    ratios = {"mad_ratio_max_over_min": safe_ratio(*[F.col(f"{s}_ind_mad") for s in SIDES])}
    for line in LINES:
        ratios[f"{line}_paper_flux_ratio"] = safe_ratio(*[F.col(f"{line}_paper_flux_{s}") for s in SIDES])
    return measured.withColumns(ratios)


def diagnose_sample(sample, spectra_pairs, failures, keys=("sdssid", "specname_dr16", "specname_sdssv"), **options):
    """Diagnosis of a prediction sample; pairs that failed keep an error row."""
    keys = list(keys)
    chosen = counted_side(freeze(sample.select(*keys, "true_label", "prob_change", "diagnostic_group")))
    ready = spectra_pairs.select(*keys, "z", "raw_1", "raw_2").join(chosen, keys)
    failed = failures.select(*keys, "error").join(chosen, keys).select("sdssid", "diagnostic_group", "error")
    return with_errors(diagnose_pairs(ready, keep=("diagnostic_group",), **options), failed)
