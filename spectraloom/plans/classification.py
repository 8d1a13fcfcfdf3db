"""A stored catalogue to the evaluation of a single-spectrum classifier, in one call."""

from pyspark.sql import functions as F

from ..operators.dedup import best_by_snr
from ..operators.select import redshift_window
from ..operators.shape import class_target
from ..operators.sizes import counted_side
from ..operators.split import scaled_redshift, stratified_split
from ..session import handed_over
from ..settings import master_grid
from ..sources.tables import read_catalogue
from .evaluation import evaluate_spectra, score_spectra

NARROW = ("filename", "obj_id", "agn_type", "z", "snr")


def split_catalogue(spark, path, window=None, seed=42, key="filename"):
    """(`NARROW` columns, label, z_scaled, split): the best spectrum of each object, split by class.

    Objects are reduced before the redshift window, so an object whose best spectrum lies outside has
    none. No vector is read.
    """
    best = best_by_snr(read_catalogue(spark, path, list(NARROW)))
    if window is not None:
        best = redshift_window(best, *window)
    labelled = best.filter(F.col("z").isNotNull()).withColumn("label", class_target())
    labelled = handed_over(labelled, "labelled")
    return stratified_split(scaled_redshift(labelled), "label", key, seed)


def score_catalogue(spark, path, scorer, part="test", window=None, seed=42, mask_lines=False, grid=None):
    """The rows of one part of the split with a score each; only their vectors are fetched.

    File names are expected to identify a spectrum.
    """
    grid = master_grid() if grid is None else grid
    chosen = split_catalogue(spark, path, window, seed).filter(F.col("split") == part)
    chosen = handed_over(chosen, "chosen")
    vectors = read_catalogue(spark, path, ["filename", "flux"])
    return score_spectra(vectors.join(counted_side(chosen), "filename"), scorer, mask_lines=mask_lines, grid=grid)


def evaluate_catalogue(spark, path, scorer, threshold=0.5, **options):
    """Class metrics of a scorer on one part of a stored catalogue (see `score_catalogue`)."""
    return evaluate_spectra(score_catalogue(spark, path, scorer, **options), threshold=threshold)
