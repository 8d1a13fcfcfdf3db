"""File names, URLs, paths and run names."""

from pyspark.sql import functions as F

from ..settings import ARCHIVE_URL

MJD_NAMES = ("mjd", "MJD", "MJD_class_table")
FIBER_NAMES = ("fiber", "FIBER", "FIBERID_class_table", "FIBERID")


def first_present(df, names, what):
    """The first of `names` that `df` has; alternative spellings resolve per table."""
    for name in names:
        if name in df.columns:
            return name
    raise KeyError(f"no {what} column among {list(names)}")


def spectrum_filename(df):
    """spec-PPPP-MMMMM-FFFF.fits from whichever plate/mjd/fiber columns exist."""
    mjd = F.col(first_present(df, MJD_NAMES, "MJD")).cast("int")
    fiber = F.col(first_present(df, FIBER_NAMES, "fiber")).cast("int")
    return _spectrum_name(F.col("PLATE").cast("int"), mjd, fiber)


def _if_all(columns, value):
    present = columns[0].isNotNull()
    for c in columns[1:]:
        present = present & c.isNotNull()
    return F.when(present, value)


def _spectrum_name(plate, mjd, fiber):
    return _if_all([plate, mjd, fiber], F.format_string("spec-%04d-%05d-%04d.fits", plate, mjd, fiber))


def legacy_filename(plate, mjd, fiber):
    """spSpec-MMMMM-PPPP-FFF.fit"""
    plate, mjd, fiber = (F.col(c).cast("int") for c in (plate, mjd, fiber))
    return _if_all([plate, mjd, fiber], F.format_string("spSpec-%05d-%04d-%03d.fit", mjd, plate, fiber))


def archive_url(plate, mjd, fiber):
    plate, mjd, fiber = (F.col(c).cast("int") for c in (plate, mjd, fiber))
    name = _spectrum_name(plate, mjd, fiber)
    return F.concat(F.lit(ARCHIVE_URL + "/"), F.format_string("%04d/", plate), name)


def resolve_path(base, name):
    """Absolute names stay, relative ones are put under `base`."""
    base = base if not isinstance(base, str) else F.lit(base.rstrip("/"))
    name = F.col(name) if isinstance(name, str) else name
    return F.when(name.startswith("/"), name).otherwise(F.concat(base, F.lit("/"), name))


def run_name(alpha, gamma, seed):
    alpha, gamma, seed = (F.col(c) if isinstance(c, str) else c for c in (alpha, gamma, seed))
    text = F.format_string("alpha_%.2f_gamma_%.1f_seed_%d", alpha, gamma, seed.cast("int"))
    return F.replace(text, F.lit("."), F.lit("p"))
