"""Grid, windows, bands and thresholds shared by all jobs."""

from dataclasses import dataclass

import numpy as np

# ---------------------------------------------------------------- fixed values
# Values that must equal the reference's for equal results.

GRID_START = 4575.0
GRID_STOP = 6699.0
GRID_SIZE = 1024

CONTINUUM_WINDOW = 151
TAPER_LEN = 5
MAD_TO_SIGMA = 1.4826
EPS = 1e-8

SKY_LINE_CENTER = 5577.3
SKY_LINE_WINDOW = 20.0
SKY_LINE_THRESHOLD = 4.0

FLUX_UNIT = 1e-17
H0 = 70.0
OMEGA_M = 0.3

# line name -> (blue side band, red side band, line band)
LINE_BANDS = {
    "hb": ((4670.0, 4730.0), (5080.0, 5120.0), (4797.8, 4927.5)),
    "ha": ((6150.0, 6250.0), (6950.0, 7150.0), (6477.1, 6652.1)),
}
# line name -> two windows left and right of the narrow core
WING_WINDOWS = {
    "hb": ((4797.8, 4840.0), (4885.0, 4927.5)),
    "ha": ((6477.1, 6535.0), (6600.0, 6652.1)),
}
PEAK_REGION = {"hb": (4700.0, 5100.0), "ha": (6300.0, 6699.0)}

ABLATION_REGIONS = ((4575.0, 5550.0), (5800.0, 5950.0), (6200.0, 6699.0))
RANDOM_MASK_REGIONS = ((4700.0, 5000.0), (6350.0, 6699.0))
RANDOM_MASK_MIN_FRACTION = 0.10
RANDOM_MASK_MAX_FRACTION = 0.60
EXTRA_MASK_PROBABILITY = 0.30
EXTRA_MASK_LENGTHS = (20, 60)

CORE_COLUMNS = ("filename", "obj_id", "agn_type", "z", "snr")
LINE_COLUMNS = (
    "OIII_FLUX",
    "OIII_FLUX_ERR",
    "OIII_LUM",
    "OIII_LUM_ERR",
    "LOG_OIII_LUM",
    "OIII_SNR",
    "OIII_VALID",
    "OIII_QUALITY_FLAG",
    "OIII_SIGMA",
    "OIII_VOFF",
    "OIII_CHI2",
    "OIII_FLUX_CGS",
    "OIII_FLUX_SOURCE",
    "OIII_USABLE",
)

# standard name <- catalogue names, first present one wins
LINE_ALIASES = {
    "LOG_OIII_LUM": ("LOGL_OIII_5007", "LOGL_OIII", "LOGL_NAR_OIII_5007", "LOGL_NAR_OIII"),
    "LOG_OIII_LUM_ERR": (
        "LOGL_OIII_5007_ERR",
        "LOGL_OIII_ERR",
        "ERR_LOGL_OIII_5007",
        "ERR_LOGL_OIII",
        "LOGL_NAR_OIII_5007_ERR",
        "ERR_LOGL_NAR_OIII_5007",
        "ERR_LOGL_NAR_OIII",
    ),
    "OIII_LUM": ("OIII_5007_LUM",),
    "OIII_LUM_ERR": ("OIII_5007_LUM_ERR", "ERR_OIII_5007_LUM", "ERR_OIII_LUM"),
    "OIII_EW": ("OIII_5007_EW", "EW_OIII_5007"),
    "OIII_FWHM": ("OIII_5007_FWHM", "FWHM_OIII_5007"),
}

STANDARD_LINE_COLUMNS = (
    "LOG_OIII_LUM",
    "LOG_OIII_LUM_ERR",
    "OIII_LUM",
    "OIII_LUM_ERR",
    "OIII_FLUX",
    "OIII_FLUX_ERR",
    "OIII_SNR",
    "OIII_SIGMA",
    "OIII_VOFF",
    "OIII_CHI2",
)

TYPE1_BASE = ("filename", "SDSS_NAME", "RA", "DEC", "z", "MJD", "PLATE", "FIBER", "LINE_MED_SN_HB")
TYPE1_LINES = (
    "OIII_FLUX",
    "OIII_FLUX_ERR",
    "OIII_LUM",
    "OIII_LUM_ERR",
    "LOG_OIII_LUM",
    "LOG_OIII_LUM_ERR",
    "OIII_SNR",
    "OIII_SIGMA",
    "OIII_VOFF",
    "OIII_CHI2",
    "OIII_VALID",
    "OIII_QUALITY_FLAG",
)
TYPE1_RENAMES = {"MJD": "mjd", "FIBER": "fiber", "LINE_MED_SN_HB": "snr"}

QUALITY_MIN_SNR = 5.0
QUALITY_LUM_RANGE = (1e38, 1e45)
QUALITY_SIGMA_RANGE = (30.0, 1000.0)
QUALITY_MAX_ABS_VOFF = 1000.0

# beta, smallest recall and largest false positive rate: the default, and the published detector's choice
DEFAULT_CHOICE = (0.5, 0.10, 0.01)
PUBLISHED_CHOICE = (0.5, 0.5, 0.05)

ARCHIVE_URL = "https://data.sdss.org/sas/dr17/sdss/spectro/redux/26/spectra/lite"

TRUE_WORDS = ("true", "1", "yes")

# ------------------------------------------------------------------------------


def master_grid():
    return np.linspace(GRID_START, GRID_STOP, GRID_SIZE)


def threshold_grid(low=0.01, high=0.99, count=99):
    return [float(t) for t in np.linspace(low, high, count)]


@dataclass(frozen=True)
class QualityLimits:
    min_snr: float = QUALITY_MIN_SNR
    min_lum: float = QUALITY_LUM_RANGE[0]
    max_lum: float = QUALITY_LUM_RANGE[1]
    min_sigma: float = QUALITY_SIGMA_RANGE[0]
    max_sigma: float = QUALITY_SIGMA_RANGE[1]
    max_abs_voff: float = QUALITY_MAX_ABS_VOFF
    max_chi2: float | None = None


@dataclass(frozen=True)
class ThresholdRule:
    """Constraints for choosing a decision threshold."""

    beta: float = DEFAULT_CHOICE[0]
    min_recall: float = DEFAULT_CHOICE[1]
    max_fpr: float = DEFAULT_CHOICE[2]


# The preset the published change detector was selected with.
PUBLISHED_RULE = ThresholdRule(*PUBLISHED_CHOICE)
