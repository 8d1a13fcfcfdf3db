import numpy as np
import pytest

from spectraloom.functions import kernels as k
from spectraloom.functions.vectors import taper_weights
from spectraloom.settings import master_grid, threshold_grid


def row(*values):
    return np.array([values], dtype=float)


def test_grid_and_thresholds():
    grid = master_grid()
    assert len(grid) == 1024 and grid[0] == 4575.0 and grid[-1] == 6699.0
    assert grid[1] == 4577.076246334311
    assert len(threshold_grid()) == 99 and threshold_grid()[94] == 0.9500000000000001


def test_continuum_of_constant_ramp_and_spike():
    n = 1024
    assert np.allclose(k.subtract_continuum(np.full((1, n), 7.0), 151), 0)
    ramp = k.subtract_continuum(np.arange(n, dtype=float)[None, :], 151)[0]
    assert np.allclose(ramp[75:949], 0) and abs(ramp[0]) > 1
    spike = np.zeros((1, n))
    spike[0, 500] = 1
    flat = k.subtract_continuum(spike, 151)[0]
    assert flat[500] == pytest.approx(150 / 151)
    assert np.allclose(flat[425:500], -1 / 151) and np.allclose(flat[:425], 0)


def test_continuum_matches_direct_mean_and_keeps_gaps_local():
    x = np.random.default_rng(0).normal(size=(3, 200))
    x[1, 100] = np.nan
    got = k.box_mean(x, 21)
    padded = np.pad(x, ((0, 0), (10, 10)), mode="reflect")
    want = np.stack([padded[:, i : i + 21].mean(axis=1) for i in range(200)], axis=1)
    assert np.allclose(got, want, equal_nan=True)
    assert np.isnan(got[1]).sum() == 21


def test_continuum_needs_enough_pixels():
    with pytest.raises(ValueError):
        k.box_mean(np.ones((1, 60)), 151)


def test_lower_median_and_mad():
    middle, mad = k.median_and_mad(row(1, 2, 3, 4))
    assert middle[0] == 2 and mad[0] == 1
    assert np.allclose(k.scale_by_mad(row(1, 2, 3, 4), middle, mad), (row(1, 2, 3, 4) - 2) / (1.4826 + 1e-8))
    assert np.isnan(k.lower_median(row(1, np.nan, 3)))[0]


def test_taper():
    assert taper_weights(12).tolist() == [0, 0.25, 0.5, 0.75, 1, 1, 1, 1, 0.75, 0.5, 0.25, 0]


def test_resample_and_fill():
    got = k.resample(np.array([1.0, 2, 3]), np.array([10.0, 20, 30]), np.array([0, 1.5, 3, 4]))
    assert np.isnan(got[[0, 3]]).all() and got[1] == 15 and got[2] == 30
    filled, gaps, middle = k.fill_missing(got[None, :])
    assert filled.tolist() == [[22.5, 15, 30, 22.5]] and gaps[0] == 2 and middle[0] == 22.5
    filled, _, middle = k.fill_missing(row(np.nan, np.nan))
    assert np.isnan(filled).all() and np.isnan(middle[0])


def test_resample_sorts_by_wavelength():
    got = k.resample(np.array([3.0, 1, 2]), np.array([30.0, 10, 20]), np.array([2.5]))
    assert got[0] == 25


def test_sky_line():
    wave = np.arange(5540.0, 5615.0, 1.0)
    flux = 1 + 0.1 * np.where(np.arange(len(wave)) % 2 == 0, 1, -1)
    assert k.repair_sky_line(wave, flux) is flux
    spiked = flux.copy()
    spiked[np.argmin(abs(wave - 5577))] = 50
    fixed = k.repair_sky_line(wave, spiked)
    assert fixed.max() < 1.2 and spiked.max() == 50
    flat = np.ones(len(wave))
    flat[np.argmin(abs(wave - 5577))] = 50
    assert k.repair_sky_line(wave, flat) is flat  # side bands without spread


def test_line_measures_on_a_constant():
    grid = master_grid()
    x = np.full((2, 1024), 3.0)
    assert np.allclose(k.line_flux(x, grid, "hb"), 0)
    assert np.isnan(k.line_flux(x, grid, "ha")).all()  # red side band lies outside the grid
    assert np.allclose(k.wing_score(x, grid, "ha"), 3) and np.allclose(k.peak_above_median(x, grid, "hb"), 0)


def test_line_flux_of_a_box():
    grid = master_grid()
    x = np.where((grid >= 4850) & (grid <= 4870), 2.0, 0.0)[None, :]
    inside = grid[(grid >= 4797.8) & (grid <= 4927.5)]
    want = np.trapezoid(np.where((inside >= 4850) & (inside <= 4870), 2.0, 0.0), inside)
    assert k.line_flux(x, grid, "hb")[0] == pytest.approx(want)
