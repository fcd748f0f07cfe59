import numpy as np
import pytest

from chronoweave.functions.correlation import best_pearson, fit_drift, pearson_at, phase_peak
from chronoweave.functions.signal import StreamingDecimator, decimate, log_energy, next_pow2, normalise_rms, peak_summary, working_rate

rng = np.random.default_rng(0)


@pytest.mark.parametrize("factor", [1, 2, 3, 8, 50])
@pytest.mark.parametrize("block", [1, 7, 100, 9999])
def test_stream_equals_whole(factor, block):
    x = rng.normal(size=1203)
    s = StreamingDecimator(factor)
    y = np.concatenate([*(s.push(x[i : i + block]) for i in range(0, len(x), block)), s.flush()])
    assert np.allclose(y, decimate(x, factor)) and len(y) == len(x) // factor


@pytest.mark.parametrize("offset,size", [(5000, 800), (100, 3000), (-300, 2000)])
def test_peak_is_at_the_true_lag(offset, size):
    y = rng.normal(size=7000)
    z = np.concatenate([rng.normal(size=max(0, -offset)), y[max(0, offset) : max(0, offset) + size]])
    assert phase_peak(y, z).offset_int == offset
    r, lag, _ = best_pearson(y, z, 100)
    assert lag == offset and r > 0.99


def test_long_lags_fold_in_compat():
    y = rng.normal(size=7000)
    assert phase_peak(y, y[5000:5800], compat=True).offset_int == 5000 - 8192


def test_best_pearson_equals_all_lags():
    a, b = rng.normal(size=60), rng.normal(size=40)
    want = max((round(pearson_at(a, b, lag)[0], 9), -lag) for lag in range(-39, 60) if pearson_at(a, b, lag)[1] >= 10)
    r, lag, _ = best_pearson(a, b, 10)
    assert (round(r, 9), -lag) == want


def test_energy_equals_direct():
    x = rng.normal(size=101)
    want = [10 * np.log10(np.mean(x[i : i + 8] ** 2) + 1e-10) for i in range(0, 94, 3)]
    assert np.allclose(log_energy(x, 8, 3), want)


def test_drift_sign_and_value():
    t = np.arange(10.0)
    ppm, r2, slip = fit_drift([(x, 5 - 3e-4 * x) for x in t])
    assert abs(ppm - 300) < 1e-6 and r2 > 0.999 and abs(slip + 27e-4) < 1e-9
    assert fit_drift([(0, 1), (1, 2)]) == (0.0, 0.0, 0.0)
    assert fit_drift([(0, 1), (1, 1), (2, 1)])[1] == 0.0


def test_small_ones():
    assert [next_pow2(n) for n in (0, 1, 2, 3, 1024, 1025)] == [1, 1, 2, 4, 1024, 2048]
    assert (normalise_rms(np.zeros(3)) == 0).all()
    assert working_rate(48000, 100) == (3, 16000.0)
    assert working_rate(48000, 48000 * 3600 * 24)[1] >= 1000
    assert peak_summary(np.array([1.0, -2.0, 0.5, 0.0]), 2).tolist() == [1.0, 0.25]
    assert len(peak_summary(np.zeros(0))) == 400
