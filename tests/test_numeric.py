import math

import numpy as np
import pytest

from voxlake.functions import affine, spectrum, stats
from voxlake.operators import multivariate, spatial, temporal


def test_bins_and_kernel():
    assert spectrum.pass_bins(64, 2.0, 0.009, 0.08) == (1, 11)
    w = spectrum.attenuation(64, 2.0, 0.009, 0.08)
    y = np.random.default_rng(0).normal(size=64)
    fft = np.fft.irfft(np.fft.rfft(y) * w, n=64)
    h = spectrum.kernel(w, 64)
    conv = [sum(y[s] * h[(t - s) % 64] for s in range(64)) for t in range(64)]
    assert np.allclose(fft, conv) and np.allclose(np.fft.irfft(np.fft.rfft(fft) * w, n=64), fft)
    assert spectrum.attenuation(63, 2.0, 0.05, 0.08, keep_mean=True)[0] == 1
    s = spectrum.attenuation(64, 2.0, 0.009, 0.08, rolloff=10.0)
    assert s[5] == 1 and 0 < s[12] < 1 and s[30] < 1e-6


def test_distributions():
    assert stats.t_cdf(2.0, 10) == pytest.approx(0.9633059826, abs=1e-9)
    assert stats.p_to_t(stats.t_to_p(1.7, 8), 8) == pytest.approx(1.7, abs=1e-6)
    assert stats.p_to_t(stats.t_to_p(-0.4, 3), 3) == pytest.approx(-0.4, abs=1e-6)
    for x in (-0.99, -0.2, 0.0, 0.5, 0.999):
        assert math.erf(stats.erf_inv(x)) == pytest.approx(x, abs=1e-12)
    a = np.array([[2.0, 1], [1, 3]])
    v = stats.power_iteration(a)
    assert np.allclose(a @ v, np.linalg.eigvalsh(a)[-1] * v, atol=1e-9)


def test_affine():
    m = np.array([[2.9, -0.5, 0, 4], [0.5, 2.9, 0, 5], [0, 0, 3, 6], [0, 0, 0, 1]])
    out, dims = affine.straight_grid(m, (8, 8, 8))
    c = np.linalg.inv(out) @ m @ affine.corners((8, 8, 8))
    assert (c[:3] >= 0).all() and (c[:3].max(1) <= np.array(dims) - 1 + 1e-9).all()
    assert np.allclose(affine.parse_itk(affine.itk_text(m)), m)
    assert np.allclose(affine.itk_from_flirt(np.eye(4), m, (3, 3, 3, 8), m, (3, 3, 3, 8)), np.eye(4))
    assert np.allclose(spatial.padded_origin(m, (1, 2, 3))[:3, 3], m[:3, 3] - m[:3, :3] @ [1, 2, 3])


def test_orientation_codes():
    assert spatial.orientation_of(np.diag([-3.0, 3, 3, 1])) == "LAS"
    assert spatial.orientation_of(np.array([[0, 0, 3.0, 0], [-3, 0, 0, 0], [0, 3, 0, 0], [0, 0, 0, 1]])) == "PSR"
    m = np.diag([3.0, 3, 3, 1])
    for code in ("LPI", "SAR", "ILP"):
        assert spatial.orientation_of(spatial.reoriented_affine(m, (4, 5, 6), "RAS", code)) == code
    with pytest.raises(ValueError):
        spatial.reorientation("RAS", "RLS")


def test_components():
    m, n = multivariate.repaired(np.diag([4.0, 2.0, 0.0]))
    assert n == 1 and np.allclose(np.linalg.eigvalsh(m), [2, 3, 4])
    assert multivariate.how_many(np.array([5.0, 3, 1, 1]), 0, 0.75) == 2
    assert multivariate.how_many(np.array([5.0, 3, 1, 1]), 3) == 3
    assert multivariate.how_many(np.array([5.0, 3, 1, 1])) == 1


def test_lanczos_weights():
    w = temporal.lanczos_weights(64, 2.0, 3.0)
    assert w.shape == (40, 64) and np.allclose(w[2], np.eye(64)[4])
    assert temporal.resampled_frames(64, 2.0, 3.0) == 40
    assert temporal.band_stop_regressors(64, 2.0, 0.009, 0.08).shape[0] == 64
