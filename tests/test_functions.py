import math

import numpy as np
import pytest

from knotwork.functions import basis, linalg, links, special
from knotwork.functions import families as fam


def test_special_functions():
    assert np.allclose(special.digamma([1.0, 0.5]), [-0.5772156649015329, -1.9635100260214235])
    assert np.allclose(special.trigamma([1.0, 0.5]), [math.pi**2 / 6, math.pi**2 / 2])
    p = np.array([1e-12, 0.01, 0.3, 0.5, 0.975, 1 - 1e-9])
    assert np.allclose(special.normal_cdf(special.normal_ppf(p)), p, rtol=1e-9)
    assert np.allclose(special.gamma_p(3.0, [2.0, 7.0]), [1 - math.exp(-x) * (1 + x + x * x / 2) for x in (2, 7)])
    assert np.allclose(special.chi2_sf([3.841458820694124], 1), 0.05)
    assert np.allclose(special.t_sf_two_sided(2.2281388519649385, 10), 0.05)
    assert np.allclose(special.f_sf(4.9646027437307145, 1, 10), 0.05)
    assert np.allclose(special.beta_i(2, 3, [0.4]), 0.5248)


def test_weighted_chi_squared():
    assert abs(special.weighted_chi2_sf(10.0, np.ones(4)) - special.chi2_sf(10.0, 4)[0]) < 1e-7
    draws = np.random.default_rng(0).normal(size=(400_000, 3)) ** 2 @ np.array([2.0, 0.5, 0.1])
    assert abs(special.weighted_chi2_sf(5.0, np.array([2.0, 0.5, 0.1])) - (draws > 5).mean()) < 3e-3


def test_basis_equals_truncated_powers():
    x = np.linspace(-3, 13, 81)
    for deg, nk in ((3, 9), (2, 7), (1, 5)):
        cells = nk - deg
        dx = 10 / cells
        knots = np.linspace(-deg * dx, 10 + deg * dx, cells + 2 * deg + 1)
        power = np.stack([basis.truncated_power(x, t, deg) for t in knots], axis=1)
        want = (-1) ** (deg + 1) * power @ np.diff(np.eye(len(knots)), deg + 1, axis=0).T / (math.factorial(deg) * dx**deg)
        assert np.abs(basis.dense(*basis.bspline(x, 0, 10, nk, deg), nk) - want).max() < 1e-10


@pytest.mark.parametrize("kind", ["QR", "DROP", "DIFF"])
def test_constraints(kind):
    sums = np.arange(1.0, 8.0)
    z = basis.sum_to_zero(sums, kind)
    assert z.shape == (7, 6) and np.linalg.matrix_rank(z) == 6
    if kind == "QR":
        assert np.allclose(sums @ z, 0)


def test_natural_form():
    rng = np.random.default_rng(1)
    x, s = rng.normal(size=(50, 6)), basis.difference_penalty(6)
    back, d = basis.natural(x.T @ x, s)
    assert np.allclose(back.T @ x.T @ x @ back, np.eye(6)) and np.allclose(back.T @ s @ back, d, atol=1e-8)


def test_linear_algebra():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 4))
    x = np.hstack((x, x[:, :1] + x[:, 1:2]))
    low, order, rank = linalg.pivoted_cholesky(x.T @ x)
    assert rank == 4 and np.allclose((low @ low.T), (x.T @ x)[np.ix_(order, order)])
    assert linalg.dependent_columns(x.T @ x, 2) == [4]
    h = x[:, :4].T @ x[:, :4]
    lvi, ridge = linalg.inverse_factor(h)
    assert ridge == 0 and np.allclose(lvi.T @ lvi, np.linalg.inv(h))
    c = np.linalg.cholesky(h)
    d = np.diag([1.0, 2, 3, 4])
    assert np.allclose(linalg.chol_derivative(c, d), (np.linalg.cholesky(h + 1e-6 * d) - np.linalg.cholesky(h - 1e-6 * d)) / 2e-6, atol=1e-6)
    assert linalg.condition(np.eye(3)) == (1.0, 0)


@pytest.mark.parametrize("link", [links.Identity(), links.Logit(), links.LOG(), links.LOGb(-0.0001)])
def test_links(link):
    mu, h = np.array([0.2, 0.5, 0.9]), 1e-6
    assert np.allclose(link.fi(link.f(mu)), mu)
    assert np.allclose(link.dy1(mu), (link.f(mu + h) - link.f(mu - h)) / (2 * h), rtol=1e-6)
    assert np.allclose(link.dy2(mu), (link.dy1(mu + h) - link.dy1(mu - h)) / (2 * h), rtol=1e-4, atol=1e-8)


@pytest.mark.parametrize("family", [fam.Gaussian(), fam.Binomial(), fam.Gamma(), fam.InvGauss(), fam.Poisson()])
def test_deviance_is_twice_the_gap_to_the_saturated_model(family):
    y, mu = (np.array([0.0, 1.0, 1.0]), np.array([0.2, 0.5, 0.9])) if isinstance(family, fam.Binomial) else (np.array([1.0, 2.0, 5.0]), np.array([1.5, 2.5, 3.0]))
    full = np.zeros(3) if isinstance(family, fam.Binomial) else family.lp(y, y)
    assert np.allclose(family.D(y, mu), 2 * (full - family.lp(y, mu)))


@pytest.mark.parametrize("family", [fam.Binomial(), fam.Gamma(), fam.Poisson(), fam.InvGauss(), fam.ScaledT()])
def test_newton_step_uses_the_derivatives_of_the_deviance(family):
    y = np.array([0.0, 1.0, 1.0]) if isinstance(family, fam.Binomial) else np.array([1.0, 2.0, 5.0])
    eta, h = np.array([0.1, 0.3, -0.2]) + (0 if not isinstance(family, fam.InvGauss) else 0.5), 1e-5
    z, w = family.newton(y, eta)

    def d(e):
        return family.D(y, family.link.fi(e))

    first, second = (d(eta + h) - d(eta - h)) / (2 * h), (d(eta + h) - 2 * d(eta) + d(eta - h)) / h**2
    assert np.allclose(w * (z - eta), -first / 2, atol=1e-5) and np.allclose(w, second / 2, rtol=1e-3, atol=1e-4)


@pytest.mark.parametrize("family", [fam.GAMMALS(), fam.MULNOMLSS(2), fam.GAUMLSS()])
def test_gamlss_derivatives(family):
    rng = np.random.default_rng(3)
    y = np.array([0.0, 1, 2, 1]) if isinstance(family, fam.MULNOMLSS) else rng.gamma(2, 1, 4) + 0.1
    etas, h = [rng.normal(size=4) * 0.3 for _ in range(2)], 1e-5
    first, second = family.derivatives(y, etas)
    for a in range(2):
        up, down = ([e + s * h * (b == a) for b, e in enumerate(etas)] for s in (1, -1))
        assert np.allclose(first[a], (family.lp(y, *family.means(up)) - family.lp(y, *family.means(down))) / (2 * h), atol=1e-6)
        if not isinstance(family, fam.GAUMLSS):  # its second derivatives are expectations
            for b in range(2):
                assert np.allclose(second[a][b], (family.derivatives(y, up)[0][b] - family.derivatives(y, down)[0][b]) / (2 * h), atol=1e-5)


def test_scaled_t_theta():
    y, mu = np.array([0.3, -2.0, 1.1]), np.zeros(3)
    t = np.array([0.3, 1.2])
    _, g, h = fam.ScaledT(theta=t).theta_derivatives(y, mu)
    for k in range(2):
        up, down = (fam.ScaledT(theta=t + s * 1e-5 * np.eye(2)[k]) for s in (1, -1))
        assert abs((up.lp(y, mu).sum() - down.lp(y, mu).sum()) / 2e-5 - g[k]) < 1e-6
        assert np.allclose((up.theta_derivatives(y, mu)[1] - down.theta_derivatives(y, mu)[1]) / 2e-5, h[k], atol=1e-5)


def test_similarity_transform_keeps_the_penalty():
    rng = np.random.default_rng(4)
    mats = [basis.difference_penalty(6), np.diag([0, 0, 0, 0, 1.0, 1.0]), basis.difference_penalty(6, 1)]
    lams = [1e6, 1.0, 1e-6]
    q = linalg.similarity_transform(mats, lams)
    assert np.allclose(q @ q.T, np.eye(6))
    total = q.T @ sum(w * m for w, m in zip(lams, mats)) @ q
    assert np.abs(total[:4, 4:]).max() < 1e-3 * np.abs(total[:4, :4]).max()
    x = rng.normal(size=6)
    assert np.isclose((q.T @ x) @ total @ (q.T @ x), x @ sum(w * m for w, m in zip(lams, mats)) @ x)


def test_api_names():
    from knotwork import api

    assert {"GAMM", "GAMMLSS", "GSMM", "HSMM", "PropHaz", "Formula", "f", "fs", "irf", "ri", "rs", "compare_CDL"} <= set(api.__all__)
