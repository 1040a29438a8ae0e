"""Response families: variance, density and deviance, on arrays and, where possible, on columns.

A family's ``D`` (unit deviance) and ``V`` are written once for numpy arrays and Spark columns.
``lp`` needs the log-gamma function and works on arrays.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .links import LOG, Identity, Link, LOGb, Logit, on
from .special import digamma, gamma_cdf, lgamma, normal_cdf, normal_ppf, trigamma

LOG2PI = math.log(2 * math.pi)


def est_scale(res: np.ndarray, rows: int, edf: float) -> float:
    """Pearson estimate of the scale."""
    return float(res @ res) / (rows - edf)


class Family(ABC):
    """Exponential family with one linear predictor. ``scale`` None: it is estimated."""

    def __init__(self, link: Link, scale: float | None = None) -> None:
        self.link, self.scale = link, scale

    @property
    def twopar(self) -> bool:
        return self.scale is None

    def init_mu(self, y: np.ndarray) -> np.ndarray:
        return y.astype(float)

    @abstractmethod
    def V(self, mu: Any) -> Any: ...

    @abstractmethod
    def dVy1(self, mu: Any) -> Any: ...

    @abstractmethod
    def D(self, y: Any, mu: Any) -> Any: ...

    @abstractmethod
    def lp(self, y: np.ndarray, mu: np.ndarray, scale: float = 1.0) -> np.ndarray: ...

    def llk(self, y: np.ndarray, mu: np.ndarray, scale: float = 1.0) -> float:
        return float(self.lp(y, mu, scale).sum())

    def deviance(self, y: Any, mu: Any) -> Any:
        """Sum of unit deviances: a number for arrays, an aggregate for columns."""
        d = self.D(y, mu)
        return F.sum(d) if isinstance(d, Column) else float(np.sum(d))

    # numbers that an iteration needs of a block of rows ------------------------------------------
    def working(self, y: np.ndarray, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fisher-scoring working response and weight."""
        mu = self.link.fi(eta)
        d = self.link.dy1(mu)
        return d * (y - mu) + eta, 1 / (d * d * self.V(mu))

    def newton(self, y: np.ndarray, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Newton working response and observed weight."""
        mu = self.link.fi(eta)
        d = self.link.dy1(mu)
        a = 1 + (y - mu) * (self.dVy1(mu) / self.V(mu) + self.link.dy2(mu) / d)
        return d * (y - mu) / a + eta, a / (d * d * self.V(mu))

    def residual(self, y: np.ndarray, mu: np.ndarray, kind: str = "Pearson") -> np.ndarray:
        if kind == "Pearson":
            return (y - mu) / np.sqrt(self.V(mu))
        if kind == "Deviance":
            return np.sign(y - mu) * np.sqrt(np.maximum(self.D(y, mu), 0))
        raise ValueError(f"unknown residual type {kind!r}")


class Gaussian(Family):
    def __init__(self, link: Link | None = None, scale: float | None = None) -> None:
        super().__init__(link or Identity(), scale)

    def V(self, mu: Any) -> Any:
        return mu * 0 + 1.0

    def dVy1(self, mu: Any) -> Any:
        return mu * 0.0

    def D(self, y: Any, mu: Any) -> Any:
        return (y - mu) * (y - mu)

    def lp(self, y: np.ndarray, mu: np.ndarray, scale: float = 1.0) -> np.ndarray:
        return -0.5 * (LOG2PI + np.log(scale) + (y - mu) ** 2 / scale)


class Binomial(Family):
    """``y`` is the share of successes in ``n`` trials."""

    def __init__(self, link: Link | None = None, n: float = 1) -> None:
        super().__init__(link or Logit(), 1.0)
        self.n = n

    def init_mu(self, y: np.ndarray) -> np.ndarray:
        return (y + 0.5) / 2

    def V(self, mu: Any) -> Any:
        return mu * (1 - mu) / self.n

    def dVy1(self, mu: Any) -> Any:
        return (1 - 2 * mu) / self.n

    def D(self, y: Any, mu: Any) -> Any:
        n = self.n

        def part(a: Any, b: Any) -> Any:  # a * log(a / b), 0 at a = 0
            return on.where(a > 0, a * on.log(on.where(a > 0, a, 1.0) / b), 0.0)

        return 2 * n * (part(y, mu) + part(1 - y, 1 - mu))

    def lp(self, y: np.ndarray, mu: np.ndarray, scale: float = 1.0) -> np.ndarray:
        k = y * self.n
        ways = lgamma(self.n + 1) - lgamma(k + 1) - lgamma(self.n - k + 1)
        m = np.clip(mu, 1e-300, 1 - 1e-16)
        return ways + k * np.log(m) + (self.n - k) * np.log1p(-m)


class Gamma(Family):
    def __init__(self, link: Link | None = None, scale: float | None = None) -> None:
        super().__init__(link or LOG(), scale)

    def V(self, mu: Any) -> Any:
        return mu * mu

    def dVy1(self, mu: Any) -> Any:
        return 2 * mu

    def D(self, y: Any, mu: Any) -> Any:
        return 2 * ((y - mu) / mu - on.log(y / mu))

    def lp(self, y: np.ndarray, mu: np.ndarray, scale: float = 1.0) -> np.ndarray:
        a = 1 / scale
        return a * np.log(a / mu) - lgamma(a) + (a - 1) * np.log(y) - a * y / mu


class InvGauss(Family):
    def __init__(self, link: Link | None = None, scale: float | None = None) -> None:
        super().__init__(link or LOG(), scale)

    def V(self, mu: Any) -> Any:
        return mu * mu * mu

    def dVy1(self, mu: Any) -> Any:
        return 3 * mu * mu

    def D(self, y: Any, mu: Any) -> Any:
        return (y - mu) * (y - mu) / (mu * mu * y)

    def lp(self, y: np.ndarray, mu: np.ndarray, scale: float = 1.0) -> np.ndarray:
        return -0.5 * (LOG2PI + np.log(scale) + 3 * np.log(y) + (y - mu) ** 2 / (scale * mu**2 * y))


class Poisson(Family):
    def __init__(self, link: Link | None = None) -> None:
        super().__init__(link or LOG(), 1.0)

    def init_mu(self, y: np.ndarray) -> np.ndarray:
        return np.where(y > 0, y + 0.1, 0.1)

    def V(self, mu: Any) -> Any:
        return mu

    def dVy1(self, mu: Any) -> Any:
        return mu * 0 + 1.0

    def D(self, y: Any, mu: Any) -> Any:
        return 2 * (on.where(y > 0, y * on.log(on.where(y > 0, y, 1.0) / mu), 0.0) - (y - mu))

    def lp(self, y: np.ndarray, mu: np.ndarray, scale: float = 1.0) -> np.ndarray:
        return y * np.log(mu) - mu - lgamma(y + 1)


class ExtendedFamily(Family):
    """A family with parameters ``theta`` of its own that are estimated in the fit."""

    theta: np.ndarray

    @abstractmethod
    def theta_derivatives(self, y: np.ndarray, mu: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood with its gradient and Hessian in ``theta``."""


class ScaledT(ExtendedFamily):
    """Student t with scale exp(theta[0]) and exp(theta[1]) + ``min_df`` degrees of freedom."""

    def __init__(self, link: Link | None = None, theta: np.ndarray | None = None, min_df: float = 3) -> None:
        super().__init__(link or Identity(), 1.0)
        self.theta, self.min_df = np.array([0.5, 10.0]) if theta is None else np.array(theta, float), min_df

    def _pars(self, theta: np.ndarray | None = None) -> tuple[float, float]:
        t = self.theta if theta is None else theta
        return math.exp(t[0]), math.exp(t[1]) + self.min_df

    def V(self, mu: Any) -> Any:
        phi, nu = self._pars()
        return mu * 0 + phi**2 * nu / (nu - 2)

    def dVy1(self, mu: Any) -> Any:
        return mu * 0.0

    def D(self, y: Any, mu: Any) -> Any:
        phi, nu = self._pars()
        return (nu + 1) * on.log1p(((y - mu) / phi) * ((y - mu) / phi) / nu)

    def lp(self, y: np.ndarray, mu: np.ndarray, scale: float = 1.0, theta: np.ndarray | None = None) -> np.ndarray:
        phi, nu = self._pars(theta)
        r = (y - mu) / phi
        return lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * math.log(math.pi * nu) - math.log(phi) - (nu + 1) / 2 * np.log1p(r * r / nu)

    def working(self, y: np.ndarray, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        phi, nu = self._pars()
        mu = self.link.fi(eta)
        d = self.link.dy1(mu)
        first = -2 * (nu + 1) * (y - mu) / (nu * phi**2 + (y - mu) ** 2) / d
        w = np.full_like(eta, (nu + 1) / phi**2 / (nu + 3)) / d**2
        return eta - first / (2 * w), w

    def newton(self, y: np.ndarray, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        phi, nu = self._pars()
        mu = self.link.fi(eta)
        d, r = self.link.dy1(mu), y - mu
        base = nu * phi**2 + r**2
        one = -2 * (nu + 1) * r / base
        two = 2 * (nu + 1) * (nu * phi**2 - r**2) / base**2
        eta_two = two / d**2 - one * self.link.dy2(mu) / d**3
        w = eta_two / 2
        return eta - one / d / np.where(np.abs(eta_two) < 1e-300, 1e-300, eta_two), w

    def theta_derivatives(self, y: np.ndarray, mu: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        phi, nu = self._pars()
        r2 = ((y - mu) / phi) ** 2
        n, m = len(y), nu - self.min_df
        a = (nu + 1) * r2 / (nu + r2)
        g0 = float((a - 1).sum())
        per = 0.5 * (digamma((nu + 1) / 2)[0] - digamma(nu / 2)[0] - 1 / nu) - 0.5 * np.log1p(r2 / nu) + 0.5 * (nu + 1) * r2 / (nu * (nu + r2))
        g1 = float(per.sum()) * m
        h00 = float((-2 * (nu + 1) * r2 * nu / (nu + r2) ** 2).sum())
        h01 = float((r2 * (r2 - 1) / (nu + r2) ** 2).sum()) * m
        second = 0.25 * (trigamma((nu + 1) / 2)[0] - trigamma(nu / 2)[0]) + 0.5 / nu**2
        rows = second + 0.5 * r2 / (nu * (nu + r2)) + 0.5 * (r2 / (nu * (nu + r2)) - (nu + 1) * r2 * (2 * nu + r2) / (nu * (nu + r2)) ** 2)
        h11 = float(rows.sum()) * m * m + g1
        return float(self.lp(y, mu).sum()) if n else 0.0, np.array([g0, g1]), np.array([[h00, h01], [h01, h11]])


# families with several distribution parameters -------------------------------------------------------


class GAMLSSFamily(ABC):
    """One linear predictor for each distribution parameter.

    ``derivatives`` gives first and second derivatives of the log-density in the linear predictors.
    """

    def __init__(self, pars: int, links: list[Link]) -> None:
        self.n_par, self.links = pars, links

    @abstractmethod
    def lp(self, y: np.ndarray, *pars: np.ndarray) -> np.ndarray: ...

    def llk(self, y: np.ndarray, *pars: np.ndarray) -> float:
        return float(self.lp(y, *pars).sum())

    @abstractmethod
    def dpars(self, y: np.ndarray, *pars: np.ndarray) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
        """Derivatives in the parameters themselves: d1[i] and d2[i][j]."""

    @abstractmethod
    def get_resid(self, y: np.ndarray, *pars: np.ndarray) -> np.ndarray: ...

    @abstractmethod
    def rvs(self, rng: np.random.Generator, *pars: np.ndarray) -> np.ndarray: ...

    def means(self, etas: list[np.ndarray]) -> list[np.ndarray]:
        return [link.fi(e) for link, e in zip(self.links, etas, strict=True)]

    def derivatives(self, y: np.ndarray, etas: list[np.ndarray]) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
        mus = self.means(etas)
        d1, d2 = self.dpars(y, *mus)
        g = [link.dy1(m) for link, m in zip(self.links, mus, strict=True)]
        first = [np.nan_to_num(a / b, nan=0, posinf=0, neginf=0) for a, b in zip(d1, g, strict=True)]
        second = [[np.zeros(0)] * self.n_par for _ in mus]
        for i in range(self.n_par):
            for j in range(i, self.n_par):
                v = d2[i][j] / (g[i] * g[j])
                if i == j:
                    v = v - d1[i] * self.links[i].dy2(mus[i]) / g[i] ** 3
                second[i][j] = second[j][i] = np.nan_to_num(v, nan=0, posinf=0, neginf=0)
        return first, second

    def start(self, mean: float, var: float) -> list[float]:
        """Intercepts to start from."""
        return [0.0] * self.n_par


class GAUMLSS(GAMLSSFamily):
    """Normal mean and standard deviation; second derivatives are expected ones."""

    def __init__(self, links: list[Link] | None = None) -> None:
        super().__init__(2, links or [Identity(), LOGb(-0.0001)])

    def lp(self, y: np.ndarray, *pars: np.ndarray) -> np.ndarray:
        mu, sd = pars
        return -0.5 * LOG2PI - np.log(sd) - 0.5 * ((y - mu) / sd) ** 2

    def lcp(self, y: np.ndarray, mu: np.ndarray, sd: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(normal_cdf((y - mu) / sd), 1e-300))

    def dpars(self, y: np.ndarray, *pars: np.ndarray) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
        mu, sd = pars
        r, zero = y - mu, np.zeros(len(y))
        return [r / sd**2, r**2 / sd**3 - 1 / sd], [[-1 / sd**2, zero], [zero, -2 / sd**2]]

    def get_resid(self, y: np.ndarray, *pars: np.ndarray) -> np.ndarray:
        return (y - pars[0]) / pars[1]

    def rvs(self, rng: np.random.Generator, *pars: np.ndarray) -> np.ndarray:
        return rng.normal(pars[0], pars[1])

    def start(self, mean: float, var: float) -> list[float]:
        return [float(self.links[0].f(np.float64(mean))), float(self.links[1].f(np.float64(math.sqrt(max(var, 1e-8)))))]


class GAMMALS(GAMLSSFamily):
    """Gamma mean and scale (variance = scale * mean squared)."""

    def __init__(self, links: list[Link] | None = None) -> None:
        super().__init__(2, links or [LOG(), LOGb(-0.0001)])

    def lp(self, y: np.ndarray, *pars: np.ndarray) -> np.ndarray:
        mu, scale = pars
        a = 1 / scale
        return a * np.log(a / mu) - lgamma(a) + (a - 1) * np.log(y) - a * y / mu

    def lcp(self, y: np.ndarray, mu: np.ndarray, scale: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(gamma_cdf(y, 1 / scale, scale * mu), 1e-300))

    def dpars(self, y: np.ndarray, *pars: np.ndarray) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
        mu, s = pars
        a = 1 / s
        inner = np.log(a / mu) + 1 - digamma(a) + np.log(y) - y / mu  # d lp / d a
        d_mu, d_s = a * (y / mu**2 - 1 / mu), -inner * a**2
        mm = a * (1 / mu**2 - 2 * y / mu**3)
        ss = (s - trigamma(a)) * a**4 + 2 * inner * a**3
        ms = -(a**2) * (y / mu**2 - 1 / mu)
        return [d_mu, d_s], [[mm, ms], [ms, ss]]

    def get_resid(self, y: np.ndarray, *pars: np.ndarray) -> np.ndarray:
        mu, scale = pars
        d = 2 * ((y - mu) / mu - np.log(y / mu)) / scale
        return np.sign(y - mu) * np.sqrt(np.maximum(d, 0))

    def rvs(self, rng: np.random.Generator, *pars: np.ndarray) -> np.ndarray:
        return rng.gamma(1 / pars[1], pars[1] * pars[0])

    def start(self, mean: float, var: float) -> list[float]:
        return [float(self.links[0].f(np.float64(max(mean, 1e-6)))), float(self.links[1].f(np.float64(max(var / max(mean, 1e-6) ** 2, 1e-3))))]


class MULNOMLSS(GAMLSSFamily):
    """Classes 0..pars by their log-odds against class 0; predictors are those log-odds.

    The cumulative distribution orders the classes 1, ..., pars, 0.
    """

    def __init__(self, pars: int) -> None:
        super().__init__(pars, [Identity() for _ in range(pars)])

    def get_probs(self, *etas: np.ndarray) -> np.ndarray:
        e = np.stack([np.zeros_like(etas[0]), *etas])
        e = np.exp(e - e.max(axis=0))
        return e / e.sum(axis=0)

    def lp(self, y: np.ndarray, *pars: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(self.get_probs(*pars)[y.astype(int), np.arange(len(y))], 1e-300))

    def lcp(self, y: np.ndarray, *pars: np.ndarray) -> np.ndarray:
        p = np.roll(self.get_probs(*pars), -1, axis=0)
        place = (y.astype(int) - 1) % len(p)
        return np.log(np.maximum(np.cumsum(p, axis=0)[place, np.arange(len(y))], 1e-300))

    def dpars(self, y: np.ndarray, *pars: np.ndarray) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
        p = self.get_probs(*pars)[1:]
        first = [(y == k + 1) - p[k] for k in range(self.n_par)]
        return first, [[-p[i] * ((i == j) - p[j]) for j in range(self.n_par)] for i in range(self.n_par)]

    def get_resid(self, y: np.ndarray, *pars: np.ndarray) -> np.ndarray:
        """Randomised quantile residuals; the random part comes from each row's own numbers."""
        seed = np.ascontiguousarray(np.column_stack((y, *pars)).astype(float)).view(np.uint64)
        mixed = np.zeros(len(y), np.uint64)
        for column in seed.T:
            mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return self.quantile_resid(y, (mixed >> np.uint64(11)).astype(float) / 2.0**53, *pars)

    def quantile_resid(self, y: np.ndarray, u: np.ndarray, *pars: np.ndarray) -> np.ndarray:
        """The residuals for given uniform numbers, one a row."""
        p = np.roll(self.get_probs(*pars), -1, axis=0)
        place, at = (y.astype(int) - 1) % len(p), np.arange(len(y))
        high = np.cumsum(p, axis=0)[place, at]
        return normal_ppf(np.clip(high - u * p[place, at], 1e-12, 1 - 1e-12))

    def rvs(self, rng: np.random.Generator, *pars: np.ndarray) -> np.ndarray:
        c = np.cumsum(self.get_probs(*pars), axis=0)
        return (rng.uniform(size=c.shape[1]) > c).sum(axis=0)
