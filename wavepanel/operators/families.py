"""Response families: variance, link, unit deviance and the JVM-side sufficient statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from wavepanel.functions import numeric

# Default link and whether the dispersion is known to be 1.
_DEFAULTS = {
    "gaussian": ("identity", False),
    "binomial": ("logit", True),
    "poisson": ("log", True),
    "gamma": ("inverse", False),
    "inverse_gaussian": ("1/mu^2", False),
    "negbin": ("log", True),
    "quasi": ("identity", False),
    "quasibinomial": ("logit", False),
    "quasipoisson": ("log", False),
}
_LINKS = ("identity", "logit", "log", "inverse", "1/mu^2")
_SHAPE = {"quasi": "gaussian", "quasibinomial": "binomial", "quasipoisson": "poisson"}


def _xlogy(y):
    return F.when(y > 0, y * F.log(y)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Family:
    name: str
    link: str
    dispersion_known: bool
    theta: float | None = None
    truncated: bool = False     # response conditioned on being positive

    @property
    def shape(self) -> str:
        """The family whose variance and deviance apply."""
        return _SHAPE.get(self.name, self.name)

    @property
    def observed_weights(self) -> bool:
        """Gamma with log link: the log-likelihood is concave with Hessian weights n * mean_y / mu.

        Stepping with them converges quadratically; the expected weights,
        which the covariance needs, are just n.
        """
        return self.shape == "gamma" and self.link == "log"

    @property
    def quadratic(self) -> bool:
        """Steps use the exact Hessian: canonical links, and Gamma-log with observed weights."""
        canonical = {"gaussian": "identity", "binomial": "logit", "poisson": "log", "gamma": "inverse",
                     "inverse_gaussian": "1/mu^2"}
        return canonical.get(self.shape) == self.link or self.observed_weights

    # ------------------------------------------------ columns (JVM)

    def bad_response(self, y: Column) -> Column:
        if self.shape == "binomial":
            return (y < 0) | (y > 1)
        if self.shape in ("gamma", "inverse_gaussian"):
            return y <= 0
        if self.shape in ("poisson", "negbin"):
            return y < 0
        return F.lit(False)

    def saturated(self, y: Column) -> Column:
        """The part of the deviance that depends on y alone, summed per pattern."""
        if self.shape == "binomial":
            return _xlogy(y) + _xlogy(F.lit(1.0) - y)
        if self.shape == "poisson":
            return _xlogy(y)
        if self.shape == "gamma":
            return F.log(y)
        if self.shape == "inverse_gaussian":
            return F.lit(1.0) / y
        if self.shape == "negbin":
            return _xlogy(y) - (y + F.lit(self.theta)) * F.log(y + F.lit(self.theta))
        return F.lit(0.0)

    # ------------------------------------------------ arrays (inside tasks)

    def density_constant(self, y):
        """The part of the log density that depends on y alone and that the deviance lacks; None where there is none."""
        if self.name == "poisson":
            return -y - numeric.lgamma(y + 1)
        if self.name == "negbin":
            t = self.theta
            return numeric.lgamma(y + t) - numeric.lgamma(np.full_like(y, t)) - numeric.lgamma(y + 1) + t * math.log(t)
        if self.name == "inverse_gaussian":
            return -1.5 * np.log(y)
        return None

    def link_fun(self, mu):
        return {"identity": lambda m: m, "logit": lambda m: np.log(m / (1 - m)), "log": np.log,
                "inverse": lambda m: 1 / m, "1/mu^2": lambda m: m**-2.0}[self.link](mu)

    def mean(self, eta):
        if self.link == "logit":
            return np.clip(1 / (1 + np.exp(-np.clip(eta, -700, 700))), 1e-15, 1 - 1e-15)
        if self.link == "log":
            return np.maximum(np.exp(np.minimum(eta, 700)), 1e-300)
        if self.link == "inverse":
            return 1 / eta
        if self.link == "1/mu^2":
            return 1 / np.sqrt(eta)
        return eta

    def slope(self, eta, mu):
        """d mu / d eta."""
        if self.link == "logit":
            return np.maximum(mu * (1 - mu), 1e-300)
        if self.link == "log":
            return mu
        if self.link == "inverse":
            return -mu * mu
        if self.link == "1/mu^2":
            return -0.5 * mu**3
        return np.ones_like(mu)

    def variance(self, mu):
        s = self.shape
        if s == "binomial":
            return np.maximum(mu * (1 - mu), 1e-300)
        if s == "poisson":
            return mu
        if s == "gamma":
            return mu * mu
        if s == "inverse_gaussian":
            return mu**3
        if s == "negbin":
            return mu + mu * mu / self.theta
        return np.ones_like(mu)

    def start(self, n, mean_y):
        s = self.shape
        if s == "binomial":
            return (n * mean_y + 0.5) / (n + 1)
        if s == "poisson":
            return mean_y + 0.1
        if s == "negbin":
            return np.where(mean_y > 0, mean_y, 1 / 6)
        return mean_y

    def valid(self, eta, mu):
        ok = np.isfinite(eta) & np.isfinite(mu)
        if self.shape in ("gamma", "inverse_gaussian", "poisson", "negbin"):
            ok &= mu > 0
        return ok

    def deviance(self, n, mean_y, within, saturated, mu):
        """Summed unit deviance of patterns given n, mean, within-pattern squares and the y-only part."""
        s = self.shape
        if s == "binomial":
            return 2 * (saturated - n * (mean_y * np.log(mu) + (1 - mean_y) * np.log1p(-mu)))
        if s == "poisson":
            return 2 * (saturated - n * mean_y * np.log(mu) - n * (mean_y - mu))
        if s == "gamma":
            return 2 * (n * np.log(mu) - saturated + n * (mean_y - mu) / mu)
        if s == "inverse_gaussian":
            return n * mean_y / mu**2 - 2 * n / mu + saturated
        if s == "negbin":
            t = self.theta
            return 2 * (saturated - n * mean_y * np.log(mu) + n * (mean_y + t) * np.log(mu + t))
        return within + n * (mean_y - mu) ** 2

    def cdf(self, y, mu, dispersion=1.0, shape=None):
        """(P(Y < y), P(Y <= y)) under the fitted mean; equal for continuous families."""
        s = self.shape
        y, mu = np.asarray(y, float), np.asarray(mu, float)
        if s == "binomial":
            return np.where(y > 0, 1 - mu, 0.0), np.where(y > 0, 1.0, 1 - mu)
        if s == "poisson":
            return numeric.poisson_cdf(y - 1, mu), numeric.poisson_cdf(y, mu)
        if s == "negbin":
            low, high = numeric.negbin_cdf(y - 1, mu, self.theta), numeric.negbin_cdf(y, mu, self.theta)
            if self.truncated:
                zero = numeric.negbin_cdf(np.zeros(mu.shape), mu, self.theta)
                low, high = (np.clip((v - zero) / (1 - zero), 0, 1) for v in (low, high))
            return low, high
        if s == "gamma":
            u = numeric.gamma_cdf(shape, np.maximum(y, 0) * shape / mu)
        elif s == "inverse_gaussian":
            lam = 1 / dispersion
            root = np.sqrt(lam / y)
            u = numeric.normal_cdf(root * (y / mu - 1)) + np.exp(2 * lam / mu) * numeric.normal_cdf(-root * (y / mu + 1))
        else:
            u = numeric.normal_cdf((y - mu) / math.sqrt(dispersion))
        return u, u


def family(name: str | Family, link: str | None = None, theta: float | None = None) -> Family:
    if isinstance(name, Family):
        return name
    key = name.lower().replace(".", "_")
    if key not in _DEFAULTS:
        raise ValueError(f"unknown family {name!r}; one of {sorted(_DEFAULTS)}")
    default, known = _DEFAULTS[key]
    link = link or default
    if link not in _LINKS:
        raise ValueError(f"unknown link {link!r}; one of {_LINKS}")
    if key == "negbin" and not (theta and theta > 0):
        raise ValueError("negbin needs theta > 0; fit_negbin estimates it")
    return Family(key, link, known, theta)
