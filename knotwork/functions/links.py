"""Link functions that take numpy arrays as well as Spark columns."""

from __future__ import annotations

from abc import ABC, abstractmethod
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class _On:
    """The same formula on arrays and on columns."""

    @staticmethod
    def log(x: Any) -> Any:
        return F.log(x) if isinstance(x, Column) else np.log(x)

    @staticmethod
    def log1p(x: Any) -> Any:
        return F.log1p(x) if isinstance(x, Column) else np.log1p(x)

    @staticmethod
    def exp(x: Any) -> Any:
        return F.exp(x) if isinstance(x, Column) else np.exp(x)

    @staticmethod
    def where(c: Any, a: Any, b: Any) -> Any:
        if isinstance(c, Column):
            return F.when(c, a).otherwise(b)
        return np.where(c, a, b)


on = _On


class Link(ABC):
    """``f`` maps the mean to the linear predictor, ``fi`` back; ``dy1``, ``dy2`` are derivatives of ``f``."""

    @abstractmethod
    def f(self, mu: Any) -> Any: ...

    @abstractmethod
    def fi(self, eta: Any) -> Any: ...

    @abstractmethod
    def dy1(self, mu: Any) -> Any: ...

    @abstractmethod
    def dy2(self, mu: Any) -> Any: ...


class Identity(Link):
    def f(self, mu: Any) -> Any:
        return mu

    def fi(self, eta: Any) -> Any:
        return eta

    def dy1(self, mu: Any) -> Any:
        return mu * 0 + 1.0

    def dy2(self, mu: Any) -> Any:
        return mu * 0.0


class Logit(Link):
    def f(self, mu: Any) -> Any:
        return on.log(mu / (1 - mu))

    def fi(self, eta: Any) -> Any:
        return 1 / (1 + on.exp(-eta))

    def dy1(self, mu: Any) -> Any:
        return 1 / (mu * (1 - mu))

    def dy2(self, mu: Any) -> Any:
        return (2 * mu - 1) / (mu * mu * (1 - mu) * (1 - mu))


class LOG(Link):
    def f(self, mu: Any) -> Any:
        return on.log(mu)

    def fi(self, eta: Any) -> Any:
        return on.exp(eta)

    def dy1(self, mu: Any) -> Any:
        return 1 / mu

    def dy2(self, mu: Any) -> Any:
        return -1 / (mu * mu)


class LOGb(Link):
    """Log of the mean plus ``b``; with a negative ``b`` the mean stays above ``-b``."""

    def __init__(self, b: float = -0.0001) -> None:
        self.b = b

    def f(self, mu: Any) -> Any:
        return on.log(mu + self.b)

    def fi(self, eta: Any) -> Any:
        return on.exp(eta) - self.b

    def dy1(self, mu: Any) -> Any:
        return 1 / (mu + self.b)

    def dy2(self, mu: Any) -> Any:
        return -1 / ((mu + self.b) * (mu + self.b))
