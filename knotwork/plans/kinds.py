"""Names of choices; each is the string that it stands for and is taken wherever that string is."""

from __future__ import annotations

from enum import StrEnum


class ConstType(StrEnum):
    """How a smooth is made identifiable."""

    QR = "QR"
    DROP = "DROP"
    DIFF = "DIFF"


class Method(StrEnum):
    """How a joint model's coefficients are found."""

    NEWTON = "Newton"
    QEFS = "qEFS"
    SR1 = "SR1"
    LBFGS = "L-BFGS"
    GRAD = "Grad"


class Extension(StrEnum):
    """How steps of the smoothing parameters are lengthened."""

    RATIO = "ratio"
    NESTEROV = "nesterov"
    NONE = "none"


class Residual(StrEnum):
    PEARSON = "Pearson"
    DEVIANCE = "Deviance"
    AR1 = "ar1"
    MARTINGALE = "Martingale"
