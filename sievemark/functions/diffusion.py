"""Diffusion curves as column expressions and as numpy functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def bass_cumulative(t: Column, p: Column | float, q: Column | float, m: Column | float) -> Column:
    p, q, m = (x if isinstance(x, Column) else F.lit(float(x)) for x in (p, q, m))
    p = F.greatest(p, F.lit(1e-12))
    e = F.exp(-(p + q) * t)
    return m * (1 - e) / (1 + q / p * e)


def bass_rate(t: Column, p: Column | float, q: Column | float, m: Column | float) -> Column:
    p, q, m = (x if isinstance(x, Column) else F.lit(float(x)) for x in (p, q, m))
    p = F.greatest(p, F.lit(1e-12))
    e = F.exp(-(p + q) * t)
    return m * (p + q) * (p + q) / p * e / ((1 + q / p * e) * (1 + q / p * e))


def logistic_cumulative(t: Column, m: Column | float, r: Column | float, t0: Column | float) -> Column:
    m, r, t0 = (x if isinstance(x, Column) else F.lit(float(x)) for x in (m, r, t0))
    return m / (1 + F.exp(F.greatest(F.lit(-500.0), F.least(F.lit(500.0), -r * (t - t0)))))


def np_bass(t: np.ndarray, p: float, q: float, m: float) -> np.ndarray:
    p = max(p, 1e-12)
    e = np.exp(np.clip(-(p + q) * np.asarray(t, float), -700, 700))
    return m * (1 - e) / (1 + q / p * e)


def np_logistic(t: np.ndarray, m: float, r: float, t0: float) -> np.ndarray:
    return m / (1 + np.exp(np.clip(-r * (np.asarray(t, float) - t0), -500, 500)))


#: model -> (cumulative curve, parameter names)
CURVES = {"bass": (np_bass, ("p", "q", "m")), "logistic": (np_logistic, ("m", "r", "t0"))}


def period_counts(model: str, t: np.ndarray, params: np.ndarray) -> np.ndarray:
    """F(t + 1) - F(t)."""
    f = CURVES[model][0]
    t = np.asarray(t, float)
    return f(t + 1, *params) - f(t, *params)
