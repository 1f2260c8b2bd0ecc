"""Tail probabilities for one-row test results."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| > |z|) of a standard normal."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)) if pd.notna(v) else None)


@F.pandas_udf(DoubleType())
def student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| > |t|) of Student's t, by quadrature of cos^(df-1) over the angle of t."""
    nodes, weights = np.polynomial.legendre.leggauss(400)

    def tail(tv: float, dv: float) -> float | None:
        if pd.isna(tv) or pd.isna(dv) or dv <= 0:
            return None
        lo, hi = math.atan(abs(tv) / math.sqrt(dv)), math.pi / 2
        # The density falls like exp(-df x^2 / 2): integrate only where it is not zero.
        hi = min(hi, lo + 40.0 / math.sqrt(dv))
        angle = (hi - lo) / 2 * nodes + (hi + lo) / 2
        log_const = math.lgamma((dv + 1) / 2) - math.lgamma(dv / 2) - 0.5 * math.log(math.pi)
        dens = np.exp(log_const + (dv - 1) * np.log(np.cos(angle)))
        return float(min(1.0, 2 * (hi - lo) / 2 * np.dot(weights, dens)))

    return pd.Series([tail(a, b) for a, b in zip(t, df)])
