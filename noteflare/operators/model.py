"""Models (M1-M5, V5, V7, S9).

``LinearScorer`` (M3) is the oracle-checkable scorer: a linear
discriminant with a diagonal pooled covariance (each feature's class means
and pooled within-class variance).  It is fitted by a single aggregate over
the training rows, map-side combined, so fitting costs one pass at any
scale; the handful of fitted numbers is read back like any model's
parameters and the transform is plain column arithmetic (codegen, no
Python per row).  Its per-feature contributions ``w * (x - mean)`` are the
exact additive explanation of a linear model.

The boosted-tree path (M1, M2, M4, M5, V5, V7, S9) uses Spark ML.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteflare.constants import SAFE_NUMERIC_COLS


def _x(c: str) -> Column:
    """Model input: numeric value with missing as 0 (as the vectoriser fills)."""
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


@dataclass(frozen=True)
class LinearScorer:
    features: tuple[str, ...]
    coef: dict[str, float]
    intercept: float
    mean: dict[str, float]

    def logit(self) -> Column:
        z = F.lit(self.intercept)
        for c in self.features:
            z = z + F.lit(self.coef[c]) * _x(c)
        return z

    def transform(self, df: DataFrame, prob_col: str = "probability") -> DataFrame:
        """M3: probability = sigmoid(b + sum w_j x_j)."""
        return df.withColumn(prob_col, F.lit(1.0) / (F.lit(1.0) + F.exp(-self.logit())))

    def contributions(self) -> Column:
        """K2: array<struct<feature, impact>> with impact = w_j * (x_j - mean_j)."""
        return F.array(*[
            F.struct(F.lit(c).alias("feature"),
                     (F.lit(self.coef[c]) * (_x(c) - F.lit(self.mean[c]))).alias("impact"))
            for c in self.features])


def fit_linear_scorer(train: DataFrame, label: str, features: Sequence[str] = SAFE_NUMERIC_COLS) -> LinearScorer:
    """Fit M3 on ``train``: one aggregate of counts, sums and sums of squares.

    w_j = (mu1_j - mu0_j) / var_j (var_j = pooled within-class variance, 0 if
    var_j = 0); b = ln(n1 / n0) - sum_j w_j (mu1_j + mu0_j) / 2.
    """
    y = F.col(label).cast("double")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("n1")]
    for c in features:
        aggs += [F.sum(_x(c)).alias(f"s_{c}"), F.sum(_x(c) * y).alias(f"s1_{c}"),
                 F.sum(_x(c) * _x(c)).alias(f"q_{c}"), F.sum(_x(c) * _x(c) * y).alias(f"q1_{c}")]
    r = train.agg(*aggs).first()
    n, n1 = float(r["n"]), float(r["n1"] or 0.0)
    n0 = n - n1
    if n1 <= 0 or n0 <= 0:
        raise ValueError(f"both classes are needed to fit a scorer (n1={n1}, n0={n0})")
    coef, mean = {}, {}
    b = math.log(n1 / n0)
    for c in features:
        s, s1, q, q1 = (float(r[f"{k}_{c}"]) for k in ("s", "s1", "q", "q1"))
        s0, q0 = s - s1, q - q1
        mu1, mu0 = s1 / n1, s0 / n0
        var = ((q1 - n1 * mu1 * mu1) + (q0 - n0 * mu0 * mu0)) / n
        w = (mu1 - mu0) / var if var > 1e-12 else 0.0
        coef[c] = w
        mean[c] = s / n
        b -= w * (mu1 + mu0) / 2.0
    return LinearScorer(tuple(features), coef, b, mean)
