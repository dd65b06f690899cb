"""Two-sample Kolmogorov-Smirnov p-value as a Column expression.

Asymptotic series Q(lambda) = 2 * sum_{k=1..100} (-1)^(k-1) exp(-2 k^2 lambda^2) with
lambda = sqrt(n1 n2 / (n1 + n2)) * D. p = 1 when lambda < 0.2 (the truncated series is
not valid there; the true value is 1 to 6 digits). This is an approximation of the exact
small-sample distribution; see README for the measured error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS = 100


def ks_lambda(d, n1, n2) -> Column:
    n1 = F.col(n1).cast("double") if isinstance(n1, str) else n1.cast("double")
    n2 = F.col(n2).cast("double") if isinstance(n2, str) else n2.cast("double")
    d = F.col(d) if isinstance(d, str) else d
    return F.sqrt(F.try_divide(n1 * n2, n1 + n2)) * d


def ks_pvalue(d, n1, n2) -> Column:
    lam = ks_lambda(d, n1, n2)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        * F.exp(F.lit(-2.0) * k * k * lam * lam))
    p = F.least(F.greatest(F.lit(2.0) * series, F.lit(0.0)), F.lit(1.0))
    return F.when(lam.isNull(), F.lit(None).cast("double")).when(lam < 0.2, F.lit(1.0)).otherwise(p)
