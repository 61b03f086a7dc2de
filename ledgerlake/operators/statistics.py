"""Regression and isotonic statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ledgerlake.plans.registry import query
from ledgerlake.sources.tables import LEDGER_SQL, ledger


@query(f"""WITH {LEDGER_SQL} SELECT chain, count(*) AS n, round(regr_slope(ln(label), feature), 6) AS slope, round(regr_intercept(ln(label), feature), 6) AS intercept FROM ledger WHERE label > 0 GROUP BY chain""")
def log_regression(spark, sf_dir):
    """Least squares of log label on the feature, from sums that are partial before the shuffle."""
    d = ledger(spark, sf_dir).where("label > 0")
    return d.groupBy("chain").agg(F.count("*").alias("n"), F.round(F.regr_slope(F.log("label"), "feature"), 6).alias("slope"), F.round(F.regr_intercept(F.log("label"), "feature"), 6).alias("intercept"))


def pava(y: np.ndarray, w: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """Weighted least-squares fit that never falls: blocks that violate the order are pooled. total: w y, where that is exact."""
    weight, sums, size = [], [], []
    for a, b in zip(y * w if total is None else total, w, strict=True):
        sums.append(a)
        weight.append(b)
        size.append(1)
        while len(sums) > 1 and sums[-2] * weight[-1] > sums[-1] * weight[-2]:
            a, b, n = sums.pop(), weight.pop(), size.pop()
            sums[-1] += a
            weight[-1] += b
            size[-1] += n
    return np.repeat(np.array(sums) / np.array(weight), size)
