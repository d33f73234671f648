"""Hypergeometric tail, multiple testing, KDE mode."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SMALL = np.array([0.0, *(math.lgamma(n + 1) - (0.5 * math.log(2 * math.pi * n) + n * math.log(n) - n) for n in range(1, 16))])


def _stirling_error(n: np.ndarray) -> np.ndarray:
    """log(n!) minus Stirling's formula."""
    m = np.maximum(n, 16.0)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / m**2) / m**2) / m**2) / m**2) / m
    return np.where(n < 16, _SMALL[np.minimum(n, 15).astype(np.int64)], series)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x / mean) + mean - x without cancellation (Loader 2000)."""
    v = (x - mean) / (x + mean)
    near = np.abs(x - mean) < 0.1 * (x + mean)
    total, power = (x - mean) * v, 2 * x * v
    for j in range(1, 12):
        power = power * v * v
        total = total + power / (2 * j + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        plain = np.where(x > 0, x * np.log(x / mean), 0.0) + mean - x
    return np.where(near, total, plain)


def _log_binomial(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log of the binomial mass in saddle-point form."""
    q = 1 - p
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = (
            _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - _deviance(k, n * p) - _deviance(n - k, n * q)
            + 0.5 * np.log(n / (2 * math.pi * k * (n - k)))
        )
        edge = np.where(k == 0, n * np.log1p(-p), n * np.log(p))
    return np.where(n == 0, 0.0, np.where((k == 0) | (k == n), edge, inner))


def hypergeom_tail(k, total, marked, drawn) -> np.ndarray:
    """P(X >= k) for X marked ones among drawn of total, of which marked are marked; NaN if marked or drawn exceed total."""
    k, total, marked, drawn = (np.asarray(x, dtype=np.float64) for x in (k, total, marked, drawn))
    out = np.full(k.shape, np.nan)
    legal = (marked <= total) & (drawn <= total) & (marked >= 0) & (drawn >= 0)
    low, high = np.maximum(0, drawn + marked - total), np.minimum(marked, drawn)
    out[legal & (k > high)] = 0.0
    out[legal & (k <= low)] = 1.0
    live = np.flatnonzero(legal & (k > low) & (k <= high))
    if not len(live):
        return out
    k, total, marked, drawn = k[live], total[live], marked[live], drawn[live]
    with np.errstate(divide="ignore", invalid="ignore"):
        upper = k > drawn * marked / total
    start = np.where(upper, k, k - 1)  # summed away from the mean, so that terms fall
    p = drawn / total
    term = np.exp(_log_binomial(start, marked, p) + _log_binomial(drawn - start, total - marked, p) - _log_binomial(drawn, total, p))
    log_first, at, summed = term.copy(), start.copy(), np.ones_like(term)
    ratio = np.ones_like(term)
    active = np.arange(len(term))
    while len(active):
        a, m, n, t, up = at[active], marked[active], drawn[active], total[active], upper[active]
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(up, (m - a) * (n - a) / ((a + 1) * (t - m - n + a + 1)), a * (t - m - n + a) / ((m - a + 1) * (n - a + 1)))
        ratio[active] *= step
        summed[active] += ratio[active]
        at[active] += np.where(up, 1, -1)
        active = active[ratio[active] > 1e-17 * summed[active]]
    tail = log_first * summed
    out[live] = np.clip(np.where(upper, tail, 1 - tail), 0.0, 1.0)
    return out


def _sf(k: pd.Series, total: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
    return pd.Series(hypergeom_tail(k, total, marked, drawn))


def hypergeom_sf(k: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """hypergeom_tail() as a vectorised UDF."""
    return F.pandas_udf(_sf, "double")(k, total, marked, drawn)


def register(spark) -> None:
    """Make hypergeom_sf(k, total, marked, drawn), kde_mode(values), random_density(distance, radius) and random_share(distance, radius)
    known to a session's SQL. kde_mode gathers a group in one task; operators.distances.modes does not."""
    spark.udf.register("hypergeom_sf", F.pandas_udf(_sf, "double"))
    spark.udf.register("kde_mode", F.pandas_udf(_mode, "double"))
    for name, body in (("random_density", "2 * distance / (radius * radius)"), ("random_share", "distance * distance / (radius * radius)")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(distance DOUBLE, radius DOUBLE) RETURNS DOUBLE RETURN {body}")


def adjusted(tests: DataFrame, by: str = "gene_A", tie: str = "gene_B") -> DataFrame:
    """tests with qvalue_BH (step-up) and qvalue_BO, over the tests of one ``by`` each; a NaN makes all of them NaN."""
    own = Window.partitionBy(by)
    ranked = tests.withColumn("_m", F.count("*").over(own)).withColumn("_rank", F.row_number().over(own.orderBy("pvalue", tie)))
    after = own.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    step_up = F.least(F.lit(1.0), F.min(F.col("pvalue") / (F.col("_rank") / F.col("_m"))).over(after))
    spoilt = F.max(F.isnan("pvalue").cast("int")).over(own) == 1
    both = ranked.withColumn("qvalue_BH", F.when(spoilt, float("nan")).otherwise(step_up))
    return both.withColumn("qvalue_BO", F.when(spoilt, float("nan")).otherwise(F.least(F.lit(1.0), F.col("pvalue") * F.col("_m")))).drop("_m", "_rank")


def kde_curve(values, points: int = 1000, bandwidth: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """A Gaussian KDE (bandwidth times the sample deviation) on equal steps from least to greatest."""
    values = np.asarray(values, dtype=np.float64)
    grid = np.linspace(values.min(), values.max(), points)
    width = bandwidth * values.std(ddof=1) if len(values) > 1 else 0.0
    density = np.zeros(points)
    if width > 0:
        for part in np.array_split(values, max(1, len(values) // 2000)):
            density += np.exp(-0.5 * ((grid[:, None] - part[None, :]) / width) ** 2).sum(axis=1)
        density /= len(values) * width * math.sqrt(2 * math.pi)
    return grid, density


def _mode(values: pd.Series) -> float:
    grid, density = kde_curve(values)
    return float(grid[int(density.argmax())])


def kde_mode(values: str) -> Column:
    """Where the KDE of a group's values is greatest."""
    return F.pandas_udf(_mode, "double")(values)


def random_density(distance: Column, radius: float) -> Column:
    """Density of the distance of a uniform point in a disk from its centre."""
    return 2 * distance / (radius * radius)


def random_share(distance: Column, radius: float) -> Column:
    return distance * distance / (radius * radius)
