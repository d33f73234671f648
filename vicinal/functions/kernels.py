"""Gaussian kernel sums on even grids, for groups of any size.

Positions and bandwidths are in steps of a group's grid. Where the bandwidth is less than SMOOTH steps, the steps are cut into as many equal
parts as make it SMOOTH parts, at most FINEST; a part is a step in what follows. The rows of each step are
added up to their powers about its middle, a partial aggregate of MOMENTS + 1 sums, and each group's few steps are convolved
with the kernel's Hermite expansion. For t steps of bandwidth from a step's middle and v from it to a row,

    exp(-(t - v)^2 / 2) = exp(-t^2 / 2) * sum over k of He_k(t) v^k / k!

and as |v| is at most 1 / (2 SMOOTH), the terms left out come to less than (1 / 8)^11 / sqrt(11!) < 2e-14 a row, and what lies beyond REACH
bandwidths to less than 3e-18. Still narrower kernels touch ten points of the grid at most: each row is dealt to those at which its kernel isn't zero as a
number, in UNDERFLOW bandwidths, and these are summed; so a curve is told even where all points lie far from all rows (a wider kernel is at least 3e-4 at the point next to its row).
Either way no task holds a group, but at most FINEST sums for each step of its grid.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least bandwidth, in steps, of the expansion; its highest power; bandwidths after which a kernel is left out there, and after which it is zero as a number; parts of a step.
SMOOTH, MOMENTS, REACH, UNDERFLOW, FINEST = 4.0, 10, 9.0, 38.7, 32


def convolved(steps: np.ndarray, moments: np.ndarray, bandwidth: float, points: int) -> np.ndarray:
    """Kernel sums at 0 .. points - 1 of rows whose powers about the middles of ``steps`` are ``moments`` (a row for each step)."""
    dense = np.zeros((MOMENTS + 1, points))
    dense[:, steps] = moments.T
    reach = min(points, math.ceil(REACH * bandwidth) + 1)
    t = (np.arange(-reach, reach) + 0.5) / bandwidth  # from the middle of a step to points of the grid
    bell, before, hermite = np.exp(-0.5 * t * t), np.zeros_like(t), np.ones_like(t)
    total, scale = np.zeros(points), 1.0
    for k in range(MOMENTS + 1):
        total += np.convolve(dense[k], hermite * bell)[reach - 1 : reach - 1 + points] * scale
        before, hermite = hermite, t * hermite - k * before
        scale /= (k + 1) * bandwidth
    return total


def _powers(offset: Column) -> list[Column]:
    out, power = [], F.lit(1.0)
    for k in range(MOMENTS + 1):
        out.append(F.sum(power * F.col("times")).alias(f"m{k}"))
        power = power * offset
    return out


def kernel_sums(rows: DataFrame, keys: list[str], points: int, result, schema: str) -> DataFrame:
    """result(sums, facts) of each group of rows (keys, spot, bandwidth, times, facts): sums are those of the Gaussian kernels, at their full height, at
    0 .. points - 1; facts is the group's struct column, the same in all its rows. ``times`` counts equal rows; spots are in [0, points - 1].
    result returns a pandas table of ``schema``, to which the keys are added. Groups without bandwidth (0 or null), or all of whose points are zero, have no result."""
    names = [f"m{k}" for k in range(MOMENTS + 1)]
    kinds = dict(rows.dtypes)
    own = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def with_keys(group, found):
        for at, k in enumerate(keys):
            found.insert(at, k, group[k].iloc[0])
        return found

    def smooth(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        parts = int(first["parts"])
        sums = convolved(group["step"].to_numpy(), group[names].to_numpy(), first["bandwidth"] * parts, (points - 1) * parts + 1)[::parts]
        return with_keys(group, result(sums, first["facts"]))

    def narrow(group: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros(points)
        sums[group["step"].to_numpy()] = group["total"].to_numpy()
        return with_keys(group, result(sums, group["facts"].iloc[0]))

    wide = rows.where(F.col("bandwidth") >= SMOOTH / FINEST).withColumn("parts", F.greatest(F.lit(1), F.ceil(SMOOTH / F.col("bandwidth"))).cast("int"))
    wide = wide.withColumn("spot", F.col("spot") * F.col("parts"))
    step = F.least(F.floor("spot"), (points - 1) * F.col("parts")).cast("int").alias("step")
    ours = [F.first(c).alias(c) for c in ("bandwidth", "parts", "facts")]
    steps = wide.select("*", step).groupBy(*keys, "step").agg(*ours, *_powers(F.col("spot") - F.col("step") - 0.5))
    tight = rows.where((F.col("bandwidth") > 0) & (F.col("bandwidth") < SMOOTH / FINEST))
    low, high = F.ceil(F.col("spot") - UNDERFLOW * F.col("bandwidth")), F.floor(F.col("spot") + UNDERFLOW * F.col("bandwidth"))
    near = F.explode(F.when(low <= high, F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(points - 1)))))
    touched = tight.select("*", near.alias("at"))
    bell = F.exp(-0.5 * F.pow((F.col("at") - F.col("spot")) / F.col("bandwidth"), 2)) * F.col("times")
    totals = touched.groupBy(*keys, F.col("at").cast("int").alias("step")).agg(F.first("facts").alias("facts"), F.sum(bell).alias("total"))
    # A group here is at most one row for each part of a step, or for each point of the grid.
    out = f"{own}, {schema}"
    return steps.groupBy(*keys).applyInPandas(smooth, out).unionByName(totals.groupBy(*keys).applyInPandas(narrow, out))
