"""The data behind the two figures: a map of cells and distance curves beside the random expectation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import kernel_sums
from ..functions.stats import random_density
from ..sources import sinks

RANDOM = "Random expectation"


def tissue_map(events: DataFrame, flip_x: bool = False) -> DataFrame:
    """events of one pair with x_relative and y_relative: positions from the least, x mirrored if asked for."""
    x = -F.col("cell_x") if flip_x else F.col("cell_x")
    origin = events.agg(F.min(x).alias("_x0"), F.min("cell_y").alias("_y0"))
    placed = events.crossJoin(F.broadcast(origin))  # one row
    return placed.withColumns({"x_relative": x - F.col("_x0"), "y_relative": F.col("cell_y") - F.col("_y0")}).drop("_x0", "_y0")


def distance_curves(found: DataFrame, reach: float, points: int = 600) -> DataFrame:
    """pair, distance, density: for each pair (columns pair, distance) a Gaussian KDE on an even grid from 0 to reach,
    bandwidth by Scott's rule, scaled to area 1 on the grid; and the density of random points in a disk.

    The sums are those of kernels.kernel_sums: distances are added up by step of the grid before anything moves, and a group is a
    pair's steps. Pairs with fewer than two different distances, or with kernels that are zero at all points, have no curve. found is read twice and should be a written table.
    """
    own = found.where((F.col("distance") >= 0) & (F.col("distance") <= reach))
    facts = sinks.lookup(own.groupBy("pair").agg(F.count("*").alias("n"), F.stddev_samp("distance").alias("s")).where("n > 1 AND s > 0"), "curve-facts")
    step = reach / (points - 1)
    bandwidth = (F.col("s") * F.pow(F.col("n"), F.lit(-0.2)) / step).alias("bandwidth")
    none = F.array().cast("array<double>").alias("facts")
    rows = own.join(facts, "pair").select("pair", F.least(F.col("distance") / step, F.lit(points - 1.0)).alias("spot"), bandwidth, F.lit(1.0).alias("times"), none)

    def scaled(sums: np.ndarray, _) -> pd.DataFrame:
        area = (sums[:-1] + sums[1:]).sum() / 2 * step
        if not area > 0:
            return pd.DataFrame({"distance": np.zeros(0), "density": np.zeros(0)})
        return pd.DataFrame({"distance": np.arange(points) * step, "density": sums / area})

    curves = kernel_sums(rows, ["pair"], points, scaled, "distance double, density double")
    grid = found.sparkSession.range(points).select((F.col("id") * step).alias("at"))
    return curves.union(grid.select(F.lit(RANDOM).alias("pair"), F.col("at").alias("distance"), random_density(F.col("at"), reach).alias("density")))
