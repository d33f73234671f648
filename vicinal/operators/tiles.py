"""Tiles for data without cells: a point belongs to each tile whose closed rectangle holds it, and helps in each tile in reach."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounds(points: DataFrame) -> tuple[float, float, float, float] | None:
    r = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    return None if r[0] is None else tuple(float(v) for v in r)


def _assigned(points: DataFrame, axis: str, low: float, high: float, length: float, reach: float, core: str = "") -> DataFrame:
    """points once for each tile of an axis whose closed range, widened by reach, holds them. core names a column for whether the range itself does."""
    n = max(0, math.ceil((high - low) / length))
    first = F.floor((F.col(axis) - reach - low) / length) - 1
    last = F.floor((F.col(axis) + reach - low) / length) + 1
    tile = F.explode(F.sequence(F.greatest(first, F.lit(0)), F.greatest(F.least(last, F.lit(n - 1)), F.lit(0))))
    start = F.lit(low) + F.col("_t") * F.lit(length)
    stop = F.least(start + length, F.lit(high))
    held = points.withColumn("_t", tile).where((F.col(axis) >= start - reach) & (F.col(axis) <= stop + reach) & F.lit(n > 0))
    if core:
        held = held.withColumn(core, (F.col(axis) >= start) & (F.col(axis) <= stop))
    return held.withColumnRenamed("_t", f"t{axis}")


def tiled(points: DataFrame, length: float, reach: float) -> tuple[DataFrame, DataFrame]:
    """(points of the widened tiles, centres of the tiles), with the tile as ``cell``. An extent of zero on an axis makes no tile."""
    box = bounds(points)
    flat = points.select("x", "y", F.lit(0.0).alias("z"), "geneID")
    x0, x1, y0, y1 = box or (0.0, 0.0, 0.0, 0.0)

    def cut(by: float) -> DataFrame:
        own = _assigned(_assigned(flat, "x", x0, x1, length, by), "y", y0, y1, length, by)
        return own.select("x", "y", "z", "geneID", F.concat_ws(",", "tx", "ty").alias("cell"))

    return cut(reach), cut(0.0)


def marked(points: DataFrame, length: float, reach: float) -> DataFrame:
    """The points of the widened tiles (x, y, geneID), with the tile as ``cell`` and ``core``: whether they are a centre of it."""
    x0, x1, y0, y1 = bounds(points) or (0.0, 0.0, 0.0, 0.0)
    own = _assigned(_assigned(points.select("x", "y", "geneID"), "x", x0, x1, length, reach, "_x"), "y", y0, y1, length, reach, "_y")
    return own.select("x", "y", "geneID", F.concat_ws(",", "tx", "ty").alias("cell"), (F.col("_x") & F.col("_y")).alias("core"))
