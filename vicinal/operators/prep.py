"""Counts and filters that come before the neighbour search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import sinks


def gene_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("geneID").agg(F.count("*").alias("n"))


def frequent(points: DataFrame, least: int) -> DataFrame:
    """Points of genes with at least so many points."""
    genes = sinks.lookup(gene_counts(points).where(F.col("n") >= least).select("geneID"), "frequent")
    return points.join(genes, "geneID", "left_semi").select(points.columns)


def slice_total(points: DataFrame, pixels: bool = False) -> DataFrame:
    """One row: number of points, or of distinct positions."""
    if pixels:
        return points.select("x", "y", "z").distinct().agg(F.count("*").alias("total"))
    return points.agg(F.count("*").alias("total"))


def pixel_distinct(points: DataFrame) -> DataFrame:
    """One point for each gene and position over all cells; of several cells the smallest name stays."""
    keys = ["geneID", "x", "y", "z"]
    if "cell" not in points.columns:
        return points.select("x", "y", "z", "geneID").distinct()
    return points.groupBy(*keys).agg(F.min("cell").alias("cell")).select("x", "y", "z", "geneID", "cell")


def cell_gene_counts(points: DataFrame, pixels: bool = False) -> DataFrame:
    """cell, geneID, n."""
    own = points.select("cell", "geneID", "x", "y", "z").distinct() if pixels else points
    return own.groupBy("cell", "geneID").agg(F.count("*").alias("n"))


def cell_totals(points: DataFrame, pixels: bool = False) -> DataFrame:
    """cell, total."""
    own = points.select("cell", "x", "y", "z").distinct() if pixels else points
    return own.groupBy("cell").agg(F.count("*").alias("total"))
