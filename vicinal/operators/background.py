"""What a pair is tested against: totals of the whole slice, or sums over the cells that hold both genes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import sinks
from .prep import cell_gene_counts, cell_totals, gene_counts, slice_total

COUNTS = ["gene_A", "gene_B", "gene_B_around", "gene_B_slice", "gene_around", "gene_slice", "gene_A_N", "gene_B_N"]


def all_background(pairs: DataFrame, around: DataFrame, points: DataFrame, pixels: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """Counts of each pair: k, n_B, n, M over all cells, n_A, n_B. counts: gene_counts() of the points, if they are written already."""
    counts = sinks.staged(gene_counts(points), sinks.shared_path(points.sparkSession, "genes")) if counts is None else counts
    total = slice_total(points, pixels) if pixels else counts.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("total"))
    of = lambda gene, name: counts.select(F.col("geneID").alias(gene), F.col("n").alias(name))
    joined = pairs.join(around, "A").join(of("A", "n_a"), "A").join(of("B", "n_b"), "B").crossJoin(total)
    return joined.select(
        F.col("A").alias("gene_A"), F.col("B").alias("gene_B"), F.col("k").alias("gene_B_around"), F.col("n_b").alias("gene_B_slice"),
        F.col("n").alias("gene_around"), F.col("total").alias("gene_slice"), F.col("n_a").alias("gene_A_N"), F.col("n_b").alias("gene_B_N"),
    )


def cooccurrence_background(pairs: DataFrame, around_by_cell: DataFrame, points: DataFrame, pixels: bool = False) -> DataFrame:
    """Counts of each pair, summed over the cells with both genes; pairs without neighbours are left out before the sum."""
    genes = sinks.staged(cell_gene_counts(points, pixels), sinks.shared_path(points.sparkSession, "cell-genes"))
    totals = cell_totals(points, pixels) if pixels else genes.groupBy("cell").agg(F.sum("n").alias("total"))
    first = genes.withColumnRenamed("geneID", "A").withColumnRenamed("n", "n_a").join(around_by_cell, ["cell", "A"]).join(totals, "cell")
    second = genes.select("cell", F.col("geneID").alias("B"), F.col("n").alias("n_b"))
    both = first.join(second, "cell").where("A <> B").join(pairs.select("A", "B"), ["A", "B"], "left_semi")
    sums = both.groupBy("A", "B").agg(*[F.sum(c).alias(c) for c in ("n", "n_b", "total", "n_a")])
    return pairs.join(sums, ["A", "B"]).select(
        F.col("A").alias("gene_A"), F.col("B").alias("gene_B"), F.col("k").alias("gene_B_around"), F.col("n_b").alias("gene_B_slice"),
        F.col("n").alias("gene_around"), F.col("total").alias("gene_slice"), F.col("n_a").alias("gene_A_N"), F.col("n_b").alias("gene_B_N"),
    )
