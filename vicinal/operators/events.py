"""Co-localisation events of requested pairs in every cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbors import matched

#: Pairs of a request that are broadcast to every cell at once; more are dealt in blocks of so many.
BLOCK = 50_000


def cell_centres(points: DataFrame) -> DataFrame:
    """cell, cell_x, cell_y: medians of all its points' coordinates."""
    return points.groupBy("cell").agg(F.median("x").alias("cell_x"), F.median("y").alias("cell_y"))


def _each_pair(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every cell with every requested pair: a request of one block is broadcast, a longer one joined by block."""
    blocks = -(-pairs.count() // BLOCK)
    if blocks <= 1:
        return cells.crossJoin(F.broadcast(pairs))
    dealt = pairs.withColumn("_block", F.pmod(F.xxhash64("gene_1", "gene_2"), F.lit(blocks)))
    return cells.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(dealt, "_block").drop("_block")


def cell_events(points: DataFrame, pairs: DataFrame, reach: float, z_mode: str = "discrete") -> DataFrame:
    """A row for each cell and pair (gene_1, gene_2), zeros included; events are pairs of rows in reach."""
    genes = pairs.select(F.col("gene_1").alias("geneID")).union(pairs.select("gene_2")).distinct()
    own = points.join(genes, "geneID", "left_semi")
    counted = own.groupBy("cell", "z", "x", "y", "geneID").agg(F.count("*").alias("m"))
    found = matched(counted, counted.withColumnRenamed("m", "m_a"), reach, z_mode=z_mode, keep=("m",), keep_centre=("m_a",))
    found = found.select("cell", F.col("A").alias("gene_1"), F.col("geneID").alias("gene_2"), (F.col("m") * F.col("m_a")).alias("_e"))
    events = found.join(pairs.select("gene_1", "gene_2"), ["gene_1", "gene_2"], "left_semi").groupBy("cell", "gene_1", "gene_2").agg(F.sum("_e").alias("events"))
    counts = own.groupBy("cell", "geneID").agg(F.count("*").alias("n"))
    of = lambda gene, name: counts.select("cell", F.col("geneID").alias(gene), F.col("n").alias(name))
    every = _each_pair(cell_centres(points), pairs)
    joined = every.join(of("gene_1", "n_1"), ["cell", "gene_1"], "left").join(of("gene_2", "n_2"), ["cell", "gene_2"], "left").join(events, ["cell", "gene_1", "gene_2"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return joined.select(
        "cell", "cell_x", "cell_y", F.col("gene_1").alias("gene_A"), F.col("gene_2").alias("gene_B"), F.lit(float(reach)).alias("r_check"),
        zero("n_1").alias("gene_A_count"), zero("n_2").alias("gene_B_count"), zero("events").alias("colocalization_count"),
    )
