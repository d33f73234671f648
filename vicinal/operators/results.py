"""Tests of pairs, ratios, and the one direction of a pair that is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import adjusted, hypergeom_sf
from ..sources import sinks

ORDER = ["gene_A", "gene_B", "pvalue", "qvalue_BH", "qvalue_BO", "gene_B_around", "gene_B_slice", "gene_around", "gene_slice", "gene_A_N", "gene_B_N", "pair", "enrichment_ratio", "support_ratio"]


def eligible(counts: DataFrame, least_neighbours: int = 1, expression_level: float = 100.0) -> DataFrame:
    """Pairs with enough neighbours and balanced expression; tests and their corrections see only these."""
    a, b = F.col("gene_A_N"), F.col("gene_B_N")
    return counts.where((F.col("gene_B_around") >= least_neighbours) & (a / b <= expression_level) & (b / a <= expression_level))


def tested(counts: DataFrame) -> DataFrame:
    """counts with pvalue, qvalue_BH and qvalue_BO, corrected within each gene_A."""
    p = hypergeom_sf(F.col("gene_B_around"), F.col("gene_slice"), F.col("gene_B_slice"), F.col("gene_around"))
    return adjusted(counts.withColumn("pvalue", p))


def with_ratios(tests: DataFrame) -> DataFrame:
    a, b = F.col("gene_A"), F.col("gene_B")
    enrichment = (F.col("gene_B_around") / F.col("gene_around")) / (F.col("gene_B_slice") / F.col("gene_slice"))
    support = F.col("gene_B_around") / F.least("gene_A_N", "gene_B_N")
    pair = F.concat(F.least(a, b), F.lit("_"), F.greatest(a, b))
    return tests.withColumns({"pair": pair, "enrichment_ratio": enrichment, "support_ratio": support}).select(ORDER)


def one_direction(results: DataFrame, keep: str = "last") -> DataFrame:
    """Of A-B and B-A the better (first) or the worse (last) by q, then enrichment, then names."""
    if keep not in ("first", "last"):
        raise ValueError("keep must be first or last")
    up, down = (F.asc, F.desc) if keep == "first" else (F.desc, F.asc)
    own = Window.partitionBy(F.least("gene_A", "gene_B"), F.greatest("gene_A", "gene_B"))
    row = F.row_number().over(own.orderBy(up("qvalue_BH"), down("enrichment_ratio"), up("gene_A"), up("gene_B")))
    return results.withColumn("_row", row).where("_row = 1").drop("_row")


def both_directions(results: DataFrame, threshold: float) -> DataFrame:
    """Both directions of every pair of which one is significant."""
    own = Window.partitionBy("pair")
    return results.withColumn("_any", F.max((F.col("qvalue_BH") < threshold).cast("int")).over(own)).where("_any = 1").drop("_any")


def significant(results: DataFrame, threshold: float) -> DataFrame:
    return results.where(F.col("qvalue_BH") < threshold)


def ordered(results: DataFrame) -> DataFrame:
    return results.orderBy(F.asc("qvalue_BH"), F.desc("enrichment_ratio"), "gene_A", "gene_B")


def numbered(results: DataFrame) -> DataFrame:
    """ordered() with ``place``, each row's number from 0."""
    return sinks.numbered(ordered(results))
