"""Whole analyses: from points to tested pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig, check_radii
from ..operators import background, distances, neighbors, prep, results, tiles
from ..sources import sinks


def _identity(config: RunConfig) -> str:
    if config.detection_method == "nine_grid":
        return "pixel"
    by_value = config.unsegmented or config.background == "cooccurrence" or config.distribution_analysis
    return "value" if by_value else "row"


def prepared(points: DataFrame, config: RunConfig) -> DataFrame:
    """Points of frequent genes; on a grid with the whole slice as background, one for each gene and pixel."""
    if config.exclude_cells:
        points = points.where(~F.col("cell").isin(*config.exclude_cells))
    own = prep.frequent(points, config.min_gene_number)
    if config.detection_method == "nine_grid" and config.background == "all":
        return prep.pixel_distinct(own)
    return own


def near_of(own: DataFrame, config: RunConfig, reach: float) -> DataFrame:
    metric = "grid" if config.detection_method == "nine_grid" else "radius"
    if config.unsegmented:
        wide, core = tiles.tiled(own, config.rect_length, reach)
        return neighbors.near_genes(wide, reach, metric, centres=core, width=config.bucket_width)
    z_mode = "discrete" if metric == "grid" else config.z_mode
    return neighbors.near_genes(own, reach, metric, z_mode, width=config.bucket_width)


def pair_background(own: DataFrame, near: DataFrame, config: RunConfig) -> DataFrame:
    """The counts of every pair with neighbours."""
    identity, pixels = _identity(config), config.detection_method == "nine_grid"
    together = config.background == "cooccurrence"
    pairs, around = neighbors.pairs_and_around(near, identity, by_cell=together)
    return (background.cooccurrence_background if together else background.all_background)(pairs, around, own, pixels)


def _tested(counts: DataFrame, config: RunConfig) -> DataFrame:
    return results.with_ratios(results.tested(results.eligible(counts, config.min_neighbor_number, config.expression_level)))


def _flat(own: DataFrame, config: RunConfig) -> DataFrame:
    """The tests of points without cells. Equal points are counted once for all radii, and radii close to one another share a search; tiles are widened by its
    largest, and what a smaller one reaches from a tile's core is in them, too."""
    radii, spark = check_radii(config.r_check), own.sparkSession
    points = sinks.staged(own.groupBy("x", "y", "geneID").agg(F.count("*").alias("n")), sinks.shared_path(spark, "flat"))
    genes = sinks.staged(points.groupBy("geneID").agg(F.sum("n").alias("n")), sinks.shared_path(spark, "genes"))
    parts = []
    for shared in _together(radii):
        placed = tiles.marked(points, config.rect_length, shared[-1])
        kind = F.when(F.col("core"), neighbors.POINT + neighbors.CENTRE).otherwise(neighbors.POINT)
        sums = neighbors.sums_by_squares(placed.select("cell", "x", "y", "geneID", kind.alias("kind")), shared, genes)
        for k, r in enumerate(shared):
            counts = background.all_background(*neighbors.pairs_and_around_of(sums, k), own, counts=genes)
            parts.append(_tested(counts, config) if len(radii) == 1 else _tested(counts, config).withColumn("r_check", F.lit(r)))
    return reduce(DataFrame.unionByName, parts)


def _together(radii: tuple[float, ...]) -> list[tuple[float, ...]]:
    """Rising radii in groups, the largest of each at most SPREAD times its smallest."""
    out: list[tuple[float, ...]] = []
    for r in radii:
        if out and r <= neighbors.SPREAD * out[-1][0]:
            out[-1] += (r,)
        else:
            out.append((r,))
    return out


def _raw(own: DataFrame, near: DataFrame, config: RunConfig) -> DataFrame:
    return _tested(pair_background(own, near, config), config)


def raw_result(points: DataFrame, config: RunConfig) -> DataFrame:
    """Every tested directed pair. With several radii each row has its r_check, and one join at the largest serves all."""
    own = prepared(points, config)
    if config.unsegmented and config.detection_method == "radius":
        return _flat(own, config)
    if config.detection_method != "radius" or len(check_radii(config.r_check)) == 1:
        return _raw(own, near_of(own, config, config.reach), config)
    radii = check_radii(config.r_check)
    near = near_of(own, config, radii[-1])
    parts = [_raw(own, neighbors.within(near, r), config).withColumn("r_check", F.lit(r)) for r in radii]
    return reduce(DataFrame.unionByName, parts)


def final_result(raw: DataFrame, config: RunConfig) -> DataFrame:
    return results.significant(results.one_direction(raw, config.pair_keep), config.filter_threshold)


def shape_result(points: DataFrame, raw: DataFrame, config: RunConfig, stage=lambda table, name: table) -> DataFrame:
    """Shapes of the directed pairs that are significant enough. Distances are computed for these alone, once per pair; as
    the shapes read them many times, ``stage`` should write them."""
    wanted = raw.where(F.col("qvalue_BH") < config.shape_qvalue_threshold).select("gene_A", "gene_B")
    found = stage(distances.distances(prepared(points, config), config.r_dist, wanted), "distances")
    shape = stage(distances.shapes(found, config.around_count_threshold, config.shape_max_distance_count, keep=stage), "undirected-shape")
    return distances.relative(distances.directed(shape), config.r_dist).join(wanted, ["gene_A", "gene_B"], "left_semi")


def analysed(points: DataFrame, config: RunConfig, stage=None) -> dict[str, DataFrame]:
    """raw, final (with shape columns, if asked for) and shape of one radius. ``stage`` (table, name) -> table may write a
    result and read it back; without it shapes, which follow from raw, plan raw once more for each of its uses."""
    stage = stage or (lambda table, name: table)
    return results_of(points, stage(raw_result(points, config), "raw"), config, stage)


def results_of(points: DataFrame, raw: DataFrame, config: RunConfig, stage) -> dict[str, DataFrame]:
    """What follows from a raw result."""
    out = {"raw": raw, "final": final_result(raw, config)}
    if config.distribution_analysis:
        out["shape"] = stage(shape_result(points, raw, config, stage), "shape")
        out["final"] = distances.with_shapes(out["final"], out["shape"])
    out["final"] = results.ordered(out["final"])
    return out
