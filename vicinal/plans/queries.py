"""Registered queries over the driver tables and their SQL.

Points are derived from lineitem and part: quantity and price as coordinates, line number as z, part name as gene,
supplier as cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import cli
from ..config import RunConfig
from ..functions import stats
from ..operators import controls, distances, events, figures, neighbors, prep, results, tiles
from ..sources import sinks, transcripts
from ..sources.transcripts import missing_genes, pair_table
from . import analysis

R, R_MORE, GRID = 2.0, (1.0, 2.0, 5.0), 1
#: Without cells the points lie so close that a radius of 2 would reach nearly all of them.
R_FLAT = 0.05
FLAT_RADII = (0.02, 0.03, 0.05)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000.0).alias("y"), F.col("l_linenumber").cast("double").alias("z"),
        F.col("p_name").alias("geneID"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("cell"),
    )


def points_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points(), joined once and written with a cell's points together, for what reads them several times, as each search does."""
    return sinks.clustered(points(spark, sf_dir), "points", "cell", "z")


def flat_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points without cells and layers, joined once and written as they come."""
    return sinks.staged(points(spark, sf_dir).select("x", "y", F.lit(0.0).alias("z"), "geneID"), sinks.shared_path(spark, "flat-points"))


def pixels(spark: SparkSession, sf_dir: str, own=points) -> DataFrame:
    """The points on whole coordinates."""
    return own(spark, sf_dir).withColumn("x", F.floor("x").cast("double")).withColumn("y", F.floor("y").cast("double"))


def companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points, those of the seventh line each with a companion of another name beside it: pairs that no chance explains."""
    own = points_once(spark, sf_dir)
    return own.union(own.where("z = 7").select(F.col("x") + 0.5, "y", "z", F.concat(F.lit("with "), "geneID"), "cell"))


def _requested(spark: SparkSession) -> DataFrame:
    return pair_table(spark, PAIRS)


#: Requested pairs of the event and export queries; the last names a gene that no point has.
PAIRS = [("red gear", "blue rod"), ("hot rod", "cold widget"), ("blue rod", "red gear"), ("no such gene", "red gear")]
RULES = [("reds", "prefix", "red"), ("rods", "suffix", "rod"), ("one", "exact", "hot gear")]
THRESHOLDS = [0.05, 0.5, 1.01]


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("A").alias("gene_A"), F.col("B").alias("gene_B"), "k")


def gene_counts(spark, d):
    return prep.gene_counts(points(spark, d))


def gene_filter(spark, d):
    return prep.gene_counts(prep.frequent(points_once(spark, d), 900))


def slice_total(spark, d):
    return prep.slice_total(points(spark, d))


def slice_total_pixels(spark, d):
    return prep.slice_total(pixels(spark, d), pixels=True)


def pixel_distinct(spark, d):
    return prep.pixel_distinct(pixels(spark, d)).groupBy("geneID").agg(F.count("*").alias("n"), F.min("cell").alias("first_cell"))


def cell_gene_counts(spark, d):
    return prep.cell_gene_counts(points(spark, d))


def cell_totals(spark, d):
    return prep.cell_totals(pixels(spark, d), pixels=True)


def around_discrete(spark, d):
    return neighbors.around(neighbors.near_genes(points_once(spark, d), R)).select(F.col("A").alias("gene_A"), "n")


def pair_k_discrete(spark, d):
    return _named(neighbors.pair_counts(neighbors.near_genes(points_once(spark, d), R)))


def pair_k_continuous(spark, d):
    return _named(neighbors.pair_counts(neighbors.near_genes(points_once(spark, d), R, z_mode="continuous")))


def pair_k_ninegrid(spark, d):
    return _named(neighbors.pair_counts(neighbors.near_genes(pixels(spark, d, points_once), GRID, "grid"), "pixel"))


def around_ninegrid(spark, d):
    return neighbors.around(neighbors.near_genes(pixels(spark, d, points_once), GRID, "grid"), "pixel").select(F.col("A").alias("gene_A"), "n")


def pair_k_valuedistinct(spark, d):
    return _named(neighbors.pair_counts(neighbors.near_genes(pixels(spark, d, points_once), R), "value"))


def pair_k_rowidentity(spark, d):
    return _named(neighbors.pair_counts(neighbors.near_genes(pixels(spark, d, points_once), R), "row"))


def pair_bg_all(spark, d):
    return _background(points_once(spark, d))


def _background(own: DataFrame) -> DataFrame:
    return analysis.pair_background(own, neighbors.near_genes(own, R), RunConfig(r_check=R))


def pair_bg_cooccurrence(spark, d):
    own = points_once(spark, d)
    return analysis.pair_background(own, neighbors.near_genes(own, R), RunConfig(r_check=R, background="cooccurrence"))


def pair_bg_cooccurrence_ninegrid(spark, d):
    own = pixels(spark, d, points_once)
    config = RunConfig(detection_method="nine_grid", grid_check=GRID, background="cooccurrence")
    return analysis.pair_background(own, neighbors.near_genes(own, GRID, "grid"), config)


def _rounded(rows: DataFrame, places: int = 4) -> DataFrame:
    return rows.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def _logged(rows: DataFrame) -> DataFrame:
    """p and q as decimal logarithms to six places, so that the smallest count as much as the largest."""
    log = lambda c: F.when(F.col(c) > 0, F.round(F.log10(c), 6) + F.lit(0.0)).alias(c)
    return _rounded(rows.select(*[log(c) if c in ("pvalue", "qvalue_BH", "qvalue_BO") else F.col(c) for c in rows.columns]), 6)


ALL = RunConfig(r_check=R, filter_threshold=1.01)
TOGETHER = RunConfig(r_check=R, background="cooccurrence", filter_threshold=1.01)


def hyper_all(spark, d):
    """The flagship: every directed pair tested against the whole slice."""
    return _logged(analysis.raw_result(points_once(spark, d), ALL))


def hyper_cooccurrence(spark, d):
    return _logged(analysis.raw_result(points_once(spark, d), TOGETHER))


def hyper_unsegmented(spark, d):
    """Points without cells: tiles, value identity, the whole slice as background."""
    return _logged(analysis.raw_result(flat_once(spark, d), RunConfig(r_check=R_FLAT, unsegmented=True, rect_length=TILE)))


def pair_bg_cooccurrence_continuous(spark, d):
    own = points_once(spark, d)
    config = RunConfig(r_check=R, background="cooccurrence", z_mode="continuous")
    return analysis.pair_background(own, analysis.near_of(own, config, R), config)


def scan_csv(spark, d):
    """The points written as CSV under other names and scanned again, with the scan's checks."""
    path = sinks.shared_path(spark, "points") + ".csv"
    sinks.write_dataset(points(spark, d).select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), F.col("geneID").alias("target"), F.col("cell").alias("cell_id")), path)
    back = transcripts.read_points(spark, path, "px,py,pz,target,cell_id", finite=True)
    return _rounded(back.groupBy("geneID", "cell").agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"), F.sum("z").alias("sum_z")), 3)


def raw_round_trip(spark, d):
    """A raw result written as CSV and scanned again, with the scan's checks."""
    raw = _exact_results(spark, d)
    path = sinks.shared_path(spark, "raw") + ".csv"
    sinks.write_dataset(raw, path)
    return _rounded(transcripts.read_result(spark, path).select(raw.columns), 9)


def bh_bonferroni(spark, d):
    """The corrections alone, on p-values that both engines have exactly."""
    tests = prep.cell_gene_counts(points(spark, d)).select(F.col("cell").alias("gene_A"), F.col("geneID").alias("gene_B"), (1 / (1 + F.col("n"))).alias("pvalue"))
    return _rounded(stats.adjusted(tests), 9)


def _exact_results(spark, d, own=None):
    """Directed results whose q both engines have exactly, for what comes after the test. own: the points, if they are written already."""
    counts = _background(own or points_once(spark, d))
    q = F.col("gene_B_around") / (F.col("gene_B_around") + F.col("gene_A_N"))
    return results.with_ratios(counts.withColumns({"pvalue": q, "qvalue_BH": q, "qvalue_BO": q}))


def ratios(spark, d):
    return _rounded(_exact_results(spark, d), 9)


def dedup_first(spark, d):
    return _rounded(results.one_direction(_exact_results(spark, d), "first"), 9)


def dedup_last(spark, d):
    return _rounded(results.one_direction(_exact_results(spark, d), "last"), 9)


def bidirectional_retain(spark, d):
    return _rounded(results.both_directions(_exact_results(spark, d), 0.002), 9)


def significant_last(spark, d):
    return _rounded(results.significant(results.one_direction(_exact_results(spark, d), "last"), 0.003), 9)


def eligible_pairs(spark, d):
    return results.eligible(pair_bg_all(spark, d), 3, 1.2)


def final_all(spark, d):
    """The rows of the final result and their order, one direction of each pair, on q that both engines have exactly."""
    return _rounded(results.numbered(analysis.final_result(_exact_results(spark, d), RunConfig(r_check=R, filter_threshold=0.005))), 9)


def final_true_q(spark, d):
    """The final result on the tests' own q, with the production threshold and order, of points with companions."""
    config = RunConfig(r_check=R)
    raw = sinks.staged(analysis.raw_result(companions(spark, d), config), sinks.shared_path(spark, "raw"))
    return _logged(analysis.final_result(raw, config))


def final_shapes(spark, d):
    """The final result of a distribution run with its shape columns on exact q."""
    config = RunConfig(r_check=R, r_dist=5.0, distribution_analysis=True, filter_threshold=0.005, around_count_threshold=20, shape_qvalue_threshold=0.004)
    own = points_once(spark, d)
    raw = sinks.staged(_exact_results(spark, d, own), sinks.shared_path(spark, "raw"))
    out = analysis.results_of(own, raw, config, lambda table, name: sinks.staged(table, sinks.shared_path(spark, name)))
    return _rounded(out["final"], 6)


def final_rows(spark, d):
    """The final result: its rows, with the production threshold."""
    config = RunConfig(r_check=R)
    return _rounded(analysis.final_result(analysis.raw_result(points_once(spark, d), config), config), 9)


def cell_centers(spark, d):
    return _rounded(events.cell_centres(points(spark, d)), 6)


def cell_events_discrete(spark, d):
    return _rounded(events.cell_events(points_once(spark, d), _requested(spark), R), 6)


def cell_events_continuous(spark, d):
    return _rounded(events.cell_events(points_once(spark, d), _requested(spark), R, "continuous"), 6)


def missing_requested(spark, d):
    return missing_genes(points(spark, d), _requested(spark))


def _found(spark, d, pairs=None, own=None):
    return distances.distances(own or points_once(spark, d), 5.0, pairs)


def _found_once(spark, d, own=None):
    """All distances, written, for what reads them several times."""
    return sinks.staged(_found(spark, d, own=own), sinks.shared_path(spark, "distances"))


def distances_pair(spark, d):
    pairs = _requested(spark)
    return _rounded(_found(spark, d, pairs.select(F.col("gene_1").alias("gene_A"), F.col("gene_2").alias("gene_B"))), 6)


def distance_summary(spark, d):
    pairs = _requested(spark)
    return distances.summary(_found(spark, d), pairs, 2, 40)


def distance_export(spark, d):
    """Sampled places can't be had in SQL; tests hold them against the generator itself."""
    return _rounded(distances.export(_found(spark, d), _requested(spark), 2, 40, 7)[0], 6)


def shape_stats(spark, d):
    return _rounded(distances.shapes(_found_once(spark, d), 20, None, mode=False), 6)


def shape_relative(spark, d):
    return _rounded(distances.relative(distances.shapes(_found_once(spark, d), 20, None, mode=False), 5.0), 6)


def shape_join(spark, d):
    own = points_once(spark, d)
    shape = distances.directed(distances.shapes(_found_once(spark, d, own), 60, None, mode=False))
    return _rounded(distances.with_shapes(_exact_results(spark, d, own).select("gene_A", "gene_B", "gene_B_around"), shape), 6)


def kde_mode(spark, d):
    """Modes over all distances of a pair."""
    return _rounded(distances.modes(distances.sampled(_found_once(spark, d), None).where(F.col("count") >= 20)), 6)


def control_baseline(spark, d):
    return _rounded(controls.control_baseline(_exact_results(spark, d).withColumn("qvalue_BH", F.col("qvalue_BH") * 100), RULES, THRESHOLDS), 6)


def multi_radius(spark, d):
    own = points_once(spark, d)
    near = neighbors.near_genes(own, max(R_MORE))
    parts = [_named(neighbors.pair_counts(neighbors.within(near, r))).withColumn("r_check", F.lit(r)) for r in R_MORE]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


TILE = 10.0


def unsegmented_radius(spark, d):
    wide, core = tiles.tiled(pixels(spark, d, points_once), TILE, R)
    return _named(neighbors.pair_counts(neighbors.near_genes(wide, R, centres=core), "value"))


def unsegmented_grid(spark, d):
    wide, core = tiles.tiled(prep.pixel_distinct(pixels(spark, d, points_once).withColumn("z", F.lit(0.0))), TILE, GRID)
    return neighbors.around(neighbors.near_genes(wide, GRID, "grid", centres=core), "pixel").select(F.col("A").alias("gene_A"), "n")


def random_reference(spark, d):
    """Of all distances the share that comes before each of a hundred radii, beside density and share of random points in a disk."""
    found = _found(spark, d).groupBy(F.least(F.floor(F.col("distance") * 20), F.lit(99)).alias("step")).agg(F.count("*").alias("n"))
    at = spark.range(100).select(F.col("id").alias("step"), ((F.col("id") + 1) / 20.0).alias("distance"))
    counts = at.join(found, "step", "left").withColumn("n", F.coalesce("n", F.lit(0)))  # a hundred rows
    up_to = F.sum("n").over(Window.orderBy("step")) / F.sum("n").over(Window.partitionBy())
    density, share = stats.random_density(F.col("distance"), 5.0), stats.random_share(F.col("distance"), 5.0)
    return _rounded(counts.select("distance", density.alias("density"), share.alias("share"), up_to.alias("observed_share")), 9)


def tissue_map(spark, d):
    return _rounded(figures.tissue_map(events.cell_events(points_once(spark, d), _requested(spark), R), flip_x=True), 6)


def _paired(found: DataFrame) -> DataFrame:
    return found.select(F.concat_ws("_", "gene_A", "gene_B").alias("pair"), "distance")


def distance_curves(spark, d):
    """Curves of every pair on a coarse grid."""
    return _rounded(figures.distance_curves(_paired(_found_once(spark, d)), 5.0, 60), 6)


def distance_curves_all(spark, d):
    """Curves of every pair on the default grid."""
    return _rounded(figures.distance_curves(_paired(_found_once(spark, d)), 5.0), 6)


def scan_flat(spark, d):
    """The points written with three columns and scanned without cells: z is 0 for all."""
    path = sinks.shared_path(spark, "flat") + ".csv"
    sinks.write_dataset(points(spark, d).select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("geneID").alias("target")), path)
    back = transcripts.read_points(spark, path, "px,py,target", unsegmented=True, finite=True)
    return _rounded(back.groupBy("geneID", "z").agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y")), 3)


def scan_pairs(spark, d):
    """A request of every part's name with the next one's, written as a file and scanned: canonical, each once, in order."""
    parts = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name")
    later = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("gene_2"))
    both = parts.withColumnRenamed("p_name", "gene_1").join(later, "p_partkey").where("gene_1 <> gene_2")
    path = sinks.shared_path(spark, "pairs") + ".csv"
    sinks.write_single(both.orderBy("p_partkey").select("gene_1", "gene_2"), path)
    return transcripts.read_pair_table(spark, path)


def distances_retained(spark, d):
    """Distances kept as a run keeps them, found again under their background, and exported for the requested pairs."""
    folder = sinks.shared_path(spark, "retained")
    sinks.retain_distances(_found(spark, d), f"{folder}/all")
    path = sinks.shared_path(spark, "export") + ".csv"
    asked = [x for pair in PAIRS for x in ("--pair", *pair)]
    args = cli.parser().parse_args(["distances", "--distances_dir", folder, "--data_path", "unused", "--save_path", path, *asked])
    args.call(args, spark)
    return _rounded(spark.read.csv(path, header=True, schema="gene_1 string, gene_2 string, pair string, distance double"), 6)


def distances_summary_file(spark, d):
    """The summary beside an export from points, in the order of the request."""
    data, path = sinks.shared_path(spark, "points") + ".parquet", sinks.shared_path(spark, "export") + ".csv.gz"
    points(spark, d).write.parquet(data)
    asked = [x for pair in PAIRS for x in ("--pair", *pair)]
    args = cli.parser().parse_args(["distances", "--data_path", data, "--r_dist", "5", "--min_distance_count", "2", "--max_distance_count", "40", "--save_path", path, *asked])
    args.call(args, spark)
    report = spark.read.csv(sinks.summary_path(path), header=True, schema="gene_1 string, gene_2 string, pair string, total_distance_count long, output_distance_count long, status string")
    written = spark.read.csv(path, header=True, schema="gene_1 string, gene_2 string, pair string, distance double").groupBy("pair").agg(F.count("*").alias("rows_written"))
    return report.join(written, "pair", "left").withColumn("rows_written", F.coalesce("rows_written", F.lit(0)))


def run_files(spark, d):
    """The files of a run from the command line: the raw result and the final one, read back."""
    data, path = sinks.shared_path(spark, "points") + ".parquet", sinks.shared_path(spark, "run") + ".csv"
    companions(spark, d).write.parquet(data)
    args = cli.parser().parse_args(["run", "--detection_method", "radius", "--background", "all", "--mode", "robust", "--r_check", str(R), "--data_path", data, "--save_path", path])
    raw, final = args.call(args, spark)
    read = lambda place, name: transcripts.check_points(spark.read.csv(place, header=True, schema=", ".join(f"{c} {t}" for c, t in transcripts.RESULT))).withColumn("file", F.lit(name))
    return _logged(read(raw, "raw").unionByName(read(final, "final")))


def events_file(spark, d):
    """The file of the events command, with its places: cells in order, pairs as requested."""
    data, path = sinks.shared_path(spark, "points") + ".parquet", sinks.shared_path(spark, "events") + ".csv"
    points(spark, d).write.parquet(data)
    asked = [x for pair in PAIRS[:3] for x in ("--pair", *pair)]
    args = cli.parser().parse_args(["events", "--data_path", data, "--r_check", str(R), "--save_path", path, *asked])
    args.call(args, spark)
    schema = "cell string, cell_x double, cell_y double, gene_A string, gene_B string, r_check double, gene_A_count long, gene_B_count long, colocalization_count long"
    rows = spark.read.csv(path, header=True, schema=schema).withColumn("_id", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy("cell").orderBy("_id")) - 1  # a row for each requested pair
    return _rounded(rows.withColumn("place", place.cast("long")).drop("_id"), 6)


def shape_sampled(spark, d):
    """Shapes of samples: of pairs with more than 30 distances, 30 by the hash of rank and names."""
    return _rounded(distances.shapes(_found_once(spark, d), 20, 30, mode=False), 6)


def sql_functions(spark, d):
    """The registered functions from SQL text: tails of every pair, modes, and the random reference at them."""
    stats.register(spark)
    own = points_once(spark, d)
    _background(own).createOrReplaceTempView("vicinal_counts")
    _found_once(spark, d, own).createOrReplaceTempView("vicinal_distances")
    return spark.sql("""
WITH e AS (SELECT gene_A, gene_B FROM vicinal_distances GROUP BY gene_A, gene_B HAVING count(*) >= 20),
m AS (SELECT gene_A, gene_B, kde_mode(distance) AS mode FROM vicinal_distances LEFT SEMI JOIN e USING (gene_A, gene_B) GROUP BY gene_A, gene_B)
SELECT c.gene_A, c.gene_B, round(log10(hypergeom_sf(gene_B_around, gene_slice, gene_B_slice, gene_around)), 6) + 0.0D AS log_p,
  round(mode, 6) AS mode, round(random_density(mode, 5.0D), 6) AS density, round(random_share(mode, 5.0D), 6) AS share
FROM vicinal_counts c LEFT JOIN m ON m.gene_A = c.gene_A AND m.gene_B = c.gene_B""")


def control_contains(spark, d):
    """Rules that hold a text, whatever its case."""
    raw = _exact_results(spark, d).withColumn("qvalue_BH", F.col("qvalue_BH") * 100)
    return _rounded(controls.control_baseline(raw, [("ears", "contains", "EAR"), ("reds", "prefix", "RED")], THRESHOLDS, "first", ignore_case=True), 6)


def multi_radius_unsegmented(spark, d):
    """Three radii without cells from one search at the largest."""
    config = RunConfig(r_check=FLAT_RADII, unsegmented=True, rect_length=TILE)
    return analysis.raw_result(flat_once(spark, d), config).select("gene_A", "gene_B", "gene_B_around", "gene_around", "r_check")


def queries() -> dict:
    named = [
        gene_counts, gene_filter, slice_total, slice_total_pixels, pixel_distinct, cell_gene_counts, cell_totals, around_discrete, around_ninegrid,
        pair_k_discrete, pair_k_continuous, pair_k_ninegrid, pair_k_valuedistinct, pair_k_rowidentity, pair_bg_all, pair_bg_cooccurrence,
        pair_bg_cooccurrence_ninegrid, pair_bg_cooccurrence_continuous, hyper_all, hyper_cooccurrence, hyper_unsegmented, scan_csv, raw_round_trip, bh_bonferroni, ratios, dedup_first, dedup_last, bidirectional_retain,
        significant_last, eligible_pairs, final_all, final_shapes, final_rows, final_true_q, cell_centers, cell_events_discrete, cell_events_continuous, missing_requested, distances_pair,
        distance_summary, distance_export, shape_stats, shape_relative, shape_join, kde_mode, control_baseline, multi_radius, unsegmented_radius,
        unsegmented_grid, random_reference, tissue_map, distance_curves, distance_curves_all, scan_flat, scan_pairs, distances_retained, distances_summary_file,
        run_files, events_file, shape_sampled, sql_functions, control_contains, multi_radius_unsegmented,
    ]
    return {f.__name__: f for f in named}


# --- SQL -------------------------------------------------------------------------------------------------------------

_PTS = """pts AS (SELECT l_quantity AS x, l_extendedprice / 1000.0 AS y, CAST(l_linenumber AS DOUBLE) AS z, p_name AS g,
  'S' || l_suppkey AS c FROM lineitem JOIN part ON l_partkey = p_partkey),
pix AS (SELECT floor(x) AS x, floor(y) AS y, z, g, c FROM pts)"""
_D2 = "(p.x - a.x) * (p.x - a.x) + (p.y - a.y) * (p.y - a.y)"


def _near(source: str, reach: float, metric: str = "radius", continuous: bool = False) -> str:
    """near(c, x, y, z, g, m, ag): each distinct point with each gene in reach."""
    near = f"abs(p.x - a.x) <= {reach} AND abs(p.y - a.y) <= {reach}" if metric == "grid" else f"{_D2}{' + (p.z - a.z) * (p.z - a.z)' if continuous else ''} <= {reach * reach}"
    layer = "" if continuous else "AND p.z = a.z "
    return f"""u AS (SELECT c, x, y, z, g, count(*) AS m FROM {source} GROUP BY ALL),
near AS (SELECT DISTINCT p.c, p.x, p.y, p.z, p.g, p.m, a.g AS ag FROM u p JOIN u a ON p.c = a.c {layer}AND {near})"""


def _k(weight: str) -> str:
    return f"SELECT ag AS gene_A, g AS gene_B, CAST(sum({weight}) AS BIGINT) AS k FROM near WHERE ag <> g GROUP BY ALL"


_COUNTS = "gene_A, gene_B, gene_B_around, gene_B_slice, gene_around, gene_slice, gene_A_N, gene_B_N"
_BG_ALL = f"""{_PTS}, {_near("pts", R)}, kk AS ({_k("m")}), nn AS (SELECT ag, CAST(sum(m) AS BIGINT) AS n FROM near GROUP BY ag),
gc AS (SELECT g, count(*) AS n FROM pts GROUP BY g),
bg AS (SELECT kk.gene_A, kk.gene_B, k AS gene_B_around, gb.n AS gene_B_slice, nn.n AS gene_around,
  (SELECT count(*) FROM pts) AS gene_slice, ga.n AS gene_A_N, gb.n AS gene_B_N
  FROM kk JOIN nn ON nn.ag = gene_A JOIN gc ga ON ga.g = gene_A JOIN gc gb ON gb.g = gene_B)"""


_BG_WITH = _BG_ALL.replace("pts AS (", "base AS (", 1).replace("pix AS (", "every AS (SELECT * FROM base UNION ALL SELECT x + 0.5, y, z, 'with ' || g, c FROM base WHERE z = 7),\npts AS (SELECT * FROM every WHERE g IN (SELECT g FROM every GROUP BY g HAVING count(*) >= 5)),\npix AS (", 1)


def _bg_together(source: str, reach: float, metric: str, weight: str, continuous: bool = False) -> str:
    genes = f"SELECT DISTINCT c, g, x, y, z FROM {source}" if metric == "grid" else f"SELECT * FROM {source}"
    n = "count(DISTINCT (x, y, z))" if metric == "grid" else f"sum({weight})"
    total = "count(DISTINCT (x, y, z))" if metric == "grid" else "count(*)"
    return f"""{_PTS}, {_near(source, reach, metric, continuous)}, kk AS ({_k(weight)}), nn AS (SELECT c, ag, {n} AS n FROM near GROUP BY ALL),
cg AS (SELECT c, g, count(*) AS n FROM ({genes}) GROUP BY ALL), ct AS (SELECT c, {total} AS n FROM {source} GROUP BY c),
sums AS (SELECT a.g AS ag, b.g AS bg, sum(nn.n) AS n, sum(b.n) AS nb, sum(ct.n) AS total, sum(a.n) AS na
  FROM cg a JOIN cg b ON a.c = b.c AND a.g <> b.g JOIN nn ON nn.c = a.c AND nn.ag = a.g JOIN ct ON ct.c = a.c GROUP BY ALL),
bg AS (SELECT gene_A, gene_B, k AS gene_B_around, CAST(nb AS BIGINT) AS gene_B_slice, CAST(n AS BIGINT) AS gene_around,
  CAST(total AS BIGINT) AS gene_slice, CAST(na AS BIGINT) AS gene_A_N, CAST(nb AS BIGINT) AS gene_B_N
  FROM kk JOIN sums ON ag = gene_A AND bg = gene_B)"""


_BG_COOC = _bg_together("pts", R, "radius", "1")
_BG_COOC_GRID = _bg_together("pix", float(GRID), "grid", "1")
_ADJUST = """ranked AS (SELECT *, count(*) OVER (PARTITION BY gene_A) AS cnt, row_number() OVER (PARTITION BY gene_A ORDER BY pvalue, gene_B) AS rk FROM tests),
adj AS (SELECT * EXCLUDE (cnt, rk), least(1.0, min(pvalue / (CAST(rk AS DOUBLE) / cnt)) OVER (PARTITION BY gene_A ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS qvalue_BH,
  least(1.0, pvalue * cnt) AS qvalue_BO FROM ranked)"""
_LOGC = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - ({1}) + 1))"
_RATIOS = """least(gene_A, gene_B) || '_' || greatest(gene_A, gene_B) AS pair,
  (CAST(gene_B_around AS DOUBLE) / gene_around) / (CAST(gene_B_slice AS DOUBLE) / gene_slice) AS enrichment_ratio,
  CAST(gene_B_around AS DOUBLE) / least(gene_A_N, gene_B_N) AS support_ratio"""


_LOGS = ", ".join(f"CASE WHEN {c} > 0 THEN round(log10({c}), 6) + 0.0 END AS {c}" for c in ("pvalue", "qvalue_BH", "qvalue_BO"))


def _tested(bg: str) -> str:
    """res: every pair tested, unrounded."""
    term = f"exp({_LOGC.format('gene_B_slice', 'j')} + {_LOGC.format('(gene_slice - gene_B_slice)', '(gene_around - j)')} - {_LOGC.format('gene_slice', 'gene_around')})"
    # The shorter of the two tails is summed.
    return f"""{bg}, ok AS (SELECT * FROM bg WHERE gene_A_N <= 100 * gene_B_N AND gene_B_N <= 100 * gene_A_N),
tests AS (SELECT *, CASE WHEN gene_B_around > least(gene_B_slice, gene_around) THEN 0.0
  WHEN CAST(gene_B_around AS DOUBLE) * gene_slice > CAST(gene_around AS DOUBLE) * gene_B_slice
  THEN least(1.0, list_sum([{term} FOR j IN range(gene_B_around, least(gene_B_slice, gene_around) + 1)]))
  ELSE 1.0 - coalesce(list_sum([{term} FOR j IN range(greatest(0, gene_around + gene_B_slice - gene_slice), gene_B_around)]), 0.0) END AS pvalue FROM ok),
{_ADJUST}, res AS (SELECT *, {_RATIOS} FROM adj)"""


_TESTED = f"""gene_A, gene_B, {_LOGS}, gene_B_around, gene_B_slice,
  gene_around, gene_slice, gene_A_N, gene_B_N, pair, round(enrichment_ratio, 6) AS enrichment_ratio, round(support_ratio, 6) AS support_ratio"""


_TESTED_PLAIN = ", ".join(f"round({c}, 9) AS {c}" if c in ("pvalue", "qvalue_BH", "qvalue_BO", "enrichment_ratio", "support_ratio") else c for c in results.ORDER)


def _hyper(bg: str) -> str:
    return f"WITH {_tested(bg)} SELECT {_TESTED} FROM res"


_EXACT = f"""{_BG_ALL}, res AS (SELECT *, q AS pvalue, q AS qvalue_BH, q AS qvalue_BO, {_RATIOS}
  FROM (SELECT *, CAST(gene_B_around AS DOUBLE) / (gene_B_around + gene_A_N) AS q FROM bg))"""
_RES = """gene_A, gene_B, round(pvalue, 9) AS pvalue, round(qvalue_BH, 9) AS qvalue_BH, round(qvalue_BO, 9) AS qvalue_BO, gene_B_around, gene_B_slice,
  gene_around, gene_slice, gene_A_N, gene_B_N, pair, round(enrichment_ratio, 9) AS enrichment_ratio, round(support_ratio, 9) AS support_ratio"""


def _dedup(keep: str) -> str:
    up, down = ("ASC", "DESC") if keep == "first" else ("DESC", "ASC")
    return f"""one AS (SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY least(gene_A, gene_B), greatest(gene_A, gene_B)
  ORDER BY qvalue_BH {up}, enrichment_ratio {down}, gene_A {up}, gene_B {up}) = 1)"""


_WANTED = "want(ordinal, gene_1, gene_2) AS (VALUES (0, 'blue rod', 'red gear'), (1, 'cold widget', 'hot rod'), (2, 'no such gene', 'red gear'))"


def _events(continuous: bool) -> str:
    near = f"{_D2}{' + (p.z - a.z) * (p.z - a.z)' if continuous else ''} <= {R * R}{'' if continuous else ' AND p.z = a.z'}"
    return f"""WITH {_PTS}, {_WANTED}, ctr AS (SELECT c, median(x) AS cx, median(y) AS cy FROM pts GROUP BY c),
n AS (SELECT c, g, count(*) AS n FROM pts GROUP BY ALL),
e AS (SELECT a.c, gene_1, gene_2, count(*) AS n FROM want JOIN pts a ON a.g = gene_1 JOIN pts p ON p.g = gene_2 AND p.c = a.c AND {near} GROUP BY ALL)
SELECT ctr.c AS cell, round(cx, 6) AS cell_x, round(cy, 6) AS cell_y, w.gene_1 AS gene_A, w.gene_2 AS gene_B, CAST({R} AS DOUBLE) AS r_check,
  coalesce(n1.n, 0) AS gene_A_count, coalesce(n2.n, 0) AS gene_B_count, coalesce(e.n, 0) AS colocalization_count
FROM ctr CROSS JOIN want w LEFT JOIN n n1 ON n1.c = ctr.c AND n1.g = w.gene_1 LEFT JOIN n n2 ON n2.c = ctr.c AND n2.g = w.gene_2
LEFT JOIN e ON e.c = ctr.c AND e.gene_1 = w.gene_1 AND e.gene_2 = w.gene_2"""


_DIST = f"""{_PTS}, dist AS (SELECT a.g AS gene_A, p.g AS gene_B, sqrt({_D2}) AS d FROM pts a JOIN pts p ON a.c = p.c AND a.z = p.z AND a.g < p.g AND {_D2} <= 25.0)"""
#: Of each group of own (pair, d) with n and s: lo, hi and the density of its KDE at 1000 points from lo to hi, up to a factor.
_MODES = """ends AS (SELECT gene_A, gene_B, min(d) AS lo, max(d) AS hi, stddev_samp(d) AS s FROM dist GROUP BY ALL HAVING count(*) >= 20),
kde AS (SELECT gene_A, gene_B, i, lo + i * ((hi - lo) / 999) AS spot, sum(exp(-0.5 * pow((lo + i * ((hi - lo) / 999) - d) / (0.05 * s), 2))) AS y
  FROM dist JOIN ends USING (gene_A, gene_B), range(1000) t(i) GROUP BY ALL),
modes AS (SELECT gene_A, gene_B, spot AS mode FROM kde QUALIFY row_number() OVER (PARTITION BY gene_A, gene_B ORDER BY y DESC, i) = 1)"""
_SHAPE = f"""{_DIST}, mom AS (SELECT gene_A, gene_B, count(*) AS n, avg(d) AS mu, quantile_cont(d, 0.25) AS q25, quantile_cont(d, 0.5) AS med, quantile_cont(d, 0.75) AS q75 FROM dist GROUP BY ALL),
cen AS (SELECT gene_A, gene_B, avg(pow(d - mu, 2)) AS m2, avg(pow(d - mu, 3)) AS m3, avg(pow(d - mu, 4)) AS m4 FROM dist JOIN mom USING (gene_A, gene_B) GROUP BY ALL),
shape AS (SELECT gene_A, gene_B, n AS shape_count, m3 / pow(m2, 1.5) AS skewness, m4 / (m2 * m2) - 3 AS kurtosis, med AS median, q25, q75, q75 - q25 AS iqr
  FROM mom JOIN cen USING (gene_A, gene_B))"""
_SHAPE_COLS = "shape_count, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis, round(median, 6) AS median, round(q25, 6) AS q25, round(q75, 6) AS q75, round(iqr, 6) AS iqr"


def _controls(tests: dict[str, str], keep: str = "last") -> str:
    tests = dict(tests)
    tests["any_control"] = "(" + " OR ".join(tests.values()) + ")"
    parts = []
    for t in THRESHOLDS:
        for name, test in tests.items():
            both = f"({test.replace('g ', 'gene_A ')} OR {test.replace('g ', 'gene_B ')})"
            parts.append(f"""SELECT CAST({t} AS DOUBLE) AS qvalue_threshold, count(*) FILTER (100 * qvalue_BH < {t}) AS total_significant_pairs, '{name}' AS control_group,
  count(*) FILTER (100 * qvalue_BH < {t} AND {both}) AS control_associated_pair_count, (SELECT count(*) FROM f WHERE {test}) AS matched_control_feature_count FROM one""")
    share = "control_associated_pair_count / CAST(nullif(total_significant_pairs, 0) AS DOUBLE)"
    return f"""WITH {_EXACT}, {_dedup(keep)}, f AS (SELECT gene_A AS g FROM res UNION SELECT gene_B FROM res), s AS ({" UNION ALL ".join(parts)})
SELECT qvalue_threshold, total_significant_pairs, control_group, control_associated_pair_count, round({share}, 6) AS control_associated_pair_fraction,
  round({share} * 100, 6) AS control_associated_percentage, matched_control_feature_count FROM s"""


def _tiled(source: str, reach: float, metric: str) -> str:
    near = f"abs(p.x - a.x) <= {reach} AND abs(p.y - a.y) <= {reach}" if metric == "grid" else f"{_D2} <= {reach * reach}"
    return f"""{_PTS}, s AS (SELECT DISTINCT x, y, g FROM {source}), box AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM s),
tx AS (SELECT i, x0 + i * {TILE} AS lo, least(x0 + i * {TILE} + {TILE}, x1) AS hi FROM box, range(1000) t(i) WHERE i < ceil((x1 - x0) / {TILE})),
ty AS (SELECT i, y0 + i * {TILE} AS lo, least(y0 + i * {TILE} + {TILE}, y1) AS hi FROM box, range(1000) t(i) WHERE i < ceil((y1 - y0) / {TILE})),
core AS (SELECT s.*, tx.i AS i, ty.i AS j FROM s JOIN tx ON x BETWEEN tx.lo AND tx.hi JOIN ty ON y BETWEEN ty.lo AND ty.hi),
wide AS (SELECT s.*, tx.i AS i, ty.i AS j FROM s JOIN tx ON x BETWEEN tx.lo - {reach} AND tx.hi + {reach} JOIN ty ON y BETWEEN ty.lo - {reach} AND ty.hi + {reach}),
near AS (SELECT DISTINCT p.i, p.j, p.x, p.y, p.g, a.g AS ag FROM wide p JOIN core a ON p.i = a.i AND p.j = a.j AND {near})"""


def _bg_flat(reach: float = R_FLAT) -> str:
    return f"""{_tiled("pts", reach, "radius")}, kk AS ({_k("1")}), nn AS (SELECT ag, count(*) AS n FROM near GROUP BY ag), gc AS (SELECT g, count(*) AS n FROM pts GROUP BY g),
bg AS (SELECT kk.gene_A, kk.gene_B, k AS gene_B_around, gb.n AS gene_B_slice, nn.n AS gene_around, (SELECT count(*) FROM pts) AS gene_slice, ga.n AS gene_A_N, gb.n AS gene_B_N
  FROM kk JOIN nn ON nn.ag = gene_A JOIN gc ga ON ga.g = gene_A JOIN gc gb ON gb.g = gene_B)"""


def _curves(points: int) -> str:
    return f"""WITH {_DIST}, own AS (SELECT gene_A || '_' || gene_B AS pair, d FROM dist),
f AS (SELECT pair, count(*) AS n, stddev_samp(d) * pow(count(*), -0.2) AS w FROM own GROUP BY pair HAVING count(*) > 1 AND stddev_samp(d) > 0),
g AS (SELECT i, i * (5.0::DOUBLE / {points - 1}) AS spot FROM range({points}) t(i)),
k AS (SELECT pair, i, spot, sum(exp(-0.5 * pow((spot - d) / w, 2)) / (n * w * sqrt(2 * pi()))) AS y FROM own JOIN f USING (pair) CROSS JOIN g GROUP BY ALL),
a AS (SELECT *, (y + lead(y) OVER (PARTITION BY pair ORDER BY i)) / 2 * (5.0::DOUBLE / {points - 1}) AS part FROM k)
SELECT pair, round(spot, 6) AS distance, round(y / sum(part) OVER (PARTITION BY pair), 6) AS density FROM a
UNION ALL SELECT 'Random expectation', round(spot, 6), round(2 * spot / 25.0::DOUBLE, 6) FROM g"""


def oracle_sql() -> dict[str, str]:
    pts = f"WITH {_PTS} "
    return {
        "pair_bg_cooccurrence_continuous": f"WITH {_bg_together('pts', R, 'radius', '1', True)} SELECT {_COUNTS} FROM bg",
        "hyper_unsegmented": _hyper(_bg_flat()),
        "scan_csv": pts + 'SELECT g AS "geneID", c AS cell, count(*) AS n, round(sum(x), 3) AS sum_x, round(sum(y), 3) AS sum_y, round(sum(z), 3) AS sum_z FROM pts GROUP BY ALL',
        "raw_round_trip": f"WITH {_EXACT} SELECT {_RES} FROM res",
        "final_all": f"WITH {_EXACT}, {_dedup('last')} SELECT {_RES}, row_number() OVER (ORDER BY qvalue_BH, enrichment_ratio DESC, gene_A, gene_B) - 1 AS place FROM one WHERE qvalue_BH < 0.005",
        "final_rows": f"WITH {_tested(_BG_ALL)}, {_dedup('last')} SELECT {_TESTED_PLAIN} FROM one WHERE qvalue_BH < 1e-5",
        "final_true_q": f"WITH {_tested(_BG_WITH)}, {_dedup('last')} SELECT {_TESTED} FROM one WHERE qvalue_BH < 1e-5",
        "kde_mode": f"WITH {_DIST}, {_MODES} SELECT gene_A, gene_B, round(mode, 6) AS mode FROM modes",
        "final_shapes": f"""WITH {_EXACT}, {_dedup('last')}, {_SHAPE.removeprefix(_PTS + ", ")}, {_MODES}, with_mode AS (SELECT * FROM shape JOIN modes USING (gene_A, gene_B)),
both_ways AS (SELECT * FROM with_mode UNION ALL SELECT gene_B AS gene_A, gene_A AS gene_B, * EXCLUDE (gene_A, gene_B) FROM with_mode),
mine AS (SELECT gene_A, gene_B, both_ways.* EXCLUDE (gene_A, gene_B) FROM both_ways JOIN res USING (gene_A, gene_B) WHERE shape_count >= 20 AND qvalue_BH < 0.004)
SELECT {_RES.replace(", 9)", ", 6)")}, {_SHAPE_COLS}, round(mode, 6) AS mode, round(1 / (1 + exp(skewness)), 6) AS skewness_adjusted, round(skewness + 0.566, 6) AS skewness_relative, round(kurtosis + 0.6, 6) AS kurtosis_relative,
  round(median - 0.707 * 5.0, 6) AS median_relative, round(q25 - 0.5 * 5.0, 6) AS q25_relative, round(q75 - 0.866 * 5.0, 6) AS q75_relative
FROM one LEFT JOIN mine USING (gene_A, gene_B) WHERE qvalue_BH < 0.005""",
        "gene_counts": pts + 'SELECT g AS "geneID", count(*) AS n FROM pts GROUP BY g',
        "gene_filter": pts + 'SELECT g AS "geneID", count(*) AS n FROM pts GROUP BY g HAVING count(*) >= 900',
        "slice_total": pts + "SELECT count(*) AS total FROM pts",
        "slice_total_pixels": pts + "SELECT count(*) AS total FROM (SELECT DISTINCT x, y, z FROM pix)",
        "pixel_distinct": pts + 'SELECT g AS "geneID", count(*) AS n, min(c) AS first_cell FROM (SELECT g, x, y, z, min(c) AS c FROM pix GROUP BY ALL) GROUP BY g',
        "cell_gene_counts": pts + 'SELECT c AS cell, g AS "geneID", count(*) AS n FROM pts GROUP BY ALL',
        "cell_totals": pts + "SELECT c AS cell, count(*) AS total FROM (SELECT DISTINCT c, x, y, z FROM pix) GROUP BY c",
        "around_discrete": f"WITH {_PTS}, {_near('pts', R)} SELECT ag AS gene_A, CAST(sum(m) AS BIGINT) AS n FROM near GROUP BY ag",
        "around_ninegrid": f"WITH {_PTS}, {_near('pix', GRID, 'grid')} SELECT ag AS gene_A, count(*) AS n FROM (SELECT DISTINCT ag, c, x, y, z FROM near) GROUP BY ag",
        "pair_k_discrete": f"WITH {_PTS}, {_near('pts', R)} {_k('m')}",
        "pair_k_continuous": f"WITH {_PTS}, {_near('pts', R, continuous=True)} {_k('m')}",
        "pair_k_ninegrid": f"WITH {_PTS}, {_near('pix', GRID, 'grid')} {_k('1')}",
        "pair_k_valuedistinct": f"WITH {_PTS}, {_near('pix', R)} {_k('1')}",
        "pair_k_rowidentity": f"WITH {_PTS}, {_near('pix', R)} {_k('m')}",
        "pair_bg_all": f"WITH {_BG_ALL} SELECT {_COUNTS} FROM bg",
        "pair_bg_cooccurrence": f"WITH {_BG_COOC} SELECT {_COUNTS} FROM bg",
        "pair_bg_cooccurrence_ninegrid": f"WITH {_BG_COOC_GRID} SELECT {_COUNTS} FROM bg",
        "hyper_all": _hyper(_BG_ALL),
        "hyper_cooccurrence": _hyper(_BG_COOC),
        "bh_bonferroni": f"WITH {_PTS}, tests AS (SELECT c AS gene_A, g AS gene_B, 1.0::DOUBLE / (1 + count(*)) AS pvalue FROM pts GROUP BY ALL), {_ADJUST} SELECT gene_A, gene_B, round(pvalue, 9) AS pvalue, round(qvalue_BH, 9) AS qvalue_BH, round(qvalue_BO, 9) AS qvalue_BO FROM adj",
        "ratios": f"WITH {_EXACT} SELECT {_RES} FROM res",
        "dedup_first": f"WITH {_EXACT}, {_dedup('first')} SELECT {_RES} FROM one",
        "dedup_last": f"WITH {_EXACT}, {_dedup('last')} SELECT {_RES} FROM one",
        "bidirectional_retain": f"WITH {_EXACT} SELECT {_RES} FROM res WHERE pair IN (SELECT pair FROM res WHERE qvalue_BH < 0.002)",
        "significant_last": f"WITH {_EXACT}, {_dedup('last')} SELECT {_RES} FROM one WHERE qvalue_BH < 0.003",
        "eligible_pairs": f"WITH {_BG_ALL} SELECT {_COUNTS} FROM bg WHERE gene_B_around >= 3 AND gene_A_N / CAST(gene_B_N AS DOUBLE) <= 1.2 AND gene_B_N / CAST(gene_A_N AS DOUBLE) <= 1.2",
        "cell_centers": pts + "SELECT c AS cell, round(median(x), 6) AS cell_x, round(median(y), 6) AS cell_y FROM pts GROUP BY c",
        "cell_events_discrete": _events(False),
        "cell_events_continuous": _events(True),
        "missing_requested": f"WITH {_PTS}, {_WANTED} SELECT DISTINCT g AS \"geneID\" FROM (SELECT gene_1 AS g FROM want UNION SELECT gene_2 FROM want) WHERE g NOT IN (SELECT g FROM pts)",
        "distances_pair": f"WITH {_DIST}, {_WANTED} SELECT gene_A, gene_B, round(d, 6) AS distance FROM dist JOIN want ON gene_A = gene_1 AND gene_B = gene_2",
        "distance_summary": f"""WITH {_DIST}, {_WANTED}, t AS (SELECT ordinal, gene_1, gene_2, count(d) AS n FROM want LEFT JOIN dist ON gene_A = gene_1 AND gene_B = gene_2 GROUP BY ALL)
SELECT ordinal, gene_1, gene_2, gene_1 || '_' || gene_2 AS pair, n AS total_distance_count, CAST(CASE WHEN n < 2 THEN 0 WHEN n > 40 THEN 40 ELSE n END AS BIGINT) AS output_distance_count,
CASE WHEN n = 0 THEN 'not_found' WHEN n < 2 THEN 'below_minimum' WHEN n > 40 THEN 'sampled' ELSE 'complete' END AS status FROM t""",
        "shape_stats": f"WITH {_SHAPE} SELECT gene_A, gene_B, {_SHAPE_COLS} FROM shape WHERE shape_count >= 20",
        "shape_relative": f"""WITH {_SHAPE} SELECT gene_A, gene_B, {_SHAPE_COLS}, round(1 / (1 + exp(skewness)), 6) AS skewness_adjusted, round(skewness + 0.566, 6) AS skewness_relative,
round(kurtosis + 0.6, 6) AS kurtosis_relative, round(median - 0.707 * 5.0::DOUBLE, 6) AS median_relative, round(q25 - 0.5 * 5.0::DOUBLE, 6) AS q25_relative, round(q75 - 0.866 * 5.0::DOUBLE, 6) AS q75_relative
FROM shape WHERE shape_count >= 20""",
        "shape_join": f"""WITH {_SHAPE.replace(_PTS, _EXACT, 1)}, both_ways AS (SELECT * FROM shape WHERE shape_count >= 60 UNION ALL SELECT gene_B, gene_A, * EXCLUDE (gene_A, gene_B) FROM shape WHERE shape_count >= 60)
SELECT res.gene_A, res.gene_B, gene_B_around, {_SHAPE_COLS} FROM res LEFT JOIN both_ways s ON s.gene_A = res.gene_A AND s.gene_B = res.gene_B""",
        "control_baseline": _controls({"reds": "g LIKE 'red%'", "rods": "g LIKE '%rod'", "one": "g = 'hot gear'"}),
        "control_contains": _controls({"ears": "g ILIKE '%ear%'", "reds": "g ILIKE 'red%'"}, "first"),
        "scan_flat": pts + 'SELECT g AS "geneID", 0.0::DOUBLE AS z, count(*) AS n, round(sum(x), 3) AS sum_x, round(sum(y), 3) AS sum_y FROM pts GROUP BY g',
        "scan_pairs": """WITH b AS (SELECT a.p_partkey AS k, least(a.p_name, b.p_name) AS gene_1, greatest(a.p_name, b.p_name) AS gene_2 FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_name <> b.p_name),
o AS (SELECT gene_1, gene_2, min(k) AS k FROM b GROUP BY ALL) SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS ordinal, gene_1, gene_2 FROM o""",
        "distances_retained": f"WITH {_DIST}, {_WANTED} SELECT gene_1, gene_2, gene_1 || '_' || gene_2 AS pair, round(d, 6) AS distance FROM dist JOIN want ON gene_A = gene_1 AND gene_B = gene_2",
        "distances_summary_file": f"""WITH {_DIST}, {_WANTED}, t AS (SELECT ordinal, gene_1, gene_2, count(d) AS n FROM want LEFT JOIN dist ON gene_A = gene_1 AND gene_B = gene_2 GROUP BY ALL),
u AS (SELECT *, CAST(CASE WHEN n < 2 THEN 0 WHEN n > 40 THEN 40 ELSE n END AS BIGINT) AS kept FROM t)
SELECT gene_1, gene_2, gene_1 || '_' || gene_2 AS pair, n AS total_distance_count, kept AS output_distance_count, kept AS rows_written,
CASE WHEN n = 0 THEN 'not_found' WHEN n < 2 THEN 'below_minimum' WHEN n > 40 THEN 'sampled' ELSE 'complete' END AS status FROM u""",
        "run_files": f"WITH {_tested(_BG_WITH)}, {_dedup('last')} SELECT {_TESTED}, 'raw' AS file FROM res UNION ALL SELECT {_TESTED}, 'final' AS file FROM one WHERE qvalue_BH < 1e-5",
        "events_file": f"WITH e AS ({_events(False)}) SELECT *, row_number() OVER (PARTITION BY cell ORDER BY gene_A) - 1 AS place FROM e WHERE gene_A <> 'no such gene'",
        "shape_sampled": f"""{f'WITH {_SHAPE}'.replace("mom AS (SELECT gene_A", """r AS (SELECT *, row_number() OVER (PARTITION BY gene_A, gene_B ORDER BY d) AS rk, count(*) OVER (PARTITION BY gene_A, gene_B) AS total FROM dist),
own AS (SELECT gene_A, gene_B, d, total FROM r QUALIFY row_number() OVER (PARTITION BY gene_A, gene_B ORDER BY CAST('0x' || substr(md5(gene_A || '|' || gene_B || '|' || rk), 1, 15) AS BIGINT), rk) <= 30),
mom AS (SELECT gene_A""", 1).replace("FROM dist GROUP BY ALL),\ncen", "FROM own GROUP BY ALL),\ncen").replace("count(*) AS n, avg", "max(total) AS n, avg").replace("FROM dist JOIN mom", "FROM (SELECT gene_A, gene_B, d FROM own) JOIN mom")} SELECT gene_A, gene_B, {_SHAPE_COLS} FROM shape WHERE shape_count >= 20""",
        "sql_functions": f"""WITH {_tested(_BG_ALL)}, {_DIST.removeprefix(_PTS + ", ")}, {_MODES}
SELECT t.gene_A, t.gene_B, CASE WHEN pvalue > 0 THEN round(log10(pvalue), 6) + 0.0 END AS log_p, round(mode, 6) AS mode, round(2 * mode / 25.0::DOUBLE, 6) AS density, round(mode * mode / 25.0::DOUBLE, 6) AS share
FROM (SELECT * FROM res) t LEFT JOIN modes m ON m.gene_A = t.gene_A AND m.gene_B = t.gene_B""",
        "multi_radius_unsegmented": " UNION ALL ".join(f"SELECT *, CAST({r} AS DOUBLE) AS r_check FROM (WITH {_bg_flat(r)} SELECT gene_A, gene_B, gene_B_around, gene_around FROM bg WHERE gene_A_N <= 100 * gene_B_N AND gene_B_N <= 100 * gene_A_N)" for r in FLAT_RADII),
        "multi_radius": " UNION ALL ".join(f"SELECT *, CAST({r} AS DOUBLE) AS r_check FROM (WITH {_PTS}, {_near('pts', r)} {_k('m')})" for r in R_MORE),
        "unsegmented_radius": f"WITH {_tiled('pix', R, 'radius')} SELECT ag AS gene_A, g AS gene_B, count(*) AS k FROM near WHERE ag <> g GROUP BY ALL",
        "unsegmented_grid": f"WITH {_tiled('pix', GRID, 'grid')} SELECT ag AS gene_A, count(*) AS n FROM (SELECT DISTINCT i, j, x, y, ag FROM near) GROUP BY ag",
        "tissue_map": f"""WITH e AS ({_events(False)}), exact AS (SELECT c, median(x) AS cx, median(y) AS cy FROM ({pts} SELECT * FROM pts) GROUP BY c)
SELECT e.*, round(-cx - (SELECT min(-cx) FROM exact), 6) AS x_relative, round(cy - (SELECT min(cy) FROM exact), 6) AS y_relative FROM e JOIN exact ON c = cell""",
        "distance_curves": _curves(60),
        "distance_curves_all": _curves(600),
        "random_reference": f"""WITH {_DIST}, s AS (SELECT least(floor(d * 20), 99) AS step, count(*) AS n FROM dist GROUP BY ALL), r AS (SELECT i, (i + 1) / 20.0::DOUBLE AS rad FROM range(100) t(i))
SELECT round(rad, 9) AS distance, round(2 * rad / 25.0::DOUBLE, 9) AS density, round(rad * rad / 25.0::DOUBLE, 9) AS share,
  round(CAST((SELECT sum(n) FROM s WHERE step <= i) AS DOUBLE) / (SELECT sum(n) FROM s), 9) AS observed_share FROM r""",
    }
