"""Command line: vicinal run | events | distances | controls."""

from __future__ import annotations

import argparse
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import RunConfig, check_radii, with_radius
from .functions import stats
from .operators import controls, distances, events, results
from .plans import analysis
from .sources import sinks, transcripts
from .sources.stages import Stages, fingerprint
from .workers import provide


def session(name: str = "vicinal") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _pairs(spark: SparkSession, args) -> DataFrame:
    if bool(args.pair) == bool(args.pairs_file):
        raise ValueError("give either --pair or --pairs_file")
    return transcripts.pair_table(spark, [tuple(p) for p in args.pair]) if args.pair else transcripts.read_pair_table(spark, args.pairs_file)


def _config(args, r_check) -> RunConfig:
    return RunConfig(
        detection_method=args.detection_method, background=args.background, r_check=r_check, grid_check=args.grid_check, z_mode=args.z_mode,
        column_name=args.column_name, min_gene_number=args.min_gene_number, min_neighbor_number=args.min_neighbor_number,
        expression_level=args.expression_level, filter_threshold=args.filter_threshold, pair_keep=args.pair_keep,
        distribution_analysis=args.distribution_analysis, r_dist=args.r_dist, around_count_threshold=args.around_count_threshold,
        shape_max_distance_count=args.shape_max_distance_count, shape_qvalue_threshold=args.shape_qvalue_threshold,
        unsegmented=args.unsegmented, rect_length=args.rect_length, mode=args.mode, exclude_cells=tuple(args.exclude_cell or ()),
        bucket_width=args.bucket_width,
    )


def run(args, spark: SparkSession) -> list[str]:
    """The analysis for each radius; returns the paths written. Files for one of several radii have it in their names.

    Raw results are written once, with one neighbour search for all radii, beside the target; all else reads them there. These
    stages stay if the run fails or its driver is lost, and the same run, started again on the same input, goes on after the last whole one.
    """
    config = _config(args, tuple(args.r_check) if args.r_check else None)
    points = transcripts.read_points(spark, args.data_path, args.column_name, args.unsegmented)
    paths, parts = [], config.by_radius()
    many, shaped = len(parts) > 1, config.distribution_analysis
    stage = Stages(spark, f"{args.save_path}.stage", {"options": asdict(config), "input": fingerprint(spark, args.data_path)})
    write = sinks.write_single if args.single_file else sinks.write_dataset
    every = stage(lambda: analysis.raw_result(points, config), "raw")
    for part in parts:
        save = with_radius(args.save_path, part.r_check) if many else args.save_path
        raw = every.where(F.col("r_check") == part.r_check).drop("r_check") if many else every
        out = analysis.results_of(points, raw, part, lambda table, name, part=part: stage(table, f"{name}-{part.r_check}"))
        write(out["raw"], save)
        final = sinks.final_path(save, part.filter_threshold, shaped)
        write(out["final"], final) if args.single_file else sinks.write_numbered(results.numbered(out["final"]), final)
        paths += [save, final]
        if shaped and not out["shape"].isEmpty():
            write(out["shape"], sinks.shape_path(save))
            paths.append(sinks.shape_path(save))
        if shaped and args.intermediate_dir:
            kept = with_radius(args.intermediate_dir, part.r_check) if many else args.intermediate_dir
            sinks.retain_distances(distances.distances(analysis.prepared(points, part), part.r_dist), f"{kept}/{part.background}")
    stage.close()
    return paths


def run_events(args, spark: SparkSession) -> str:
    pairs = _pairs(spark, args)
    (radius,) = check_radii(args.r_check)
    points = transcripts.read_points(spark, args.data_path, args.column_name, finite=True)
    absent = [r[0] for r in transcripts.missing_genes(points, pairs).collect()]
    if absent:
        raise ValueError(f"no point has the genes {', '.join(sorted(absent))}")
    rows = events.cell_events(points, pairs, radius, args.z_mode)
    order = pairs.select(F.col("gene_1").alias("gene_A"), F.col("gene_2").alias("gene_B"), "ordinal")
    sinks.write_single(rows.join(order, ["gene_A", "gene_B"]).orderBy("cell", "ordinal").select(rows.columns), args.save_path)
    return args.save_path


def run_distances(args, spark: SparkSession) -> str:
    """Export from retained distances, or from points."""
    pairs = _pairs(spark, args)
    if args.max_distance_count is not None and args.max_distance_count < max(1, args.min_distance_count):
        raise ValueError("max_distance_count is below min_distance_count")
    wanted = pairs.select(F.col("gene_1").alias("gene_A"), F.col("gene_2").alias("gene_B"))
    if args.distances_dir:
        found = spark.read.parquet(sinks.published(spark, sinks.retained_layout(spark, args.distances_dir, args.background)))
        buckets = [r[0] for r in wanted.select(F.pmod(F.xxhash64("gene_A"), F.lit(64))).distinct().collect()]
        found = found.where(F.col("bucket").isin(buckets)).join(wanted, ["gene_A", "gene_B"], "left_semi").drop("bucket")
    else:
        points = transcripts.read_points(spark, args.data_path, args.column_name)
        found = distances.distances(points, args.r_dist, wanted)
    rows, report = distances.export(found, pairs, args.min_distance_count, args.max_distance_count, args.random_seed)
    sinks.write_export(rows, report, args.save_path, args.output_format, args.summary_path)
    report.orderBy("ordinal").drop("ordinal").show(1000, truncate=False)
    return args.save_path


def run_controls(args, spark: SparkSession) -> DataFrame:
    rules = [tuple(r) for r in args.control]
    raw = transcripts.read_result(spark, args.input)
    summary = controls.control_baseline(raw, rules, args.threshold, args.pair_keep, args.ignore_case)
    sinks.write_single(summary, args.save_path)
    summary.show(1000, truncate=False)
    return summary


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vicinal")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("run", help="test which ordered gene pairs are co-located")
    p.add_argument("--detection_method", choices=["radius", "nine_grid"], required=True)
    p.add_argument("--background", choices=["all", "cooccurrence"], required=True)
    p.add_argument("--mode", choices=["robust", "fast"], default="fast")
    p.add_argument("--data_path", required=True)
    p.add_argument("--save_path", required=True)
    p.add_argument("--column_name", default="x,y,z,geneID,cell")
    p.add_argument("--r_check", type=float, nargs="+")
    p.add_argument("--z_mode", choices=["discrete", "continuous"], default="discrete")
    p.add_argument("--grid_check", type=int)
    p.add_argument("--min_gene_number", type=int, default=5)
    p.add_argument("--min_neighbor_number", type=int, default=1)
    p.add_argument("--expression_level", type=float, default=100)
    p.add_argument("--filter_threshold", type=float, default=1e-5)
    p.add_argument("--pair_keep", choices=["first", "last"], default="last")
    p.add_argument("--intermediate_dir")
    p.add_argument("--intermediate_split", type=int, default=100, help="accepted; shuffles need no split")
    p.add_argument("--distribution_analysis", action="store_true")
    p.add_argument("--r_dist", type=float)
    p.add_argument("--around_count_threshold", type=int, default=100)
    p.add_argument("--shape_max_distance_count", type=int, default=10_000)
    p.add_argument("--shape_qvalue_threshold", type=float, default=0.05)
    p.add_argument("--distribution_save_interval", type=int, default=10, help="accepted; nothing is saved in between")
    p.add_argument("--unsegmented", action="store_true")
    p.add_argument("--rect_length", type=float, default=20)
    p.add_argument("--rtree_path", help="accepted; tiles need no index")
    p.add_argument("--exclude_cell", action="append")
    p.add_argument("--bucket_width", type=float, help="side of the search's buckets; by default from the points' density, which takes a pass")
    p.add_argument("--single_file", action="store_true", help="one CSV file for each result, not a folder of parts")
    p.set_defaults(call=run)
    p = sub.add_parser("events", help="count events of gene pairs in every cell")
    p.add_argument("--r_check", type=float, required=True)
    p.add_argument("--z_mode", choices=["discrete", "continuous"], default="discrete")
    p.set_defaults(call=run_events)
    q = sub.add_parser("distances", help="export distances of gene pairs")
    q.add_argument("--distances_dir")
    q.add_argument("--background", choices=["auto", "all", "cooccurrence"], default="auto", help="which run's distances to read")
    q.add_argument("--r_dist", type=float)
    q.add_argument("--min_distance_count", type=int, default=1)
    q.add_argument("--max_distance_count", type=int)
    q.add_argument("--random_seed", type=int, default=42)
    q.add_argument("--summary_path", help="where the summary goes; by default beside the export")
    q.add_argument("--output_format", choices=["csv", "csv.gz", "parquet"])
    q.set_defaults(call=run_distances)
    for x in (p, q):
        x.add_argument("--data_path", required=x is p)
        x.add_argument("--save_path", required=True)
        x.add_argument("--column_name", default="x,y,z,geneID,cell")
        x.add_argument("--pair", nargs=2, action="append", metavar=("A", "B"))
        x.add_argument("--pairs_file")
    p = sub.add_parser("controls", help="false-positive baseline from control features")
    p.add_argument("--input", required=True)
    p.add_argument("--save_path", required=True)
    p.add_argument("--control", nargs=3, action="append", required=True, metavar=("GROUP", "MODE", "TEXT"))
    p.add_argument("--threshold", type=float, nargs="+", default=[1e-5])
    p.add_argument("--pair_keep", choices=["first", "last"], default="last")
    p.add_argument("--ignore_case", action="store_true")
    p.set_defaults(call=run_controls)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = session()
    provide(spark)
    stats.register(spark)
    args.call(args, spark)


if __name__ == "__main__":
    main()
