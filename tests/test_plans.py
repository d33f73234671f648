"""Whole runs from the command line, and plans that must not grow or gather."""

import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vicinal import cli
from vicinal.config import RunConfig
from vicinal.operators import distances, events, neighbors
from vicinal.plans import analysis
from vicinal.sources import sinks, transcripts


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i % 23 * 0.5, i % 17 * 0.5, float(i % 2), "ABCDE"[i * i % 5], f"c{i % 6}") for i in range(3000)]
    return spark.createDataFrame(rows, "x double, y double, z double, geneID string, cell string").cache()


def test_distribution_run_ends(spark, points, tmp_path):
    points.write.parquet(str(tmp_path / "p.parquet"))
    args = ["run", "--detection_method", "radius", "--background", "all", "--r_check", "1", "--data_path", str(tmp_path / "p.parquet"), "--save_path", str(tmp_path / "r.csv"), "--filter_threshold", "2", "--single_file", "--distribution_analysis", "--r_dist", "2", "--around_count_threshold", "5", "--shape_qvalue_threshold", "1"]
    parsed = cli.parser().parse_args(args)
    began = time.time()
    paths = parsed.call(parsed, spark)
    assert time.time() - began < 120
    raw, final, shape = (spark.read.csv(p, header=True) for p in paths)
    assert raw.count() and final.count() and shape.count() and "kurtosis_relative" in final.columns
    assert [p.name for p in tmp_path.glob("*.stage")] == []
    parsed = cli.parser().parse_args([*args, "--around_count_threshold", "9999999", "--shape_max_distance_count", "9999999"])
    assert len(parsed.call(parsed, spark)) == 2  # no shape, no file for it


def test_plan_of_a_distribution_run_is_small(spark, points, tmp_path):
    config = RunConfig(r_check=1.0, r_dist=2.0, distribution_analysis=True, around_count_threshold=5, shape_qvalue_threshold=1.0)
    staged = []

    def stage(table, name):
        staged.append(table)
        return sinks.staged(table, str(tmp_path / name))

    out = analysis.results_of(points, stage(analysis.raw_result(points, config), "raw"), config, stage)
    for table in (*staged, out["final"]):
        assert table._jdf.queryExecution().optimizedPlan().collectLeaves().size() < 60, table.columns


@pytest.mark.parametrize("identity", ["row", "value"])
def test_one_aggregate_for_both_counts(points, identity):
    near = neighbors.near_genes(points, 1.0)
    pairs, around = neighbors.pairs_and_around(near, identity)
    assert sorted(pairs.collect()) == sorted(neighbors.pair_counts(near, identity).collect())
    assert sorted(around.collect()) == sorted(neighbors.around(near, identity).collect())
    by_cell = neighbors.pairs_and_around(near, identity, by_cell=True)[1]
    assert sorted(by_cell.select("A", "cell", "n").collect()) == sorted(neighbors.around(near, identity, by_cell=True).select("A", "cell", "n").collect())


def test_given_bucket_width_changes_nothing(points):
    want = sorted(neighbors.pair_counts(neighbors.near_genes(points, 1.0)).collect())
    for width in (0.3, 1.0, 50.0):
        assert sorted(neighbors.pair_counts(neighbors.near_genes(points, 1.0, width=width)).collect()) == want


def test_samples_in_buckets(spark):
    """The sample by buckets against windows over whole pairs; many equal distances, zeros among them."""
    rows = [("a", "b", (i * 37 % 101) / 7) for i in range(700)] + [("a", "c", 1.0)] * 60 + [("b", "c", 0.0)] * 90 + [("c", "d", float(i)) for i in range(40)]
    found = spark.createDataFrame(rows, "gene_A string, gene_B string, distance double")
    keys = ["gene_A", "gene_B"]
    ranked = found.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("distance")))
    chosen = ranked.withColumn("_in", F.row_number().over(Window.partitionBy(*keys).orderBy(distances.spot(keys, "_rank"), "_rank"))).where("_in <= 50")
    want = sorted(tuple(r) for r in chosen.select(*keys, "distance").collect())
    for bucket_rows in (7, 20_000):
        got = distances.sampled(found, 50, bucket_rows)
        assert sorted(tuple(r) for r in got.select(*keys, "distance").collect()) == want
        assert {(r["gene_A"], r["gene_B"]): r["count"] for r in got.collect()} == {("a", "b"): 700, ("a", "c"): 60, ("b", "c"): 90, ("c", "d"): 40}
        places = distances.placed(found, keys, bucket_rows).groupBy(*keys).agg(F.sort_array(F.collect_list("place")).alias("p")).collect()
        assert all(r["p"] == list(range(len(r["p"]))) for r in places)


def test_events_of_a_long_request(spark, points, monkeypatch):
    pairs = transcripts.pair_table(spark, [("A", "B"), ("C", "A"), ("D", "E"), ("B", "E")])
    want = sorted(events.cell_events(points, pairs, 1.0).collect())
    monkeypatch.setattr(events, "BLOCK", 2)
    out = events.cell_events(points, pairs, 1.0)
    assert sorted(out.collect()) == want and len(want) == 24
    assert "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()


def test_files_are_replaced(spark, tmp_path):
    one, two = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "a int")
    target = tmp_path / "t.csv"
    sinks.write_single(one, str(target))
    sinks.write_single(two, str(target))
    assert target.read_text().split() == ["a", "2"]
    folder = tmp_path / "f.csv"
    sinks.write_dataset(one, str(folder))
    sinks.write_single(two, str(folder))
    assert folder.is_file() and folder.read_text().split() == ["a", "2"]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["f.csv", "t.csv"]
