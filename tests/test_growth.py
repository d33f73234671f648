"""Steps whose work grows with the points alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.functions import kernels
from vicinal.operators import distances, figures, neighbors, prep
from vicinal.plans import queries as own
from vicinal.sources import sinks


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    lines = [(i % 5 + 1, i * 7 % 13 / 2, i * 11 % 17 * 500.0, i % 2 + 1, i % 9) for i in range(600)]
    spark.createDataFrame(lines, "l_partkey long, l_quantity double, l_extendedprice double, l_linenumber int, l_suppkey long").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(k, f"gene {k}") for k in range(1, 6)], "p_partkey long, p_name string").write.parquet(f"{d}/part.parquet")
    return d


@pytest.mark.parametrize("name", ["pair_bg_all", "pair_k_discrete", "distances_pair", "final_true_q", "shape_join", "distance_curves"])
def test_a_search_joins_its_points_once(spark, tables, name):
    """The tables are joined for one written copy of the points, and what a search reads several times is that."""
    read = own.queries()[name](spark, tables).inputFiles()
    assert read and not [f for f in read if "lineitem" in f]


def test_points_of_a_cell_lie_together(spark, tables):
    kept = own.points_once(spark, tables)
    assert sorted(kept.collect()) == sorted(own.points(spark, tables).collect())
    assert kept.select("cell", F.input_file_name()).distinct().count() == 9


@pytest.mark.parametrize("few", [True, False])
def test_genes_that_are_frequent_are_looked_up(spark, monkeypatch, few):
    monkeypatch.setattr(sinks, "BROADCAST_ROWS", 100 if few else 0)
    points = spark.createDataFrame([(float(i), 0.0, 0.0, g, "c") for i, g in enumerate("aaaabbbc")] + [(9.0, 0.0, 0.0, None, "c")], "x double, y double, z double, geneID string, cell string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = prep.frequent(points, 3)
        assert ("BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()) == few
        assert sorted(r["geneID"] for r in out.collect()) == list("aaaabbb")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("width", [0.13, 0.5, 1.0, 2.9, 3.99])
def test_narrow_kernels_are_not_dealt_to_the_grid(spark, monkeypatch, width):
    """Kernels of an eighth of a step and more are summed by parts of steps: no row is made for a distance and a point of the grid."""
    monkeypatch.setattr(kernels, "UNDERFLOW", 0.0)
    rng, points = np.random.default_rng(5), 60
    step = 5.0 / (points - 1)
    values = np.clip(2.5 + rng.normal(0, 1, 3000) * width * step * 3000**0.2, 0, 5)
    found = spark.createDataFrame([("p", float(v)) for v in values], "pair string, distance double")
    got = [r["density"] for r in sorted(figures.distance_curves(found, 5.0, points).where("pair = 'p'").collect(), key=lambda r: r["distance"])]
    bandwidth = np.std(values, ddof=1) * len(values) ** -0.2 / step
    assert 0.125 <= bandwidth < kernels.SMOOTH
    sums = np.exp(-0.5 * ((np.arange(points)[:, None] - values[None, :] / step) / bandwidth) ** 2).sum(axis=1)
    assert got == pytest.approx((sums / ((sums[:-1] + sums[1:]).sum() / 2 * step)).tolist(), abs=1e-9)


def test_quantiles_of_a_pair_just_over_the_bound_keep_few_rows(spark, monkeypatch):
    kept = []
    plain = distances._kept
    monkeypatch.setattr(distances, "_kept", lambda table, name: (name == "rank-rows" and kept.append(plain(table, name))) or (kept[-1] if name == "rank-rows" else plain(table, name)))
    table = spark.range(24_000).select(F.lit("a").alias("gene_A"), F.lit("b").alias("gene_B"), (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)).alias("distance"))
    q = distances.quantiles(table, distances.PAIR, (0.25, 0.5, 0.75), 20_000).first()["q"]
    assert q == pytest.approx(np.quantile([r["distance"] for r in table.select("distance").collect()], (0.25, 0.5, 0.75)).tolist(), abs=1e-15)
    assert 0 < kept[-1].count() < 6 * 200


@pytest.mark.parametrize("name", ["shape_join", "final_shapes", "sql_functions"])
def test_two_searches_share_their_points(spark, tables, monkeypatch, name):
    written = []
    plain = sinks.clustered
    monkeypatch.setattr(sinks, "clustered", lambda table, *named: written.append(named) or plain(table, *named))
    own.queries()[name](spark, tables)
    assert len(written) == 1


def test_tasks_of_a_search_hold_few_points(spark, monkeypatch):
    """However few partitions a session's shuffles have, points of a large table are dealt over as many tasks as they need; the pairs are the same."""
    points = spark.range(3000).selectExpr("double(id % 50) x", "double(id % 7) y", "1.0D z", "concat('g', id % 5) geneID", "concat('c', id % 300) cell")
    wide = sorted(neighbors.met(points, 1.5).collect(), key=str)
    monkeypatch.setattr(neighbors, "TASK_POINTS", 25)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        met = neighbors.met(points, 1.5)
        parts = met.withColumn("part", F.spark_partition_id()).groupBy("part").count()
        assert parts.count() > 60
        assert sorted(met.collect(), key=str) == wide and len(wide) > 3000
        plan = met._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(", 120") >= 2, plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("radii, searches", [((0.4, 0.6, 0.8), 1), ((0.4, 0.8, 2.0), 2), ((0.4, 1.7, 7.0), 3)])
def test_radii_near_one_another_share_a_search_without_cells(spark, monkeypatch, radii, searches):
    """Points without cells are dealt and compared once for radii close to one another, not once for each, and their genes are counted once."""
    from vicinal.config import RunConfig
    from vicinal.plans import analysis

    written = []
    plain = sinks.shared_path
    monkeypatch.setattr(sinks, "shared_path", lambda session, label: written.append(label) or plain(session, label))
    rows = [(i * 0.37 % 9, i * 0.91 % 7, 0.0, "ABCD"[i * i % 7 % 4]) for i in range(400)]
    flat = spark.createDataFrame(rows, "x double, y double, z double, geneID string")
    found = analysis.raw_result(flat, RunConfig(r_check=radii, unsegmented=True, rect_length=3.0))
    assert {r["r_check"] for r in found.collect()} == set(radii)
    assert written.count("sums") == searches and written.count("genes") == 1
