"""Kernel sums, modes, quantiles, curves, drawn places and global order against plain NumPy, with pairs cut into many buckets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.functions import kernels
from vicinal.operators import distances, figures, results
from vicinal.sources import sinks


def plain_sums(spots, bandwidth, points):
    grid = np.arange(points)
    total = np.zeros(points)
    for part in np.array_split(np.asarray(spots), max(1, len(spots) // 500)):
        total += np.exp(-0.5 * ((grid[:, None] - part[None, :]) / bandwidth) ** 2).sum(axis=1)
    return total


@pytest.mark.parametrize("bandwidth", [4.0, 8.0, 11.5, 40.0, 300.0])
@pytest.mark.parametrize("points", [60, 600])
def test_convolution(bandwidth, points):
    rng = np.random.default_rng(3)
    spots = np.concatenate([rng.random(2000) * (points - 1), [0.0, points - 1.0, 5.0, 5.5]])
    step = np.minimum(np.floor(spots).astype(int), points - 1)
    own = np.unique(step)
    moments = np.array([[((spots[step == s] - s - 0.5) ** k).sum() for k in range(kernels.MOMENTS + 1)] for s in own])
    got, want = kernels.convolved(own, moments, bandwidth, points), plain_sums(spots, bandwidth, points)
    assert np.abs(got - want).max() < 1e-12 * len(spots)


@pytest.fixture(scope="module")
def found(spark):
    """Pairs of all shapes: even, peaked beside an outlier (a narrow kernel), one value, two values, ties, one distance."""
    rng = random.Random(6)
    pairs = {
        ("a", "b"): [rng.random() * 5 for _ in range(3000)], ("a", "c"): [2.0 + rng.gauss(0, 0.01) for _ in range(2500)] + [0.001, 4.9],
        ("a", "d"): [1.25] * 700, ("b", "c"): [1.0, 4.0] * 30, ("b", "d"): [rng.randrange(1, 9) / 2 for _ in range(400)], ("c", "d"): [3.0],
        ("c", "e"): [5 * rng.random() ** 3 for _ in range(1000)],
    }
    rows = [(*pair, float(d)) for pair, values in pairs.items() for d in values]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "gene_A string, gene_B string, distance double").repartition(3).cache(), pairs


def test_modes(found):
    got = {(r["gene_A"], r["gene_B"]): r["mode"] for r in distances.modes(found[0]).collect()}
    assert set(got) == set(found[1])
    for pair, values in found[1].items():
        low, high = min(values), max(values)
        if low == high:
            assert got[pair] == low
            continue
        step, width = (high - low) / 999, 0.05 * np.std(values, ddof=1)
        sums = plain_sums((np.array(values) - low) / step, width / step, 1000)
        at = round((got[pair] - low) / step)
        assert got[pair] == pytest.approx(np.linspace(low, high, 1000)[at], abs=1e-12)
        assert sums[at] >= sums.max() * (1 - 1e-10), pair


@pytest.mark.parametrize("bucket_rows", [20_000, 100, 7])
def test_quantiles(found, bucket_rows):
    shares = (0.0, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = {(r["gene_A"], r["gene_B"]): r["q"] for r in distances.quantiles(found[0], distances.PAIR, shares, bucket_rows).collect()}
    assert set(got) == set(found[1])
    for pair, values in found[1].items():
        assert got[pair] == pytest.approx(np.quantile(values, shares).tolist(), abs=1e-12), pair


def test_shapes_of_large_pairs(found):
    """Pairs above the bound, chosen by rank, get what an aggregate over the whole pair gives."""
    whole = sorted(map(str, distances.shapes(found[0], 20, None, mode=False).collect()))
    cut = sorted(map(str, distances.shapes(found[0], 20, None, mode=False, bucket_rows=300).collect()))
    assert len(whole) == 6 and whole == cut
    assert distances.shapes(found[0], 20, None).columns == ["gene_A", "gene_B", "shape_count", "mode", "skewness", "kurtosis", "median", "q25", "q75", "iqr"]


def test_quantiles_keep_few_rows(spark, monkeypatch):
    """What a round keeps of a pair is the buckets of its ranks, not the pair."""
    kept = {}
    plain = distances._kept
    monkeypatch.setattr(distances, "_kept", lambda table, name: kept.setdefault(name, []).append(plain(table, name)) or kept[name][-1])
    table = spark.range(200_000).select(F.lit("a").alias("gene_A"), F.lit("b").alias("gene_B"), (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)).alias("distance"))
    q = distances.quantiles(table, distances.PAIR, (0.25, 0.5, 0.75), 1000).first()["q"]
    assert q == pytest.approx(np.quantile([r["distance"] for r in table.select("distance").collect()], (0.25, 0.5, 0.75)).tolist(), abs=1e-15)
    assert kept["rank-rows"][-1].count() <= 6 * 1100


def test_nothing_found(found):
    none = found[0].limit(0)
    assert distances.modes(none).count() == distances.quantiles(none, distances.PAIR, (0.5,)).count() == distances.shapes(none, 1, None).count() == 0
    assert figures.distance_curves(none.select(F.lit("p").alias("pair"), "distance"), 5.0, 10).count() == 10


def test_curves(found):
    own = found[0].select(F.concat_ws("_", "gene_A", "gene_B").alias("pair"), "distance")
    got = {}
    for r in figures.distance_curves(own, 5.0).collect():
        got.setdefault(r["pair"], []).append((r["distance"], r["density"]))
    step = 5.0 / 599
    assert set(got) == {"a_b", "a_c", "b_c", "b_d", "c_e", figures.RANDOM}  # pairs with a spread
    for pair, values in found[1].items():
        if "_".join(pair) in got:
            sums = plain_sums(np.array(values) / step, np.std(values, ddof=1) * len(values) ** -0.2 / step, 600)
            area = (sums[:-1] + sums[1:]).sum() / 2 * step
            assert [y for _, y in sorted(got["_".join(pair)])] == pytest.approx((sums / area).tolist(), abs=1e-10), pair


def test_a_curve_far_from_its_grid(spark):
    """Two close distances between two points of a coarse grid: the curve is that of the definition, however small before it is scaled."""
    values = [1.057, 1.061]
    own = spark.createDataFrame([("p", v) for v in values], "pair string, distance double")
    got = sorted((r["distance"], r["density"]) for r in figures.distance_curves(own, 5.0, 60).where("pair = 'p'").collect())
    sums = plain_sums(np.array(values) / (5 / 59), np.std(values, ddof=1) * 2**-0.2 / (5 / 59), 60)
    assert 0 < sums.max() < 1e-10
    assert [y for _, y in got] == pytest.approx((sums / ((sums[:-1] + sums[1:]).sum() / 2 * (5 / 59))).tolist(), rel=1e-9)


def test_no_plan_crosses_distances_with_a_grid(found):
    own = found[0].select(F.concat_ws("_", "gene_A", "gene_B").alias("pair"), "distance")
    for table in (figures.distance_curves(own, 5.0), distances.modes(found[0])):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_places_are_drawn_by_the_executors(spark, found, monkeypatch):
    """No rows of a request come to the driver, and the places are those of the generator itself."""
    monkeypatch.setattr(distances, "DRAWN", 16)
    pairs = spark.createDataFrame([(i, *p) for i, p in enumerate(sorted(found[1]))], "ordinal int, gene_1 string, gene_2 string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(found[0]), "collect", lambda self: pytest.fail("collected"))
        rows, _ = distances.export(found[0], pairs, 1, 50, 9)
    got = {}
    for r in rows.collect():
        got.setdefault((r["gene_1"], r["gene_2"]), []).append(r["distance"])
    for pair, values in found[1].items():
        if len(values) > 50:
            places = random.Random(distances.pair_seed(9, pair)).sample(range(len(values)), 50)
            assert sorted(got[pair]) == sorted(sorted(values)[k] for k in places)
        else:
            assert sorted(got[pair]) == sorted(values)


def test_final_order_and_files(spark, tmp_path, monkeypatch):
    """Places go on across the tasks' ranges, files follow each other at the row limit."""
    table = spark.range(1000).select(
        F.concat(F.lit("a"), F.col("id") % 7).alias("gene_A"), F.concat(F.lit("b"), F.col("id")).alias("gene_B"), (F.col("id") % 13 / 10).alias("qvalue_BH"), (F.col("id") % 5 / 1.0).alias("enrichment_ratio")
    ).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = results.numbered(table)
        assert placed.select(F.spark_partition_id()).distinct().count() >= 1
        got = [r[:4] for r in sorted(placed.collect(), key=lambda r: r["place"])]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted((tuple(r) for r in table.collect()), key=lambda r: (r[2], -r[3], r[0], r[1]))
    assert [tuple(r) for r in got] == want and sorted(r["place"] for r in placed.collect()) == list(range(1000))
    monkeypatch.setattr(sinks, "ROWS_A_FILE", 300)
    sinks.write_numbered(placed, str(tmp_path / "final.csv"))
    files = sorted((tmp_path / "final.csv").glob("part-*.csv"))
    lines = [f.read_text().splitlines()[1:] for f in files]
    assert [len(x) for x in lines] == [300, 300, 300, 100]
    assert [line.split(",")[1] for part in lines for line in part] == [r[1] for r in want]
    assert sinks.write_numbered(results.numbered(table.limit(0)), str(tmp_path / "none.csv")) is None
