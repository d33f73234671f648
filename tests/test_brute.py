"""Operators against plain loops on random points with ties, equal points and distances of exactly the radius."""

import math
import random
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vicinal.operators import neighbors

POINT = st.tuples(st.integers(-4, 4).map(lambda v: v * 0.5), st.integers(-4, 4).map(lambda v: v * 0.5), st.sampled_from([0.0, 0.5]), st.sampled_from("ABC"), st.sampled_from(["c1", "c2"]))


CASES = (st.lists(POINT, min_size=1, max_size=30), st.sampled_from([0.5, 1.0, 1.5]), st.sampled_from(["discrete", "continuous", "grid"]))


@settings(max_examples=8, deadline=None)
@given(*CASES)
def test_near(spark, rows, reach, mode):
    near_as_loops_find(spark, rows, reach, mode)


@settings(max_examples=8, deadline=None)
@given(*CASES)
def test_near_with_cut_buckets(spark, rows, reach, mode):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(neighbors, "CROWD", 2)
        patch.setattr(neighbors, "DEEPEST", 3)
        near_as_loops_find(spark, rows, reach, mode)


def near_as_loops_find(spark, rows, reach, mode):
    near = neighbors.near_genes(spark.createDataFrame(rows, "x double, y double, z double, geneID string, cell string"), reach, "grid" if mode == "grid" else "radius", "continuous" if mode == "continuous" else "discrete")
    k = {(r["A"], r["B"]): r["k"] for r in neighbors.pair_counts(near).collect()}
    n = {r["A"]: r["n"] for r in neighbors.around(near).collect()}

    def close(p, a):
        if p[4] != a[4] or (mode != "continuous" and p[2] != a[2]):
            return False
        dx, dy, dz = p[0] - a[0], p[1] - a[1], p[2] - a[2]
        if mode == "grid":
            return max(abs(dx), abs(dy)) <= reach
        return dx * dx + dy * dy + (dz * dz if mode == "continuous" else 0) <= reach * reach

    for gene in {r[3] for r in rows}:
        around = [p for p in rows if any(a[3] == gene and close(p, a) for a in rows)]
        assert n[gene] == len(around)
        for other in {r[3] for r in rows} - {gene}:
            assert k.get((gene, other), 0) == sum(p[3] == other for p in around)


@pytest.fixture(scope="module")
def crowd(spark):
    """A third of all points in one cell of 300, close to each other."""
    rng = random.Random(8)
    rows = [(rng.random() * 4, rng.random() * 4, 0.0, rng.choice("ABCDEFGH"), "hot") for _ in range(5000)]
    rows += [(rng.random() * 20, rng.random() * 20, 0.0, rng.choice("ABCDEFGH"), f"c{i % 299}") for i in range(10_000)]
    return spark.createDataFrame(rows, "x double, y double, z double, geneID string, cell string").cache()


def work(points, most, monkeypatch):
    """Comparisons of each of 32 tasks, and of all."""
    monkeypatch.setattr(neighbors, "CROWD", most)
    own, other, keys = neighbors.keyed(points, points, 0.25)
    met = own.groupBy(*keys).agg(F.count("*").alias("n")).join(other.groupBy(*keys).agg(F.count("*").alias("m")), keys)
    tasks = met.groupBy(F.pmod(F.hash(*keys), F.lit(32)).alias("task")).agg(F.sum(F.col("n") * F.col("m")).alias("w")).collect()
    return sorted(r["w"] for r in tasks)


def test_one_cell_with_a_third_of_all_points(crowd, monkeypatch):
    whole = work(crowd, 10**9, monkeypatch)
    assert whole[-1] > 3 * statistics.median(whole)  # without cuts one task has most of the work
    cut = work(crowd, 40, monkeypatch)
    assert len(cut) == 32 and cut[-1] <= 3 * statistics.median(cut) and sum(cut) < sum(whole)


def test_cuts_change_no_count(crowd, monkeypatch):
    want = sorted(neighbors.pair_counts(neighbors.near_genes(crowd, 0.25)).collect())
    for most, cuts in ((40, 50_000), (40, 7), (150, 50_000)):
        monkeypatch.setattr(neighbors, "CROWD", most)
        monkeypatch.setattr(neighbors, "MOST_CUTS", cuts)
        found = neighbors.crowded_buckets(crowd, neighbors.bucket_width(crowd, 0.25))
        assert 0 < len(found) <= cuts and {c[1] for c in found} >= {"hot"}
        held = {c for c in found}
        assert all(c[0] == 0 or (c[0] - 1, c[1], c[2], c[3] // 2, c[4] // 2) in held for c in found)  # no part without the whole
        assert sorted(neighbors.pair_counts(neighbors.near_genes(crowd, 0.25)).collect()) == want


def shuffles(frame):
    """(shuffles that Spark adds, shuffles asked for) in the plan of a frame."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count("ENSURE_REQUIREMENTS"), plan.count("REPARTITION_BY_COL")


def test_points_move_once_to_their_buckets(spark, monkeypatch):
    """Points and centres meet, and are grouped by point, where one shuffle by bucket brought them; only counts and copies of centres move besides."""
    monkeypatch.setattr(neighbors, "CROWD", 10**9)
    rows = [((i * 7 % 13) / 3, (i * 5 % 11) / 3, float(i % 2), "ABCD"[i % 4], f"c{i % 3}") for i in range(120)]
    points = spark.createDataFrame(rows, "x double, y double, z double, geneID string, cell string")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for mode in ("discrete", "continuous"):
            near = neighbors.near_genes(points, 0.5, z_mode=mode)
            assert shuffles(near.groupBy("A", "geneID").agg(F.sum("m")))[0] == 1
            near.groupBy("A").count().collect()
            sums = near.groupBy("A").count()
            sums.collect()
            assert sums._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 2  # at its end the plan has read one shuffle three times
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_sums_come_from_one_search(spark):
    """Pairs and points around are read from written sums, not from a search each."""
    rows = [((i * 7 % 13) / 3, (i * 5 % 11) / 3, float(i % 2), "ABCD"[i % 4], f"c{i % 3}") for i in range(120)]
    near = neighbors.near_genes(spark.createDataFrame(rows, "x double, y double, z double, geneID string, cell string"), 0.5)
    for identity, by_cell in (("row", False), ("row", True), ("pixel", False), ("pixel", True)):
        pairs, n = neighbors.pairs_and_around(near, identity, by_cell)
        assert sorted(pairs.collect()) == sorted(neighbors.pair_counts(near, identity).collect())
        assert sorted(n.collect()) == sorted(neighbors.around(near, identity, by_cell).collect())
        assert all("Join" not in f._jdf.queryExecution().executedPlan().toString() for f in (pairs, n))


def test_boundary_bucket(spark):
    rows = [(i * 0.1, 0.0, 0.0, "A" if i % 2 else "B", "c") for i in range(60)]
    k = {(r["A"], r["B"]): r["k"] for r in neighbors.pair_counts(neighbors.near_genes(spark.createDataFrame(rows, "x double, y double, z double, geneID string, cell string"), 0.1)).collect()}
    expected = sum(any(q[3] == "A" and (p[0] - q[0]) ** 2 <= 0.1 * 0.1 for q in rows) for p in rows if p[3] == "B")
    assert k.get(("A", "B"), 0) == expected and math.isfinite(expected)


@pytest.mark.parametrize("reach", [0.5, 2.0])
def test_monotone_and_bounded(spark, reach):
    rows = [((i * 7 % 13) / 3, (i * 5 % 11) / 3, 0.0, "ABCD"[i % 4], f"c{i % 3}") for i in range(120)]
    points = spark.createDataFrame(rows, "x double, y double, z double, geneID string, cell string")
    near = neighbors.near_genes(points, reach)
    n = {r["A"]: r["n"] for r in neighbors.around(near).collect()}
    wider = {(r["A"], r["B"]): r["k"] for r in neighbors.pair_counts(neighbors.near_genes(points, reach * 1.5)).collect()}
    for r in neighbors.pair_counts(near).collect():
        assert r["k"] <= n[r["A"]] and r["k"] <= 30 and r["k"] <= wider[r["A"], r["B"]]


@settings(max_examples=6, deadline=None)
@given(st.lists(POINT, min_size=1, max_size=40), st.sampled_from([0.5, 1.0, 1.5]))
def test_squares_find_what_the_search_finds(spark, rows, reach):
    points = spark.createDataFrame([(x, y, 0.0, g, c) for x, y, _, g, c in rows], "x double, y double, z double, geneID string, cell string")
    centres = points.where("x <= 1")
    near = neighbors.near_genes(points, reach, centres=centres)
    pairs, n = neighbors.pairs_and_around_by_squares(points, centres, reach)
    assert sorted(pairs.collect()) == sorted(neighbors.pair_counts(near, "value").collect())
    assert sorted(n.collect()) == sorted(neighbors.around(near, "value").collect())


def test_flat_points_are_not_crossed_with_genes(spark, monkeypatch):
    """Without cells no row is made for each point and gene in reach."""
    from vicinal.config import RunConfig
    from vicinal.plans import analysis

    monkeypatch.setattr(neighbors, "near_genes", None)
    rows = [((i * 7 % 13) / 3, (i * 5 % 11) / 3, 0.0, "ABCD"[i % 4]) for i in range(120)]
    points = spark.createDataFrame(rows, "x double, y double, z double, geneID string")
    found = analysis.raw_result(points, RunConfig(r_check=(0.5, 1.0), unsegmented=True, rect_length=2.0))
    assert {r["r_check"] for r in found.collect()} == {0.5, 1.0}


@pytest.mark.parametrize("full, genes, spread", [(0, 4, 5), (2, 150, 9), (1000, 90, 5)])  # the shortest squares, some between, the longest
def test_squares_of_several_radii_against_brute_force(spark, monkeypatch, full, genes, spread):
    """Squares of any side, with settled and open genes, over 64 genes, points at exactly a radius, repeated and null ones."""
    monkeypatch.setattr(neighbors, "FULL", full)
    monkeypatch.setattr(neighbors, "LEAST_POINTS", 100)
    rng, radii = random.Random(full + genes), (0.3, 0.5, 0.9)
    rows = []
    for i in range(500):
        at = (rng.randrange(-10 * spread, 10 * spread) / 20, rng.randrange(30) / 20) if i % 2 else (rng.random() * spread, rng.random())
        rows.append((*at, f"g{int(genes * rng.random() ** 2)}", f"c{i % 3 // 2}", rng.choice([1, 2, 3, 3])))
    rows += rows[:40] + [(0.1, 0.2, None, "c0", 3), (None, 0.2, "g0", "c0", 3), (-0.0, 0.0, "g1", "c1", 1)]
    placed = spark.createDataFrame(rows, "x double, y double, geneID string, cell string, kind int")
    kinds = {}
    for *at, kind in rows:
        kinds[tuple(at)] = kinds.get(tuple(at), 0) | kind
    want = {}
    for x, y, g, c in (k for k, kind in kinds.items() if kind & 1 and k[0] is not None):
        near = {}
        for ax, ay, a, ac in (k for k, kind in kinds.items() if kind & 2 and k[0] is not None and k[2]):
            if ac == c:
                d = (x - ax) * (x - ax) + (y - ay) * (y - ay)
                near[a] = min(d, near.get(a, d))
        for a, d in near.items():
            for k, r in enumerate(radii):
                if d <= r * r:
                    want.setdefault((a, g), [0, 0, 0])[k] += 1
    got = {(r["A"], r["geneID"]): [r["n0"], r["n1"], r["n2"]] for r in neighbors.sums_by_squares(placed, radii).collect()}
    assert {k: n for k, n in got.items() if any(n)} == want
