"""Registered queries that have no SQL against plain Python on small tables."""

import math
from collections import defaultdict
from itertools import combinations

import pytest

from vicinal.plans import queries as own

NAMES = ["blue rod", "cold gear", "hot rod", "red gear", "warm bolt"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with lineitem and part, and the same points as (x, y, z, gene, cell)."""
    d = str(tmp_path_factory.mktemp("tables"))
    lines = [(i % 5 + 1, i * 7 % 13 / 2, i * 11 % 17 * 500.0, i % 2 + 1, i % 3 // 2) for i in range(150)]
    spark.createDataFrame(lines, "l_partkey long, l_quantity double, l_extendedprice double, l_linenumber int, l_suppkey long").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame(list(enumerate(NAMES, 1)), "p_partkey long, p_name string").write.parquet(f"{d}/part.parquet")
    return d, [(x, price / 1000.0, float(z), NAMES[part - 1], f"S{cell}") for part, x, price, z, cell in lines]


def distances_of(points, reach):
    found = defaultdict(list)
    for p, q in combinations(points, 2):
        near = (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2
        if p[4] == q[4] and p[2] == q[2] and p[3] != q[3] and near <= reach * reach:
            found[min(p[3], q[3]), max(p[3], q[3])].append(math.sqrt(near))
    return found


def deviation(values):
    mean = math.fsum(values) / len(values)
    return math.sqrt(math.fsum((v - mean) ** 2 for v in values) / (len(values) - 1))


def test_modes_use_all_distances(spark, tables):
    found = {pair: values for pair, values in distances_of(tables[1], 5.0).items() if len(values) >= 20}
    assert min(map(len, found.values())) > 60
    got = {(r["gene_A"], r["gene_B"]): r["mode"] for r in own.queries()["kde_mode"](spark, tables[0]).collect()}
    assert set(got) == set(found)
    for pair, values in found.items():
        low, high, width = min(values), max(values), 0.05 * deviation(values)
        grid = [low + (high - low) * i / 999 for i in range(1000)]
        density = [math.fsum(math.exp(-0.5 * ((at - v) / width) ** 2) for v in values) for at in grid]
        assert got[pair] == pytest.approx(grid[density.index(max(density))], abs=5.1e-7), pair  # the query rounds to six places


def test_curves_of_all_pairs(spark, tables):
    found = {"_".join(pair): values for pair, values in distances_of(tables[1], 5.0).items()}
    got = defaultdict(list)
    for r in own.queries()["distance_curves_all"](spark, tables[0]).collect():
        got[r["pair"]].append((r["distance"], r["density"]))
    assert set(got) == set(found) | {"Random expectation"} and len(found) == 10
    step = 5.0 / 599
    for pair, rows in got.items():
        rows.sort()
        assert [at for at, _ in rows] == pytest.approx([i * step for i in range(600)], abs=1e-6)
        if pair in found:
            width = deviation(found[pair]) * len(found[pair]) ** -0.2
            heights = [math.fsum(math.exp(-0.5 * ((i * step - v) / width) ** 2) for v in found[pair]) for i in range(600)]
            area = math.fsum((a + b) / 2 * step for a, b in zip(heights, heights[1:], strict=False))
        else:
            heights, area = [2 * i * step / 25.0 for i in range(600)], 1.0
        assert [y for _, y in rows] == pytest.approx([y / area for y in heights], abs=2e-6), pair


def test_final_rows(spark, tmp_path):
    """Two genes side by side in each cell, two others on their own."""
    names = ["a", "b", "c", "d"]
    lines = []
    for i in range(40):
        lines += [(1, 10.0 * i, 0.0, 1, i % 4), (2, 10.0 * i + 1, 0.0, 1, i % 4), (3, 10.0 * i, 50_000.0, 1, i % 4), (4, 10.0 * i, 90_000.0, 1, i % 4)]
    lines += [(3, 10.0 * i + 1, 0.0, 1, i % 4) for i in range(3)]
    spark.createDataFrame(lines, "l_partkey long, l_quantity double, l_extendedprice double, l_linenumber int, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(list(enumerate(names, 1)), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    points = [(x, price / 1000.0, names[part - 1], cell) for part, x, price, _, cell in lines]
    near = [{q[2] for q in points if q[3] == p[3] and (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= 4.0} for p in points]
    count = {g: sum(p[2] == g for p in points) for g in names}
    total, raw = len(points), {}
    for a in names:
        around = [p[2] for p, genes in zip(points, near, strict=True) if a in genes]
        tests = []
        for b in set(around) - {a}:
            k, n = around.count(b), len(around)
            tail = sum(math.comb(count[b], j) * math.comb(total - count[b], n - j) for j in range(k, min(count[b], n) + 1)) / math.comb(total, n)
            enrichment = (k / n) / (count[b] / total)
            tests.append((tail, b, k, enrichment))
        tests.sort()
        q = 1.0
        for rank in range(len(tests), 0, -1):
            p, b, k, enrichment = tests[rank - 1]
            q = min(q, p * len(tests) / rank)
            raw[a, b] = (q, -enrichment, k)
    worst = {}
    for (a, b), (q, less, _) in raw.items():  # of both directions the worse
        pair = frozenset((a, b))
        if pair not in worst or (q, less) > worst[pair][0]:
            worst[pair] = ((q, less), a, b)
    want = {(a, b): raw[a, b] for (q, _), a, b in worst.values() if q < 1e-5}
    got = {(r["gene_A"], r["gene_B"]): r for r in own.queries()["final_rows"](spark, str(tmp_path)).collect()}
    assert len(raw) > 2 * len(want) > 0
    assert {frozenset(pair) for pair in got} == {frozenset(pair) for pair in want}
    for (a, b), r in got.items():
        q, less, k = raw[a, b]
        assert (r["gene_B_around"], r["qvalue_BH"], r["enrichment_ratio"]) == pytest.approx((k, q, -less), abs=1e-8)
        assert (q, less) == pytest.approx(worst[frozenset((a, b))][0], rel=1e-9)
