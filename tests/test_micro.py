"""The hand-sized data set: 12 points in three cells, with a pair at exactly the radius, equal points, and a gap in z."""

import pytest

from vicinal.config import RunConfig
from vicinal.operators import background, distances, events, neighbors, prep, results, tiles
from vicinal.plans import analysis
from vicinal.sources.transcripts import pair_table

ROWS = [
    (0.0, 0.0, 0.0, "A", "c1"), (0.3, 0.4, 0.0, "B", "c1"), (0.3, 0.4, 0.0, "B", "c1"), (0.6, 0.8, 0.0, "B", "c1"),
    (0.0, 0.1, 0.2, "B", "c1"), (0.1, 0.0, 0.0, "A", "c1"), (0.0, 0.0, 0.0, "C", "c1"), (5.0, 5.0, 0.0, "A", "c2"),
    (5.0, 5.2, 0.0, "C", "c2"), (9.0, 9.0, 0.0, "B", "c2"), (2.0, 2.0, 0.0, "B", "c3"), (2.0, 2.1, 0.0, "C", "c3"),
]
PAIRS = ["AB", "AC", "BA", "BC", "CA", "CB"]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(ROWS, "x double, y double, z double, geneID string, cell string").cache()


def n_and_k(near, identity):
    n = {r["A"]: r["n"] for r in neighbors.around(near, identity).collect()}
    k = {r["A"] + r["B"]: r["k"] for r in neighbors.pair_counts(near, identity).collect()}
    return [n[g] for g in "ABC"], [k.get(p, 0) for p in PAIRS]


@pytest.mark.parametrize(
    ("metric", "reach", "z_mode", "identity", "n", "k"),
    [
        ("radius", 0.5, "discrete", "row", [7, 10, 9], [2, 2, 2, 2, 3, 3]),
        ("radius", 0.5, "discrete", "value", [6, 9, 8], [1, 2, 2, 2, 3, 2]),
        ("radius", 0.5, "continuous", "row", [8, 10, 10], [3, 2, 2, 2, 3, 4]),
        ("grid", 1.0, "discrete", "pixel", [6, 8, 8], [2, 2, 2, 2, 3, 3]),
    ],
)
def test_neighbours(points, metric, reach, z_mode, identity, n, k):
    assert n_and_k(neighbors.near_genes(points, reach, metric, z_mode), identity) == (n, k)


@pytest.mark.parametrize(
    ("metric", "reach", "length", "n", "k"),
    [
        ("radius", 0.5, 20.0, [7, 9, 9], [2, 2, 2, 2, 3, 3]),
        ("radius", 0.5, 1.0, [13, 15, 13], [2, 5, 2, 5, 4, 4]),
        ("grid", 1.0, 1.0, [13, 14, 13], [3, 5, 2, 5, 4, 5]),
    ],
)
def test_tiles(points, metric, reach, length, n, k):
    wide, core = tiles.tiled(points, length, reach)
    near = neighbors.near_genes(wide, reach, metric, centres=core)
    assert n_and_k(near, "pixel" if metric == "grid" else "value") == (n, k)


def test_totals(points):
    assert prep.slice_total(points).first()[0] == 12
    pixels = prep.pixel_distinct(points)
    assert prep.slice_total(pixels, pixels=True).first()[0] == 10
    assert {r["geneID"]: r["n"] for r in prep.gene_counts(pixels).collect()} == {"A": 3, "B": 5, "C": 3}


@pytest.mark.parametrize(
    ("method", "expected"),
    [
        ({"r_check": 0.5}, {"AB": (1, 6, 5, 10, 3), "AC": (2, 6, 2, 10, 3), "BA": (2, 7, 3, 10, 5), "BC": (2, 9, 3, 12, 6), "CA": (3, 6, 3, 10, 2), "CB": (2, 8, 6, 12, 3)}),
        ({"detection_method": "nine_grid", "grid_check": 1}, {"AB": (2, 6, 4, 8, 3), "AC": (2, 6, 2, 8, 3), "BA": (2, 6, 3, 8, 4), "BC": (2, 8, 3, 10, 5), "CA": (3, 6, 3, 8, 2), "CB": (3, 8, 5, 10, 3)}),
    ],
)
def test_cooccurrence(points, method, expected):
    config = RunConfig(background="cooccurrence", min_gene_number=1, **method)
    own = analysis.prepared(points, config)
    counts = analysis.pair_background(own, analysis.near_of(own, config, config.reach), config)
    got = {r["gene_A"] + r["gene_B"]: tuple(r[c] for c in ("gene_B_around", "gene_around", "gene_B_slice", "gene_slice", "gene_A_N")) for r in counts.collect()}
    assert got == expected


def test_full_result(points):
    config = RunConfig(r_check=0.5, min_gene_number=1, filter_threshold=1.01)
    raw = analysis.raw_result(points, config)
    got = {r["gene_A"] + r["gene_B"]: tuple(round(r[c], 6) for c in ("pvalue", "qvalue_BH", "qvalue_BO", "enrichment_ratio", "support_ratio")) for r in raw.collect()}
    assert got == {
        "AB": (0.992424, 0.992424, 1.0, 0.571429, 0.666667), "AC": (0.636364, 0.992424, 1.0, 1.142857, 0.666667),
        "BA": (0.954545, 0.954545, 1.0, 0.8, 0.666667), "BC": (0.954545, 0.954545, 1.0, 0.8, 0.666667),
        "CA": (0.381818, 0.763636, 0.763636, 1.333333, 1.0), "CB": (1.0, 1.0, 1.0, 0.666667, 1.0),
    }
    order = lambda keep: [r["gene_A"] + r["gene_B"] for r in results.ordered(results.one_direction(raw, keep)).collect()]
    assert sorted(order("last")) == sorted(["AC", "AB", "CB"])
    assert order("first") == ["CA", "BA", "BC"]


def test_full_cooccurrence(points):
    raw = analysis.raw_result(points, RunConfig(r_check=0.5, min_gene_number=1, background="cooccurrence"))
    got = {r["gene_A"] + r["gene_B"]: (round(r["pvalue"], 6), round(r["qvalue_BH"], 6)) for r in raw.collect()}
    assert got == {"AB": (1.0, 1.0), "AC": (0.333333, 0.666667), "BA": (0.816667, 0.872727), "BC": (0.872727, 0.872727), "CA": (0.166667, 0.333333), "CB": (1.0, 1.0)}
    assert {r["gene_A"] + r["gene_B"]: r["support_ratio"] for r in raw.collect()}["CA"] == 1.5


def test_events(spark, points):
    pairs = pair_table(spark, [("B", "A")])
    rows = {r["cell"]: r for r in events.cell_events(points, pairs, 0.5).collect()}
    assert {c: r["colocalization_count"] for c, r in rows.items()} == {"c1": 4, "c2": 0, "c3": 0}
    assert {c: (r["gene_A_count"], r["gene_B_count"]) for c, r in rows.items()} == {"c1": (2, 4), "c2": (1, 1), "c3": (0, 1)}
    assert {c: (r["cell_x"], r["cell_y"]) for c, r in rows.items()} == {"c1": (0.1, 0.1), "c2": (5.0, 5.2), "c3": (2.0, 2.05)}
    assert {r["cell"]: r["colocalization_count"] for r in events.cell_events(points, pairs, 0.5, "continuous").collect()}["c1"] == 6


def test_distances(points):
    got = sorted(round(r["distance"], 6) for r in distances.distances(points, 1.0).where("gene_A = 'A' AND gene_B = 'B'").collect())
    assert got == [0.447214, 0.447214, 0.5, 0.5, 0.943398, 1.0]


def test_several_radii(points):
    both = analysis.raw_result(points, RunConfig(r_check=(0.5, 1.0), min_gene_number=1))
    for radius in (0.5, 1.0):
        alone = analysis.raw_result(points, RunConfig(r_check=radius, min_gene_number=1))
        assert sorted(alone.collect()) == sorted(both.where(f"r_check = {radius}").drop("r_check").collect())


def test_empty(points):
    raw = analysis.raw_result(points.where("false"), RunConfig(r_check=0.5))
    assert raw.columns == results.ORDER and raw.count() == 0
    assert background.COUNTS[0] == "gene_A"
