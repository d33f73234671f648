from fractions import Fraction
from math import comb

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vicinal.functions import stats
from vicinal.operators.results import with_ratios


def exact(k, total, marked, drawn):
    return float(sum(Fraction(comb(marked, j) * comb(total - marked, drawn - j), comb(total, drawn)) for j in range(max(k, 0), min(marked, drawn) + 1) if drawn - j <= total - marked))


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 120), st.data())
def test_tail_is_exact(total, data):
    marked, drawn = data.draw(st.integers(0, total)), data.draw(st.integers(0, total))
    k = data.draw(st.integers(0, total + 1))
    assert stats.hypergeom_tail([k], [total], [marked], [drawn])[0] == pytest.approx(exact(k, total, marked, drawn), rel=1e-10, abs=1e-300)


def test_published_row(spark):
    assert stats.hypergeom_tail([451], [643013], [5932], [9697])[0] == pytest.approx(3.546414862483246e-170, rel=1e-9)
    row = spark.createDataFrame([("Clu", "Apoe", 0.0, 0.0, 0.0, 451, 5932, 9697, 643013, 3729, 5932)], "gene_A string, gene_B string, pvalue double, qvalue_BH double, qvalue_BO double, gene_B_around long, gene_B_slice long, gene_around long, gene_slice long, gene_A_N long, gene_B_N long")
    got = with_ratios(row).first()
    assert (got["enrichment_ratio"], got["support_ratio"], got["pair"]) == (5.04147661674009, 0.12094395280235988, "Apoe_Clu")


def test_impossible_counts():
    assert np.isnan(stats.hypergeom_tail([1, 1], [5, 5], [6, 2], [2, 6])).all()
    assert stats.hypergeom_tail([0, 4], [10, 10], [3, 3], [3, 3]).tolist() == [1.0, 0.0]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("xyz"), st.floats(0, 1)), min_size=1, max_size=25))
def test_step_up_by_gene(spark, rows):
    rows = [(g, f"b{i:02d}", p) for i, (g, p) in enumerate(rows)]
    got = {r["gene_B"]: (r["qvalue_BH"], r["qvalue_BO"]) for r in stats.adjusted(spark.createDataFrame(rows, "gene_A string, gene_B string, pvalue double")).collect()}
    for gene in "xyz":
        own = sorted((p, b) for g, b, p in rows if g == gene)
        q = 1.0
        for rank in range(len(own), 0, -1):
            p, b = own[rank - 1]
            q = min(q, p * len(own) / rank)
            assert got[b] == pytest.approx((q, min(1.0, p * len(own))), rel=1e-12)


def test_nan_spoils_its_gene(spark):
    rows = [("x", "a", float("nan")), ("x", "b", 0.1), ("y", "c", 0.1)]
    got = {r["gene_B"]: r["qvalue_BH"] for r in stats.adjusted(spark.createDataFrame(rows, "gene_A string, gene_B string, pvalue double")).collect()}
    assert np.isnan(got["a"]) and np.isnan(got["b"]) and got["c"] == 0.1


def test_mode_of_a_peak():
    values = np.concatenate([np.full(200, 0.3) + np.linspace(-0.01, 0.01, 200), np.linspace(0, 1, 50)])
    grid, density = stats.kde_curve(values)
    assert abs(grid[density.argmax()] - 0.3) < 0.02
    assert np.trapezoid(density, grid) == pytest.approx(1, abs=0.05)
