"""Runs that are cut short: stages are taken up again, folders are published whole."""

import pytest

from vicinal import cli
from vicinal.operators import neighbors
from vicinal.plans import analysis
from vicinal.sources import sinks, stages, transcripts


@pytest.fixture
def arguments(spark, tmp_path):
    rows = [(i % 23 * 0.5, i % 17 * 0.5, float(i % 2), "ABCDE"[i * i % 5], f"c{i % 6}") for i in range(600)]
    data = str(tmp_path / "p.parquet")
    spark.createDataFrame(rows, "x double, y double, z double, geneID string, cell string").write.parquet(data)
    return ["run", "--detection_method", "radius", "--background", "all", "--r_check", "1", "--data_path", data, "--save_path", str(tmp_path / "r.csv"), "--filter_threshold", "2"]


def call(spark, arguments):
    parsed = cli.parser().parse_args(arguments)
    return parsed.call(parsed, spark)


def test_a_run_goes_on_after_its_raw_result(spark, tmp_path, arguments, monkeypatch):
    want = [sorted(map(str, spark.read.csv(p, header=True).collect())) for p in call(spark, [*arguments[:-3], str(tmp_path / "whole.csv"), *arguments[-2:]])]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(analysis, "results_of", lambda *a: (_ for _ in ()).throw(OSError("the driver is gone")))
        with pytest.raises(OSError, match="gone"):
            call(spark, arguments)
    assert (tmp_path / "r.csv.stage" / "raw" / "_SUCCESS").exists()
    monkeypatch.setattr(neighbors, "matched", lambda *a, **k: pytest.fail("searched again"))
    paths = call(spark, arguments)
    assert [sorted(map(str, spark.read.csv(p, header=True).collect())) for p in paths] == want
    assert not (tmp_path / "r.csv.stage").exists()


def test_stages_of_another_run_are_not_used(spark, tmp_path):
    table = spark.range(3).toDF("a")
    first = stages.Stages(spark, str(tmp_path / "s"), {"options": {"r": 1.0}, "input": [["p", 1, 2]]})
    assert first(table, "raw").count() == 3 and first.reused == []
    again = stages.Stages(spark, str(tmp_path / "s"), {"input": [["p", 1, 2]], "options": {"r": 1.0}})
    assert again(lambda: pytest.fail("planned again"), "raw").count() == 3 and again.reused == ["raw"]
    (tmp_path / "s" / "raw" / "_SUCCESS").unlink()  # as if it had not been committed
    assert again(lambda: spark.range(5).toDF("a"), "raw").count() == 5
    for other in ({"options": {"r": 2.0}, "input": [["p", 1, 2]]}, {"options": {"r": 2.0}, "input": [["p", 1, 3]]}):
        fresh = stages.Stages(spark, str(tmp_path / "s"), other)
        assert not fresh.whole("raw") and fresh(table, "raw").count() == 3
    fresh.close()
    assert not (tmp_path / "s").exists()


def test_fingerprints_follow_the_input(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("a\n1\n")
    before = stages.fingerprint(spark, str(path))
    assert before == stages.fingerprint(spark, str(path)) and len(before) == 1
    path.write_text("a\n12\n")
    assert stages.fingerprint(spark, str(path)) != before


@pytest.mark.parametrize("step", [1, 2])
def test_a_folder_is_old_or_new_but_never_mixed(spark, tmp_path, monkeypatch, step):
    """The publication fails at each of its two moves."""
    path = str(tmp_path / "f.csv")
    seen = lambda: sorted(r[0] for r in spark.read.csv(sinks.published(spark, path), header=True).collect())
    sinks.write_dataset(spark.createDataFrame([("old",)] * 3, "a string").repartition(3), path)
    assert seen() == ["old"] * 3
    moves, plain = [], sinks._rename

    def failing(*args):
        moves.append(args)
        if len(moves) == step:
            raise OSError("the driver is gone")
        plain(*args)

    monkeypatch.setattr(sinks, "_rename", failing)
    with pytest.raises(OSError, match="gone"):
        sinks.write_dataset(spark.createDataFrame([("new",)] * 2, "a string").repartition(2), path)
    monkeypatch.setattr(sinks, "_rename", plain)
    assert seen() == ["new"] * 2  # whole, from beside its place
    sinks.recover(spark, path)
    assert seen() == ["new"] * 2 and sinks.published(spark, path) == path
    sinks.write_dataset(spark.createDataFrame([("newer",)], "a string"), path)
    assert seen() == ["newer"]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["f.csv"]


def test_results_are_read_from_where_they_are_whole(spark, tmp_path, monkeypatch):
    columns = ", ".join(f"{c} {t}" for c, t in transcripts.RESULT)
    row = lambda gene: [(gene, "b", 0.1, 0.1, 0.1, 1, 2, 3, 4, 5, 6, "p", 1.0, 1.0)]
    path = str(tmp_path / "raw.csv")
    sinks.write_dataset(spark.createDataFrame(row("old"), columns), path)
    monkeypatch.setattr(sinks, "_complete", lambda *a: None)
    sinks.write_dataset(spark.createDataFrame(row("new"), columns), path)
    assert [r["gene_A"] for r in transcripts.read_result(spark, path).collect()] == ["new"]


def test_radii_without_cells_share_a_search(spark):
    rows = [(i * 0.37 % 9, i * 0.91 % 7, 0.0, "ABCD"[i * i % 7 % 4]) for i in range(300)]
    flat = spark.createDataFrame(rows, "x double, y double, z double, geneID string")
    make = lambda r: analysis.RunConfig(r_check=r, unsegmented=True, rect_length=3.0)
    together = analysis.raw_result(flat, make((0.2, 0.4, 0.9)))
    for r in (0.2, 0.4, 0.9):
        own = analysis.raw_result(flat, make(r))
        assert sorted(map(str, together.where(together.r_check == r).drop("r_check").collect())) == sorted(map(str, own.collect()))
