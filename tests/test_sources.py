import pytest

from vicinal import cli
from vicinal.config import RunConfig, check_radii, radius_token, with_radius
from vicinal.operators import controls, distances
from vicinal.sources import sinks, transcripts


def write(tmp_path, text, name="in.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_scan(spark, tmp_path):
    path = write(tmp_path, "gx,gy,gz,gene,cell,extra\n1,2,0,NA,c1,9\n1.5,2,0,null,c2,9\n")
    rows = transcripts.read_points(spark, path, "gx,gy,gz,gene,cell").collect()
    assert [tuple(r) for r in rows] == [(1.0, 2.0, 0.0, "NA", "c1"), (1.5, 2.0, 0.0, "null", "c2")]
    assert transcripts.read_points(spark, path, "gx,gy,gene,cell").first()["z"] == 0.0
    assert "cell" not in transcripts.read_points(spark, path, "gx,gy,gene", unsegmented=True).columns


@pytest.mark.parametrize("text", ["x,y,z,geneID,cell\n1,,0,A,c\n", "x,y,z,geneID,cell\n1,2,0,,c\n", "x,y,z,geneID,cell\nnan,2,0,A,c\n", 'x,y,z,geneID,cell\n1,2,0,"",c\n'])
def test_missing_values(spark, tmp_path, text):
    with pytest.raises(ValueError, match="missing"):
        transcripts.read_points(spark, write(tmp_path, text))


def test_wrong_columns(spark, tmp_path):
    path = write(tmp_path, "x,y,z,geneID,cell,more\n1,2,0,A,c,1\n")
    for names, unsegmented in (("x,y,geneID", False), ("x,y,z,geneID,cell,more", False), ("x,y,z,geneID", True), ("x,y,z,gone,cell", False), ("x,x,z,geneID,cell", False)):
        with pytest.raises(ValueError):
            transcripts.read_points(spark, path, names, unsegmented)


def test_pairs(spark, tmp_path):
    assert transcripts.canonical_pair("b", "a") == ("a", "b")
    for bad in (("a", "a"), ("", "a")):
        with pytest.raises(ValueError):
            transcripts.canonical_pair(*bad)
    table = transcripts.pair_table(spark, [("b", "a"), ("c", "a"), ("a", "b")])
    assert [tuple(r) for r in table.orderBy("ordinal").collect()] == [(0, "a", "b"), (1, "a", "c")]
    assert transcripts.read_pairs(spark, write(tmp_path, "gene_1,gene_2,w\nq,r,1\n")) == [("q", "r")]
    with pytest.raises(ValueError):
        transcripts.read_pairs(spark, write(tmp_path, "gene_A,gene_B\n"))


def test_pair_lists_above_the_list_bound(spark, tmp_path, monkeypatch):
    """A file with more rows than a list may have is numbered on the executors, in the order of the file, as a list would be."""
    from vicinal.plans import queries

    rows = [(f"g{i * 7919 % 1013}", f" h{i * 31 % 977}\u2003") for i in range(20_000)] + [("h1", "g0"), ("g0", "h1")]
    path = write(tmp_path, "gene_A,gene_B\n" + "".join(f"{a},{b}\n" for a, b in rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        found = transcripts.read_pair_table(spark, path)
        assert found.schema == transcripts.pair_table(spark, [("a", "b")]).schema
        assert [tuple(r) for r in found.orderBy("ordinal").collect()] == [tuple(r) for r in transcripts.pair_table(spark, rows).orderBy("ordinal").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for bad in ("gene_A,gene_B\n", "gene_A,gene_B\na,a\n", "gene_A,gene_B\na,\n"):
        with pytest.raises(ValueError):
            transcripts.read_pair_table(spark, write(tmp_path, bad))
    monkeypatch.setattr(transcripts.read_pairs, "__defaults__", (10,))  # the query took the bounded list before
    assert queries.scan_pairs(spark, "/root/testdata/sf0.001").count() > 10


def test_options():
    assert check_radii([2, 0.5]) == [0.5, 2.0]
    for bad in ([1, 1], [0], [-1], [float("inf")], None, []):
        with pytest.raises(ValueError):
            check_radii(bad)
    assert [radius_token(r) for r in (0.25, 2.0, 1e-5)] == ["0p25", "2", "1em05"]
    assert with_radius("out/a.csv", 0.25) == "out/a_r_0p25.csv"
    for bad in (
        {}, {"detection_method": "nine_grid"}, {"r_check": 1, "unsegmented": True, "background": "cooccurrence"}, {"r_check": 1, "pair_keep": "any"},
        {"r_check": 1, "distribution_analysis": True}, {"r_check": 1, "distribution_analysis": True, "r_dist": 1, "z_mode": "continuous"},
        {"r_check": 1, "shape_qvalue_threshold": 0}, {"r_check": 1, "shape_max_distance_count": 5}, {"r_check": 1, "mode": "robust", "distribution_analysis": True, "r_dist": 1},
    ):
        with pytest.raises(ValueError):
            RunConfig(**bad)


def test_names():
    assert sinks.final_path("r.csv", 1e-5) == "r_dedup_1e-05_post_proc.csv"
    assert sinks.final_path("r.csv", 0.01, True) == "r_dedup_0.01_post_proc_shape.csv"
    assert sinks.summary_path("a/d.csv.gz") == "a/d_summary.csv" and sinks.summary_path("d.parquet") == "d_summary.csv"
    assert sinks.export_format("d.csv.gz") == ("csv", "gzip")
    with pytest.raises(ValueError):
        sinks.export_format("d.txt")


def test_controls(spark):
    rows = [("Neg1", "B", 0.01, 2.0), ("B", "Neg1", 0.2, 1.0), ("A", "B", 0.001, 3.0), ("BlankX", "A", 0.9, 1.0)]
    raw = spark.createDataFrame([(a, b, q, min(a, b) + "_" + max(a, b), e) for a, b, q, e in rows], "gene_A string, gene_B string, qvalue_BH double, pair string, enrichment_ratio double")
    rules = [("neg", "prefix", "neg"), ("blank", "contains", "lank")]
    got = {(r[0], r[2]): (r[1], r[3], r[4], r[6]) for r in controls.control_baseline(raw, rules, [0.05, 1e-9], ignore_case=True).collect()}
    assert got[0.05, "neg"] == (1, 0, 0.0, 1) and got[0.05, "any_control"] == (1, 0, 0.0, 2) and got[1e-9, "blank"] == (0, 0, None, 1)
    first = {(r[0], r[2]): r[3] for r in controls.control_baseline(raw, rules, [0.05], "first", True).collect()}
    assert first[0.05, "neg"] == 1
    for bad in ([], [("any_control", "exact", "x")], [("g", "like", "x")], [("g", "exact", "")]):
        with pytest.raises(ValueError):
            controls.parse_rules(bad)


def test_export_is_reproducible(spark):
    import random

    found = spark.createDataFrame([("a", "b", float(i)) for i in range(50)] + [("a", "c", 1.0)], "gene_A string, gene_B string, distance double")
    pairs = transcripts.pair_table(spark, [("a", "b"), ("c", "a"), ("a", "z")])
    rows, report = distances.export(found, pairs, 2, 10, 3)
    assert [r["status"] for r in report.orderBy("ordinal").collect()] == ["sampled", "below_minimum", "not_found"]
    places = random.Random(distances.pair_seed(3, ("a", "b"))).sample(range(50), 10)
    assert sorted(r["distance"] for r in rows.collect()) == sorted(float(p) for p in places)


def test_command_line(spark, tmp_path):
    lines = ["x,y,z,geneID,cell"] + [f"{i % 7},{i % 5},0,{'ABC'[i % 3]},c{i % 2}" for i in range(60)]
    data, save = write(tmp_path, "\n".join(lines) + "\n"), str(tmp_path / "r.csv")
    args = ["run", "--detection_method", "radius", "--background", "cooccurrence", "--r_check", "1", "2", "--data_path", data, "--save_path", save, "--filter_threshold", "2", "--single_file"]
    parsed = cli.parser().parse_args(args)
    paths = parsed.call(parsed, spark)
    assert str(tmp_path / "r_r_1_dedup_2.0_post_proc.csv") in paths and all(spark.read.csv(p, header=True).count() for p in paths)
    parsed = cli.parser().parse_args(["events", "--data_path", data, "--save_path", str(tmp_path / "e.csv"), "--r_check", "1", "--pair", "A", "B"])
    parsed.call(parsed, spark)
    assert spark.read.csv(str(tmp_path / "e.csv"), header=True).count() == 2
    parsed = cli.parser().parse_args(["events", "--data_path", data, "--save_path", str(tmp_path / "e.csv"), "--r_check", "1", "--pair", "A", "gone"])
    with pytest.raises(ValueError, match="gone"):
        parsed.call(parsed, spark)
    parsed = cli.parser().parse_args(["controls", "--input", str(tmp_path / "r_r_1.csv"), "--save_path", str(tmp_path / "c.csv"), "--control", "g", "exact", "A", "--threshold", "0.5", "2"])
    assert parsed.call(parsed, spark).count() == 2
