from vicinal.operators.events import cell_events
from vicinal.sources.transcripts import pair_table
from vicinal.streaming import points as streaming


def test_stream_of_cells(spark, tmp_path):
    rows = [((i % 7) * 0.5, (i % 5) * 0.5, 0.0, "AB"[i % 2], f"c{i // 20}") for i in range(80)]
    table = spark.createDataFrame(rows, streaming.SCHEMA)
    for c in range(4):  # whole cells, a file each
        table.where(f"cell = 'c{c}'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    pairs = pair_table(spark, [("A", "B")])
    stream = streaming.read_stream(spark, str(tmp_path / "in"), 1)
    streaming.write_events(stream, pairs, 1.0, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = cell_events(table, pairs, 1.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    counts = streaming.running_counts(streaming.read_stream(spark, str(tmp_path / "in"), 2))
    query = counts.writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["geneID"]: r["n"] for r in spark.table("running").collect()} == {"A": 40, "B": 40}
