"""Points that arrive as a stream.

Counts by gene or by cell and gene are plain streaming aggregates. Neighbour counts are distinct counts and corrections
need the whole table, so tests stay with batch runs; per-cell events can follow a stream whose files each hold whole
cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import cell_events

SCHEMA = "x double, y double, z double, geneID string, cell string"


def read_stream(spark: SparkSession, path: str, files_a_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    reader = spark.readStream.schema(SCHEMA)
    if files_a_trigger:
        reader = reader.option("maxFilesPerTrigger", files_a_trigger)
    return reader.parquet(path)


def running_counts(stream: DataFrame, by_cell: bool = False) -> DataFrame:
    """Points so far of each gene, or of each cell and gene; for update or complete mode."""
    return stream.groupBy(*(["cell", "geneID"] if by_cell else ["geneID"])).agg(F.count("*").alias("n"))


def write_events(stream: DataFrame, pairs: DataFrame, reach: float, path: str, checkpoint: str, z_mode: str = "discrete") -> StreamingQuery:
    """Events of each batch's cells under path, a folder a batch: a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        cell_events(batch, pairs, reach, z_mode).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
