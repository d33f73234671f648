"""Proportional stratified interleaving of documents into shards.

Rows are ranked by a seeded hash within their source, then ordered by fractional rank ``(rank - u) / n`` (``u``: a
fixed offset of the source between 0 and 1, so that small sources do not pile up at one fraction), and the order is
cut into equal runs. Each run holds every source in its share of the whole; row counts differ by one at most.

No window runs over a whole source or over the whole table. Ranks come from windows over small hash buckets plus
prefix sums of the buckets' counts, so a source with a third of all rows is spread over as many tasks as any other.

Defined cases: a null source is a stratum of its own; a null text has 0 bytes; null ids take part; repeated rows each
get a place of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows aimed at in one window bucket, and bucket counts summed by one task of a prefix sum.
BUCKET_ROWS, FAN = 500, 4096


def prefix_sums(counts: DataFrame, group: str | None, index: str, n: str) -> DataFrame:
    """counts with column ``before``: the sum of n over smaller indexes of the group. In two levels of FAN buckets."""
    keys = [group] if group else []
    fine = counts.withColumn("_top", F.floor(F.col(index) / FAN))
    inner = Window.partitionBy(*keys, "_top").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    tops = fine.groupBy(*keys, "_top").agg(F.sum(n).alias("_top_n"))
    outer = Window.partitionBy(*keys).orderBy("_top").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("_top_before", F.coalesce(F.sum("_top_n").over(outer), F.lit(0))).drop("_top_n")
    return (
        fine.withColumn("_in", F.coalesce(F.sum(n).over(inner), F.lit(0)))
        .join(tops, [*keys, "_top"])
        .withColumn("before", F.col("_in") + F.col("_top_before"))
        .drop("_in", "_top", "_top_before")
    )


def _unit(hexed: Column) -> Column:
    """A number strictly between 0 and 1 from the first 32 bits of a hex digest."""
    return (F.conv(F.substring(hexed, 1, 8), 16, 10).cast("double") + 1) / F.lit(4294967298.0)


def assign_shards(
    docs: DataFrame,
    n_shards: int = 40,
    seed: str = "0",
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """A row for each row of docs: id, size, text_crc32, shard, slot. The text itself is never shuffled."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_column)), F.lit("n")).alias("_stratum"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).cast("binary")).alias("_key"),
    )
    total = docs.count()
    digits = min(8, max(1, math.ceil(math.log(max(total, 1) / BUCKET_ROWS, 16)))) if total > BUCKET_ROWS else 1
    rows = rows.withColumn("_bucket", F.conv(F.substring("_key", 1, digits), 16, 10).cast("long"))
    tie = ["_key", "doc_id", "text_crc32", "size"]

    counts = rows.groupBy("_stratum", "_bucket").agg(F.count("*").alias("_n"))
    sums = prefix_sums(counts, "_stratum", "_bucket", "_n")
    sizes = counts.groupBy("_stratum").agg(F.sum("_n").alias("_size"))
    offsets = sums.join(sizes, "_stratum").select("_stratum", "_bucket", "before", "_size")
    ranked = (
        rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_stratum", "_bucket").orderBy(*tie)))
        .join(offsets, ["_stratum", "_bucket"])
        .withColumn("_fraction", (F.col("before") + F.col("_rank") - _unit(F.md5(F.col("_stratum").cast("binary")))) / F.col("_size"))
        .select("doc_id", "size", "text_crc32", "_stratum", "_key", "_fraction")
    )
    slices = max(1, total // BUCKET_ROWS)
    ranked = ranked.withColumn("_slice", F.floor(F.col("_fraction") * slices))
    places = prefix_sums(ranked.groupBy("_slice").agg(F.count("*").alias("_n")), None, "_slice", "_n").select("_slice", "before")
    order = Window.partitionBy("_slice").orderBy("_fraction", "_stratum", *tie)
    placed = (
        ranked.withColumn("_row", F.row_number().over(order))
        .join(places, "_slice")
        .withColumn("_place", F.col("before") + F.col("_row") - 1)
        .withColumn("shard", F.expr(f"int(_place * {n_shards} div {max(total, 1)})"))
    )
    first = F.expr(f"(shard * bigint({total}) + {n_shards - 1}) div {n_shards}")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("_place") - first).alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, seed: str = "0") -> DataFrame:
    """Write docs as Parquet, one folder a shard, and return what assign_shards() says. Ids must be unique here, and no column named shard or slot."""
    if {"shard", "slot"} & set(docs.columns):
        raise ValueError("docs has a column named shard or slot")
    shards = assign_shards(docs, n_shards, seed)
    placed = docs.join(shards.select("doc_id", "shard", "slot"), "doc_id")
    placed.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return shards
