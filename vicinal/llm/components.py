"""Connected components by alternating large-star and small-star steps; no group of neighbours is ever collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

SALTS = 8


def salted_join(large: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """large joined to small, which has each key once, with every key of large dealt over ``salts`` tasks.

    Merged, never broadcast: the copies compress so well that the planner would take small for smaller than it is.
    """
    dealt = large.withColumn("_salt", F.pmod(F.xxhash64(*large.columns), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return salted_join(both.where("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = salted_join(down, least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, root) for every node that has an edge; root is the component's smallest node. Written."""
    own = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = written(own, "stars"), None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (mark["n"], mark["h"]) == seen:
            break
        seen = (mark["n"], mark["h"])
        then = written(_small_star(_large_star(now)), "stars")
        drop_written(now)
        now = then
    out = written(now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "roots")
    drop_written(now)
    return out
