"""Distances between the points of two genes, their export, and the shape of their distribution."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import kernel_sums
from ..sources import sinks
from .neighbors import met

#: Distances aimed at in one bucket of a pair.
BUCKET_ROWS = 20_000
#: Parts, at least, of a pair whose quantiles are sought: what a round keeps is the few that hold a wanted rank.
PARTS = 256
#: Points of the grid on which a mode is sought, its bandwidth in sample deviations.
MODE_POINTS, MODE_BANDWIDTH = 1000, 0.05
#: Drawn places sent on at once.
DRAWN = 50_000
PAIR = ["gene_A", "gene_B"]


def _kept(table: DataFrame, name: str) -> DataFrame:
    """table, written once to the shared folder."""
    return sinks.staged(table, sinks.shared_path(table.sparkSession, name))


def distances(points: DataFrame, reach: float, pairs: DataFrame | None = None) -> DataFrame:
    """gene_A, gene_B (gene_A < gene_B), distance of every two rows of a cell and z layer within reach.

    pairs (gene_A, gene_B in either order) limits the search to what is asked for before any distance is computed.
    """
    if pairs is not None:
        wanted = pairs.select(F.least("gene_A", "gene_B").alias("A"), F.greatest("gene_A", "gene_B").alias("B")).distinct()
        genes = wanted.select(F.col("A").alias("geneID")).union(wanted.select("B")).distinct()
        points = points.join(genes, "geneID", "left_semi")
    found = met(points, reach).where("A < geneID")
    found = found.withColumnRenamed("geneID", "B")
    if pairs is not None:
        found = found.join(wanted, ["A", "B"], "left_semi")
    times = F.col("m") * F.col("m_a")
    once = found.select("A", "B", F.sqrt("near").alias("distance"), times.alias("_times"))
    each = once.withColumn("_times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return each.select(F.col("A").alias("gene_A"), F.col("B").alias("gene_B"), "distance")


def directed(undirected: DataFrame) -> DataFrame:
    """Both directions of a symmetric table."""
    turned = undirected.select(F.col("gene_B").alias("gene_A"), F.col("gene_A").alias("gene_B"), *[c for c in undirected.columns if c not in ("gene_A", "gene_B")])
    return undirected.unionByName(turned)


def placed(found: DataFrame, keys: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """found's keys and distance with ``place``, its number from 0 in order of distance within its keys.

    Equal distances are counted first. No window runs over a whole pair: places are counted within buckets of distance and
    added to the number of rows in the buckets before.
    """
    groups = found.groupBy(*keys, "distance").agg(F.count("*").alias("_n"))
    extent = groups.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.max("distance").alias("_far"))
    parts = F.ceil(F.col("_total") / bucket_rows)
    groups = groups.join(extent, keys).withColumn("_bucket", F.when(F.col("_far") > 0, F.floor(F.col("distance") / F.col("_far") * parts)).otherwise(0))
    before = _before(groups, keys, "_bucket", F.sum("_n"))
    inner = Window.partitionBy(*keys, "_bucket").orderBy("distance").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_n").over(inner), F.lit(0)) + F.col("_before")
    spans = groups.join(before, [*keys, "_bucket"]).withColumn("_start", start)
    return spans.select(*keys, "distance", F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col("_n") - 1)).alias("place"))


def _before(rows: DataFrame, keys: list[str], bucket: str, number) -> DataFrame:
    """keys, bucket, ``_held`` (number of rows in it) and ``_before`` (in the buckets before it): a window over buckets alone."""
    order = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, bucket).agg(number.alias("_held"))
    return counts.withColumn("_before", F.coalesce(F.sum("_held").over(order), F.lit(0)))


def spot(keys: list[str], rank: str) -> Column:
    """A number from 0 to 2 ** 60 for a rank of a pair: the first 15 digits of the MD5 of names and rank."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *keys, F.col(rank).cast("string"))), 1, 15), 16, 10).cast("long")


def sampled(found: DataFrame, most: int | None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """found with ``count`` of its pair; of pairs with more than ``most`` distances so many by a fixed hash of rank and names.

    Only pairs above the bound are ranked, in buckets of distance and of hash; the sample is the feature here.
    """
    keys = ["gene_A", "gene_B"]
    counts = sinks.lookup(found.groupBy(*keys).agg(F.count("*").alias("count")), "pair-counts")
    own = found.join(counts, keys)
    if most is None:
        return own
    ranked = placed(found.join(counts.where(F.col("count") > most).select(keys), keys, "left_semi"), keys, bucket_rows).withColumn("_rank", (F.col("place") + 1).cast("int"))
    ranked = ranked.join(counts, keys).withColumn("_spot", spot(keys, "_rank"))
    share = F.col("_spot") / F.lit(2.0**60)
    ranked = ranked.withColumn("_bucket", F.floor(share * F.ceil(F.col("count") / bucket_rows)))
    ranked = ranked.join(_before(ranked, keys, "_bucket", F.count("*")), [*keys, "_bucket"]).where(F.col("_before") < most)
    inner = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_spot", "_rank"))
    chosen = ranked.withColumn("_in", inner).where(F.col("_before") + F.col("_in") <= most)
    return own.where(F.col("count") <= most).unionByName(chosen.select(own.columns))


def shapes(found: DataFrame, least: int = 100, most: int | None = 10_000, mode: bool = True, bucket_rows: int = BUCKET_ROWS, keep=_kept) -> DataFrame:
    """gene_A, gene_B, shape_count, mode, skewness, kurtosis (population), median, q25, q75, iqr of pairs with enough distances.

    Moments are partial aggregates. Quantiles are an aggregate of their own for pairs of at most ``bucket_rows`` distances and are selected
    by rank for the others (quantiles()); modes come from kernel sums (modes()). So no task holds a pair. found is read several times
    and should be a written table; what modes read several times, keep (table, name) -> table writes.
    """
    own = sampled(found, most).where(F.col("count") >= least)
    some_large = most is None or most > bucket_rows
    if mode:
        own = keep(own, "shape-distances")
    out = own.groupBy(*PAIR).agg(F.max("count").alias("shape_count"), F.skewness("distance").alias("skewness"), F.kurtosis("distance").alias("kurtosis"))
    small = own.where(F.col("count") <= bucket_rows) if some_large else own
    q = small.groupBy(*PAIR).agg(F.percentile("distance", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    large = own.where(F.col("count") > bucket_rows)
    if some_large and not large.isEmpty():
        q = q.unionByName(quantiles(large.select(*PAIR, "distance"), PAIR, (0.25, 0.5, 0.75), bucket_rows).withColumnRenamed("q", "_q"))
    out = out.join(q, PAIR)
    out = out.select(*PAIR, "shape_count", "skewness", "kurtosis", F.col("_q")[1].alias("median"), F.col("_q")[0].alias("q25"), F.col("_q")[2].alias("q75"), (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"))
    if not mode:
        return out
    return out.join(modes(own), PAIR).select(*PAIR, "shape_count", "mode", "skewness", "kurtosis", "median", "q25", "q75", "iqr")


def modes(found: DataFrame, points: int = MODE_POINTS, bandwidth: float = MODE_BANDWIDTH) -> DataFrame:
    """gene_A, gene_B, mode: the point, of an even grid from a pair's least distance to its greatest, where a Gaussian KDE is greatest, the
    first of equal ones. The least distance where a pair has no spread. found is read twice and should be a written table."""
    facts = sinks.lookup(found.groupBy(*PAIR).agg(F.min("distance").alias("_lo"), F.max("distance").alias("_hi"), F.stddev_samp("distance").alias("_s")), "mode-facts")
    step = (F.col("_hi") - F.col("_lo")) / (points - 1)
    spread = F.col("_s") > 0
    rows = found.select(*PAIR, "distance").join(facts.where(spread), PAIR)
    rows = rows.select(*PAIR, ((F.col("distance") - F.col("_lo")) / step).alias("spot"), (bandwidth * F.col("_s") / step).alias("bandwidth"), F.lit(1.0).alias("times"), F.array("_lo", "_hi").alias("facts"))

    def highest(sums: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"mode": [float(np.linspace(ends[0], ends[1], points)[int(sums.argmax())])]})

    flat = facts.where(~F.coalesce(spread, F.lit(False))).select(*PAIR, F.col("_lo").alias("mode"))
    return kernel_sums(rows, PAIR, points, highest, "mode double").unionByName(flat)


def quantiles(found: DataFrame, keys: list[str], shares: tuple[float, ...], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """keys and q, the exact quantiles (interpolated as F.percentile does) of ``distance`` for groups of any size.

    Groups above ``bucket_rows`` are cut into buckets of equal width, counted, and only the buckets that hold a wanted rank are kept, again
    and again until none is too large or all its distances are equal. Then ranks are counted within buckets. found should be a
    written table; what each round keeps is written, too.
    """
    sizes = found.groupBy(*keys).agg(F.count("*").alias("_n"))
    places = [F.lit(share) * (F.col("_n") - 1) for share in shares]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in places])))
    wanted = _kept(sizes.select(*keys, F.explode(ranks).alias("_rank"), F.lit(0).cast("long").alias("_base")), "wanted-ranks")
    rows = found.select(*keys, "distance", F.lit(0).cast("long").alias("_base"))  # _base: rank of a bucket's first row, its name
    own = [*keys, "_base"]
    while True:
        groups = sinks.lookup(rows.groupBy(*own).agg(F.count("*").alias("_n"), F.min("distance").alias("_lo"), F.max("distance").alias("_hi")), "rank-buckets")
        crowded = (F.col("_n") > bucket_rows) & (F.col("_hi") > F.col("_lo"))
        if groups.where(crowded).isEmpty():
            break
        parts = F.when(crowded, F.greatest(F.ceil(F.col("_n") / bucket_rows), F.lit(PARTS))).otherwise(1)
        cut = F.when(parts == 1, 0).otherwise(F.least(F.floor((F.col("distance") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * parts), parts - 1))
        dealt = rows.join(groups, own).select(*own, "distance", cut.alias("_bucket"))
        counts = _before(dealt, own, "_bucket", F.count("*")).withColumn("_from", F.col("_base") + F.col("_before"))
        inside = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_held"))
        met = _kept(wanted.join(counts, own).where(inside).select(*own, "_rank", "_bucket", "_from"), "rank-places")
        rows = _kept(dealt.join(sinks.lookup(met.select(*own, "_bucket", "_from").distinct(), "rank-kept"), [*own, "_bucket"]).select(*keys, "distance", F.col("_from").alias("_base")), "rank-rows")
        wanted = met.select(*keys, "_rank", F.col("_from").alias("_base"))
    counted = rows.groupBy(*own, "distance").agg(F.count("*").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(*own).orderBy("distance").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counted.withColumn("_from", F.col("_base") + before)
    inside = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_m"))
    values = wanted.join(spans, own).where(inside).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "distance"))).alias("_v"))

    def between(p):
        low, high = F.col("_v")[F.floor(p)], F.col("_v")[F.ceil(p)]
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return values.join(sizes, keys).select(*keys, F.array(*[between(p) for p in places]).alias("q"))


def relative(shape: DataFrame, reach: float) -> DataFrame:
    """shape with what it differs by from uniform points in a disk of that radius. The five numbers are fixed values."""
    return shape.withColumns(
        {
            "skewness_adjusted": 1 / (1 + F.exp("skewness")),
            "skewness_relative": F.col("skewness") + 0.566,
            "kurtosis_relative": F.col("kurtosis") + 0.6,
            "median_relative": F.col("median") - 0.707 * reach,
            "q25_relative": F.col("q25") - 0.5 * reach,
            "q75_relative": F.col("q75") - 0.866 * reach,
        }
    )


def with_shapes(results: DataFrame, shape: DataFrame) -> DataFrame:
    return results.join(shape, ["gene_A", "gene_B"], "left")


def summary(found: DataFrame, pairs: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """ordinal, gene_1, gene_2, pair, total_distance_count, output_distance_count, status of each requested pair."""
    counts = found.groupBy(F.col("gene_A").alias("gene_1"), F.col("gene_B").alias("gene_2")).agg(F.count("*").alias("total"))
    total = F.coalesce("total", F.lit(0).cast("long"))
    over = F.lit(False) if most is None else total > most
    status = F.when(total == 0, "not_found").when(total < least, "below_minimum").when(over, "sampled").otherwise("complete")
    out = F.when(status.isin("not_found", "below_minimum"), 0).when(status == "sampled", most if most is not None else 0).otherwise(total)
    joined = pairs.join(counts, ["gene_1", "gene_2"], "left")
    return joined.select("ordinal", "gene_1", "gene_2", F.concat_ws("_", "gene_1", "gene_2").alias("pair"), total.alias("total_distance_count"), out.cast("long").alias("output_distance_count"), status.alias("status"))


def pair_seed(seed: int, pair: tuple[str, str]) -> int:
    return int.from_bytes(hashlib.sha256("\0".join([str(seed), *pair]).encode()).digest()[:8], "big")


def drawn_places(sampled_pairs: DataFrame, most: int, seed: int) -> DataFrame:
    """gene_1, gene_2, place: for each pair (with total_distance_count) the ``most`` places that a generator seeded by the pair draws, made where the
    pair's row is. A worker holds the places of one pair."""

    def run(batches):
        for batch in batches:
            for gene_1, gene_2, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                places = sorted(random.Random(pair_seed(seed, (gene_1, gene_2))).sample(range(total), most))
                for k in range(0, most, DRAWN):
                    part = places[k : k + DRAWN]
                    yield pa.RecordBatch.from_arrays([pa.array([gene_1] * len(part), pa.string()), pa.array([gene_2] * len(part), pa.string()), pa.array(part, pa.int64())], ["gene_1", "gene_2", "place"])

    return sampled_pairs.select("gene_1", "gene_2", "total_distance_count").mapInArrow(run, "gene_1 string, gene_2 string, place long")


def export(found: DataFrame, pairs: DataFrame, least: int = 1, most: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(gene_1, gene_2, pair, distance), summary. Of a pair with more than ``most`` distances the places that a generator
    seeded by the pair draws, places being counted in order of distance. Nothing of a request is listed in the driver."""
    report = summary(found, pairs, least, most)
    own = found.select(F.col("gene_A").alias("gene_1"), F.col("gene_B").alias("gene_2"), "distance").join(
        report.where("status IN ('complete', 'sampled')").select("gene_1", "gene_2", "pair", "status"), ["gene_1", "gene_2"]
    )
    columns = ["gene_1", "gene_2", "pair", "distance"]
    whole = own.where("status = 'complete'").select(columns)
    if most is None:
        return whole, report
    places = drawn_places(report.where("status = 'sampled'"), most, seed)
    ranked = placed(own.where("status = 'sampled'"), ["gene_1", "gene_2", "pair"])
    return whole.unionByName(ranked.join(places, ["gene_1", "gene_2", "place"]).select(columns)), report
