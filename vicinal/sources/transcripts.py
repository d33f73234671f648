"""Scans of labelled points, gene pairs and raw results, with their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sinks

SEGMENTED = ("x", "y", "z", "geneID", "cell")
#: What str.strip() takes from a name.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
#: Columns of a raw result, in order.
RESULT = [
    ("gene_A", "string"), ("gene_B", "string"), ("pvalue", "double"), ("qvalue_BH", "double"), ("qvalue_BO", "double"),
    ("gene_B_around", "bigint"), ("gene_B_slice", "bigint"), ("gene_around", "bigint"), ("gene_slice", "bigint"),
    ("gene_A_N", "bigint"), ("gene_B_N", "bigint"), ("pair", "string"), ("enrichment_ratio", "double"), ("support_ratio", "double"),
]


def _columns(names: str | list[str], unsegmented: bool) -> dict[str, str]:
    """Canonical name -> header name, by position."""
    given = [n.strip() for n in names.split(",")] if isinstance(names, str) else list(names)
    if len(set(given)) < len(given):
        raise ValueError("a column is named twice")
    if unsegmented:
        wanted = ("x", "y", "geneID") if len(given) == 3 else None
    else:
        wanted = {5: SEGMENTED, 4: ("x", "y", "geneID", "cell")}.get(len(given))
    if wanted is None:
        raise ValueError("Invalid number of columns")
    return dict(zip(wanted, given, strict=True))


def shape_points(raw: DataFrame, names: str | list[str] = ",".join(SEGMENTED), unsegmented: bool = False) -> DataFrame:
    """x, y, z, geneID[, cell] from a table with any header names; z is 0 where there is none."""
    by = _columns(names, unsegmented)
    missing = [c for c in by.values() if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    number = lambda c: F.col(f"`{by[c]}`").cast("double").alias(c) if c in by else F.lit(0.0).alias(c)
    text = [F.col(f"`{by[c]}`").cast("string").alias(c) for c in ("geneID", "cell") if c in by]
    return raw.select(number("x"), number("y"), number("z"), *text)


def check_points(points: DataFrame, finite: bool = False) -> DataFrame:
    """Fail on nulls (an empty field, or nan in a coordinate); with finite also on infinities, empty ids and an empty table."""
    bad = F.lit(False)
    for name, kind in points.dtypes:
        bad = bad | F.col(name).isNull()
        if kind == "double":
            bad = bad | F.isnan(name)
            if finite:
                bad = bad | (F.abs(name) == float("inf"))
        elif finite:
            bad = bad | (F.trim(name) == "")
    row = points.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).first()
    if row["bad"]:
        raise ValueError("the input has missing values" if not finite else "the input has missing, empty or non-finite values")
    if finite and not row["n"]:
        raise ValueError("the input is empty")
    return points


def read_points(spark: SparkSession, path: str, names: str = ",".join(SEGMENTED), unsegmented: bool = False, finite: bool = False) -> DataFrame:
    """A checked scan of CSV (only the empty field is null; NA is a legal label) or Parquet; unused columns aren't read."""
    if path.rstrip("/").endswith(".parquet"):
        return check_points(shape_points(spark.read.parquet(path), names, unsegmented), finite)
    header = spark.read.csv(path, header=True, nullValue="").columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    raw = spark.read.schema(schema).csv(path, header=True, nullValue="", emptyValue="")
    by = _columns(names, unsegmented)
    missing = [c for c in by.values() if c not in header]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    for c in ("x", "y", "z"):
        if c in by:
            raw = raw.withColumn(by[c], F.expr(f"try_cast(`{by[c]}` AS double)"))
    return check_points(shape_points(raw, names, unsegmented), finite)


def canonical_pair(a: str, b: str) -> tuple[str, str]:
    """Two labels in order; neither empty, not equal."""
    a, b = (str(x).strip() for x in (a, b))
    if not a or not b:
        raise ValueError("a gene name is empty")
    if a == b:
        raise ValueError(f"a pair of {a} with itself")
    return (a, b) if a < b else (b, a)


def pair_table(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """Requested pairs as (ordinal, gene_1, gene_2): canonical, first mention only, in request order."""
    seen = dict.fromkeys(canonical_pair(a, b) for a, b in pairs)
    if not seen:
        raise ValueError("no gene pair is given")
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(seen)], "ordinal int, gene_1 string, gene_2 string")


def _pair_rows(spark: SparkSession, path: str) -> DataFrame:
    """The two names of each row of a CSV with gene_A, gene_B or gene_1, gene_2, as a and b, with _metadata."""
    raw = spark.read.csv(path, header=True, nullValue="")
    names = next((n for n in (("gene_A", "gene_B"), ("gene_1", "gene_2")) if set(n) <= set(raw.columns)), None)
    if names is None:
        raise ValueError("a pair list needs gene_A and gene_B, or gene_1 and gene_2")
    return raw.select(F.col(names[0]).alias("a"), F.col(names[1]).alias("b"), "_metadata")


def read_pairs(spark: SparkSession, path: str, limit: int = 1_000_000) -> list[tuple[str, str]]:
    """Pairs of a CSV with gene_A, gene_B or gene_1, gene_2 as a list, so at most ``limit`` rows; read_pair_table() has no bound."""
    rows = _pair_rows(spark, path).select("a", "b").limit(limit + 1).collect()
    if not rows or len(rows) > limit:
        raise ValueError("the pair list is empty" if not rows else f"the pair list has over {limit} rows")
    return [(a or "", b or "") for a, b in rows]


def read_pair_table(spark: SparkSession, path: str) -> DataFrame:
    """pair_table() of a CSV of any length: rows are made canonical, each pair's first place in the file is found and the pairs are numbered in
    that order without coming to the driver."""
    first, second = (F.btrim(F.coalesce(c, F.lit("")), F.lit(WHITE)) for c in ("a", "b"))
    # Where a row stands: its file, its split's start in it, its number within what a task reads.
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    rows = _pair_rows(spark, path).select(first.alias("a"), second.alias("b"), place.alias("_place"))
    row = rows.agg(F.count("*").alias("n"), F.count_if((F.col("a") == "") | (F.col("b") == "")).alias("empty"), F.count_if(F.col("a") == F.col("b")).alias("same")).first()
    if not row["n"]:
        raise ValueError("the pair list is empty")
    if row["empty"] or row["same"]:
        raise ValueError("a gene name is empty" if row["empty"] else "a pair of a gene with itself")
    pairs = rows.groupBy(F.least("a", "b").alias("gene_1"), F.greatest("a", "b").alias("gene_2")).agg(F.min("_place").alias("_place"))
    return sinks.numbered(pairs.orderBy("_place").drop("_place")).select(F.col("place").cast("int").alias("ordinal"), "gene_1", "gene_2")


def missing_genes(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Requested genes that no point has."""
    wanted = pairs.select(F.col("gene_1").alias("geneID")).union(pairs.select("gene_2")).distinct()
    return wanted.join(points.select("geneID").distinct(), "geneID", "left_anti")


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """A raw result, checked: columns present, no nulls or empty ids, finite q and enrichment, at least a row."""
    place = sinks.published(spark, path)
    if path.rstrip("/").endswith(".parquet"):
        return check_result(spark.read.parquet(place))
    raw = spark.read.csv(place, header=True, nullValue="")
    return check_result(raw.select(*[F.col(c).cast(t).alias(c) for c, t in RESULT if c in raw.columns]))


def check_result(result: DataFrame) -> DataFrame:
    needed = ("gene_A", "gene_B", "qvalue_BH", "pair", "enrichment_ratio")
    if absent := [c for c in needed if c not in result.columns]:
        raise ValueError(f"a raw result needs the columns {', '.join(needed)}; missing: {', '.join(absent)}")
    bad = F.lit(False)
    for c in needed:
        bad = bad | F.col(c).isNull() | ((F.abs(c) == float("inf")) | F.isnan(c) if dict(result.dtypes)[c] == "double" else F.trim(c) == "")
    row = result.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).first()
    if not row["n"] or row["bad"]:
        raise ValueError("the raw result has no rows" if not row["n"] else "the raw result has missing or non-finite values")
    return result
