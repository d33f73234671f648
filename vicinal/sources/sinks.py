"""Result files: names, single-file CSV, row-limited parts, distance exports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_A_FILE = 250_000
#: Rows of a written table up to which a join may broadcast it.
BROADCAST_ROWS = 100_000


def final_path(save_path: str, threshold: float, shape: bool = False) -> str:
    return save_path.replace(".csv", f"_dedup_{threshold}_post_proc{'_shape' if shape else ''}.csv")


def shape_path(save_path: str) -> str:
    return save_path.replace(".csv", "_shape.csv")


def summary_path(save_path: str) -> str:
    folder, slash, name = save_path.rpartition("/")
    stem = name[:-7] if name.lower().endswith(".csv.gz") else name.rpartition(".")[0] or name
    return f"{folder}{slash}{stem}_summary.csv"


def write_dataset(df: DataFrame, path: str, kind: str = "csv", compression: str | None = None) -> None:
    """A folder of files of at most ROWS_A_FILE rows, written in parallel beside its place and put there whole (publish())."""
    writer = df.write.option("maxRecordsPerFile", ROWS_A_FILE)
    if compression:
        writer = writer.option("compression", compression)
    beside = _beside(path)
    writer.option("header", True).csv(beside) if kind == "csv" else writer.parquet(beside)
    publish(df.sparkSession, beside, path)


def write_numbered(df: DataFrame, path: str) -> None:
    """A table with ``place`` (from 0, without gaps) as CSV files that follow each other in order, ROWS_A_FILE rows in each but the last."""
    files = -(-df.count() // ROWS_A_FILE)
    dealt = df.repartitionById(max(1, files), F.floor(F.col("place") / ROWS_A_FILE).cast("int")).sortWithinPartitions("place")
    beside = _beside(path)
    dealt.drop("place").write.option("header", True).csv(beside)
    publish(df.sparkSession, beside, path)


def _beside(path: str) -> str:
    return f"{path.rstrip('/')}.{uuid.uuid4().hex}.parts"


def shared_path(spark: SparkSession, label: str) -> str:
    """An unused path in the folder that driver and executors share (spark.checkpoint.dir), or, on one machine alone, in one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vicinal-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, path: str) -> DataFrame:
    """df, written once as Parquet in parallel and read back, so that what follows does not compute it again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(df: DataFrame, label: str) -> DataFrame:
    """df, written once to the shared folder, for a join with a large table: a broadcast if it has few rows, as then the large one needn't move."""
    kept = staged(df, shared_path(df.sparkSession, label))
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def clustered(df: DataFrame, label: str, *keys: str) -> DataFrame:
    """df, written once to the shared folder with rows of equal keys together, so that what is counted by them is small before it moves. A first key of
    very many rows is dealt over several tasks."""
    return staged(df.hint("rebalance", keys[0]).sortWithinPartitions(*keys), shared_path(df.sparkSession, label))


def numbered(rows: DataFrame) -> DataFrame:
    """A sorted table with ``place``, each row's number from 0: it is written with each row's number in its partition, to which the rows
    of the partitions before are added. No task sees more than its range."""
    bits = 33  # of a row's number in its partition, as monotonically_increasing_id() has it
    table = staged(rows.withColumn("_id", F.monotonically_increasing_id()), shared_path(rows.sparkSession, "ordered")).withColumn("_part", F.shiftright("_id", bits))
    sizes = table.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))  # one row for each partition
    inner = F.col("_id").bitwiseAND(F.lit((1 << bits) - 1))
    return table.join(F.broadcast(starts), "_part").withColumn("place", F.col("_before") + inner).drop("_part", "_id", "_before")


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _path(spark: SparkSession, path):
    """(file system, path) of a path or its text."""
    out = spark._jvm.org.apache.hadoop.fs.Path(path) if isinstance(path, str) else path
    return out.getFileSystem(spark._jsc.hadoopConfiguration()), out


def _rename(spark: SparkSession, source, target) -> None:
    system, source = _path(spark, source)
    if not system.rename(source, _path(spark, target)[1]):
        raise OSError(f"{source} could not be moved to {target}")


def replace(spark: SparkSession, source, target) -> None:
    """Put a file in the place of another in one step: whoever reads finds the old one or the new one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs, target = _path(spark, target)
    if fs.exists(target) and fs.getFileStatus(target).isDirectory():
        publish(spark, source if isinstance(source, str) else source.toString(), target.toString())
        return
    options = jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(options, 1)
    overwrite[0] = options.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(_path(spark, source)[1]), fs.makeQualified(target), overwrite)


def _pointer(path: str) -> str:
    return f"{path.rstrip('/')}.next"


def publish(spark: SparkSession, source: str, target: str) -> None:
    """Put a whole folder (or file) in the place of another.

    No file system of Hadoop's swaps two folders in one step. So a pointer, a file that is put in place in one step, first names the
    new folder: from then on published() leads readers to the new one, whole, wherever the moves that follow are cut short. A
    later publication, or recover(), completes them. No reader is ever led to an empty or mixed folder.
    """
    recover(spark, target)
    fs, place = _path(spark, target)
    if not fs.exists(place):
        _rename(spark, source, target)
        return
    written = _path(spark, f"{_pointer(target)}.{uuid.uuid4().hex}")[1]
    stream = fs.create(written, True)
    stream.write(bytearray(source.encode()))
    stream.close()
    replace(spark, written, _pointer(target))
    _complete(spark, source, target)


def _complete(spark: SparkSession, source: str, target: str) -> None:
    fs, place = _path(spark, target)
    if fs.exists(_path(spark, source)[1]):
        if fs.exists(place):
            _rename(spark, target, f"{target.rstrip('/')}.{uuid.uuid4().hex}.old")
        _rename(spark, source, target)
    fs.delete(_path(spark, _pointer(target))[1], False)
    for status in fs.globStatus(_path(spark, f"{target.rstrip('/')}.*.old")[1]) or []:
        fs.delete(status.getPath(), True)


def _named(spark: SparkSession, target: str) -> str | None:
    fs, pointer = _path(spark, _pointer(target))
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def recover(spark: SparkSession, target: str) -> None:
    """Complete a publication that was cut short."""
    if (source := _named(spark, target)) is not None:
        _complete(spark, source, target)


def published(spark: SparkSession, path: str) -> str:
    """Where the whole of a published folder or file lies: at its path, or, while it is being put there, beside it."""
    source = _named(spark, path)
    return source if source is not None and _path(spark, source)[0].exists(_path(spark, source)[1]) else path


def write_single(df: DataFrame, path: str, kind: str = "csv", compression: str = "none") -> None:
    """One file at path, put in place by a rename after it is whole. For results of a size that one file should have; what
    is costly to compute should be staged first, since one task writes the file."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    parts = f"{path}.{uuid.uuid4().hex}.parts"
    writer = df.coalesce(1).write.option("compression", compression)
    writer.option("header", True).csv(parts) if kind == "csv" else writer.parquet(parts)
    folder, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    part = next((s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")), None)
    replace(spark, part, target)
    fs.delete(folder, True)


def export_format(path: str, chosen: str | None = None) -> tuple[str, str]:
    """(kind, compression) of a distance export, by option or by extension."""
    name = path.lower()
    by_name = next((k for ext, k in ((".csv.gz", "csv.gz"), (".csv", "csv"), (".parquet", "parquet")) if name.endswith(ext)), None)
    kind = chosen or by_name
    if kind not in ("csv", "csv.gz", "parquet"):
        raise ValueError("the output format must be csv, csv.gz or parquet")
    return {"csv": ("csv", "none"), "csv.gz": ("csv", "gzip"), "parquet": ("parquet", "snappy")}[kind]


def write_export(distances: DataFrame, summary: DataFrame, path: str, chosen: str | None = None, report: str | None = None) -> None:
    """A distance export and its companion summary (at report, if given), pairs in request order."""
    kind, compression = export_format(path, chosen)
    folder = f"{path}.{uuid.uuid4().hex}.stage"
    write_single(staged(distances, folder), path, kind, compression)
    remove(distances.sparkSession, folder)
    write_single(summary.orderBy("ordinal").drop("ordinal"), report or summary_path(path))


def retain_distances(distances: DataFrame, path: str, buckets: int = 64) -> None:
    """Distances kept for later extraction: Parquet partitioned by a hash of gene_A, so that a request reads few files."""
    bucketed = distances.withColumn("bucket", F.pmod(F.xxhash64("gene_A"), F.lit(buckets)))
    beside = _beside(path)
    bucketed.repartition("bucket").write.partitionBy("bucket").parquet(beside)
    publish(distances.sparkSession, beside, path)


def retained_layout(spark: SparkSession, folder: str, background: str = "auto") -> str:
    """Where a run kept its distances: under the background it was made with; auto needs just one of the two."""
    names = ["all", "cooccurrence"] if background == "auto" else [background]
    conf = spark._jsc.hadoopConfiguration()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}") for n in names]
    found = [str(p) for p in paths if p.getFileSystem(conf).exists(p)]
    if len(found) != 1:
        raise ValueError("distances of both backgrounds are there; name one" if found else "no retained distances were found")
    return found[0]
