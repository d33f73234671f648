"""Stages of a run that outlive its driver: tables in a folder, beside a manifest of the options and inputs that they follow from.

A stage counts once Spark has committed it whole. A run that finds a folder whose manifest says what it would write itself
takes up after the last whole stage; one that finds any other folder there starts anew. A finished run removes its folder.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sinks import remove, replace

MANIFEST, COMMITTED = "manifest.json", "_SUCCESS"


def fingerprint(spark: SparkSession, path: str) -> list[list]:
    """Path, length and time of change of every file of an input."""
    start = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = start.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(start, True)
    out = []
    while found.hasNext():
        status = found.next()
        if not status.getPath().getName().startswith("."):
            out.append([status.getPath().toString(), status.getLen(), status.getModificationTime()])
    return sorted(out)


class Stages:
    """stage(table, name) -> table, written once. ``table`` may be a function that plans it, which is not called for a stage that is there."""

    def __init__(self, spark: SparkSession, folder: str, identity: dict):
        self.spark, self.folder, self.reused = spark, folder, []
        said = json.dumps(identity, sort_keys=True, default=str)
        if self._text(MANIFEST) != said:
            remove(spark, folder)
            self._write(MANIFEST, said)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _system(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _text(self, name: str) -> str | None:
        path = self._path(name)
        system = self._system(path)
        if not system.exists(path):
            return None
        stream = system.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        path, beside = self._path(name), self._path(f"{name}.new")
        stream = self._system(path).create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        replace(self.spark, beside, path)

    def whole(self, name: str) -> bool:
        path = self._path(f"{name}/{COMMITTED}")
        return self._system(path).exists(path)

    def __call__(self, table: DataFrame | Callable[[], DataFrame], name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        if self.whole(name):
            self.reused.append(name)
        else:
            made = table() if callable(table) else table
            made.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def close(self) -> None:
        remove(self.spark, self.folder)
