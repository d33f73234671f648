"""Dealing of packed pieces to any number of buckets in rounds of a bounded fan-out.

A task that cut its pieces for every bucket at once would make as many blobs as there are buckets for each buffer it
fills: the work would grow with the square of the data. Here it cuts them for at most FAN ranges of buckets; further
rounds shuffle the ranges, gather GATHER bytes of one and cut those for at most FAN narrower ranges each. The blobs of a
round are at most FAN for each buffer, whatever the corpus, and a round is one shuffle: buckets need log(buckets) / log(FAN)
rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges that a buffer is cut for, bytes of pieces in a buffer, bytes of a range that one task may get.
FAN, GATHER, RANGE = 64, 24 << 20, 256 << 20
SCHEMA = "kind int, key long, blob binary"


def widths(buckets: int, fan: int | None = None) -> list[int]:
    """Buckets in a range after each round; the last is 1."""
    fan = fan or FAN
    out = [-(-buckets // fan)]
    while out[-1] > 1:
        out.append(-(-out[-1] // fan))
    return out


def runs(order: np.ndarray, key: np.ndarray) -> Iterator[np.ndarray]:
    """Of places in the order of their keys, those of each key."""
    if len(order):
        cut = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        yield from np.split(order, cut[1:])


def rows(found: Iterable[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """(kind, key, blob) as record batches of SCHEMA."""
    for kind, key, blob in found:
        yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([key], pa.int64()), pa.array([blob], pa.binary())], ["kind", "key", "blob"])


def dealt(first: DataFrame, buckets: int, kind: int, recut: Callable[[list[bytes], int], Iterator[tuple[int, bytes]]], total_bytes: int, fan: int | None = None, gather: int | None = None) -> DataFrame:
    """Rows (kind, key, blob) whose key is the bucket, from rows whose key is the first round's range. Rows of other kinds
    pass unchanged. recut(blobs of one range, width) yields (range of that width, blob)."""
    steps, gather = widths(buckets, fan), gather or GATHER
    out = first
    for wide, narrow in zip(steps, steps[1:], strict=False):
        salts = max(1, total_bytes * wide // buckets // RANGE)

        def run(batches, narrow=narrow):
            held, size, now = [], 0, None
            for batch in batches:
                for k, key, blob in zip(*(batch.column(c) for c in range(3)), strict=True):
                    k, key, blob = k.as_py(), key.as_py(), blob.as_py()
                    if k != kind:
                        yield from rows([(k, key, blob)])
                        continue
                    if held and (key != now or size >= gather):
                        yield from rows((kind, b, x) for b, x in recut(held, narrow))
                        held, size = [], 0
                    now = key
                    held.append(blob)
                    size += len(blob)
            if held:
                yield from rows((kind, b, x) for b, x in recut(held, narrow))

        salt = F.pmod(F.xxhash64("blob"), F.lit(salts))
        out = out.repartition(F.col("kind"), F.col("key"), salt).sortWithinPartitions("kind", "key").mapInArrow(run, SCHEMA)
    return out
