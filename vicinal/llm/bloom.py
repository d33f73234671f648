"""A blocked Bloom filter over 64-bit hashes: all bits of a key lie in one 512-bit block, so a test touches one cache line.

The number of blocks has an upper bound whatever the number of keys; beyond it only false positives grow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a key, words of 64 bits in a block, bits aimed at for a key.
PROBES, WORDS, BITS_A_KEY = 8, 8, 12


class BlockedBloom:
    def __init__(self, words: np.ndarray):
        self.words = words.reshape(-1, WORDS)

    @classmethod
    def sized(cls, keys: int, max_bytes: int) -> BlockedBloom:
        blocks = max(1, min(-(-keys * BITS_A_KEY // (64 * WORDS)), max_bytes // (8 * WORDS)))
        return cls(np.zeros(blocks * WORDS, dtype=np.uint64))

    def _places(self, hashes: np.ndarray):
        """Block of each hash, and the words and bits of its probes."""
        h = hashes.astype(np.int64).view(np.uint64)
        block = (h >> np.uint64(32)) * np.uint64(len(self.words)) >> np.uint64(32)
        x = h * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        for _ in range(PROBES):
            x = x * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1442695040888963407)
            bit = x >> np.uint64(55)
            yield block.astype(np.int64), (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))

    def add(self, hashes: np.ndarray) -> None:
        for block, word, bit in self._places(hashes):
            np.bitwise_or.at(self.words, (block, word), bit)

    def might_hold(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), dtype=bool)
        for block, word, bit in self._places(hashes):
            out &= (self.words[block, word] & bit) != 0
        return out


def build(hashes: DataFrame, keys: int, max_bytes: int = 16 << 20, parts: int = 8) -> BlockedBloom:
    """The filter of a column of longs. The driver gets at most ``parts`` filters of at most ``max_bytes``."""
    empty = BlockedBloom.sized(keys, max_bytes)
    shape = len(empty.words)

    def run(batches):
        own = BlockedBloom(np.zeros(shape * WORDS, dtype=np.uint64))
        for batch in batches:
            own.add(batch.column(0).drop_null().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([own.words.tobytes()], pa.binary())], ["words"])

    for row in hashes.coalesce(parts).mapInArrow(run, "words binary").toLocalIterator():
        empty.words |= np.frombuffer(row["words"], dtype=np.uint64).reshape(-1, WORDS)
    return empty


def passing(df: DataFrame, bloom: BlockedBloom, column: str, negated: bool = False) -> DataFrame:
    """The rows whose hash the filter might hold; negated: those whose hash it does not hold."""
    shared = df.sparkSession.sparkContext.broadcast(bloom)
    at = df.columns.index(column)

    def run(batches):
        for batch in batches:
            held = shared.value.might_hold(batch.column(at).to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(held != negated))

    return df.where(F.col(column).isNotNull()).mapInArrow(run, df.schema)
