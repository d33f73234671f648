"""Quality classifier: gradient-boosted trees on histograms of document statistics.

Each document becomes a row of numbers (STATISTICS) taken from its whole text. Trees are grown level by level on histograms
of binned statistics, with the gradient and curvature of the logistic loss, and kept as complete trees in flat arrays of
statistic, threshold and leaf value; scoring moves all documents of a batch down all trees at once, in NumPy.

The model is fitted to a bounded sample, whatever the input: the ``rows`` labelled documents with the smallest hash of their
id. Only their statistics reach the driver. All documents are scored, in one pass over their texts.

Defined cases: null and empty texts have statistics of zero and are scored like others; null ids are scored, never learnt from; rows that
repeat an id are learnt from once, a document with several labels by the smallest; without labels every score is 0.5, with labels of one kind
all scores are alike; an empty table gives no rows; ties between splits go to the first statistic and threshold; other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is known of a text. Shares are of characters (bytes of UTF-8), words or lines.
STATISTICS = (
    "log_words", "word_length", "word_length_deviation", "upper", "digits", "marks", "rare_marks", "bars", "exclamations", "stops", "commas", "not_ascii",
    "entropy", "words_a_line", "repeated_lines", "distinct_words", "distinct_pairs", "top_word", "marked_words", "short_words", "long_words", "capitalised_words", "compressed",
)
#: Labelled documents that the model is fitted to.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, RIDGE, LEAST = 80, 4, 0.15, 64, 1.0, 10.0
THRESHOLD = 0.3
#: Bytes of a text that are counted or compressed at once; all of a text is.
PIECE = 1 << 16


def _byte_sets() -> np.ndarray:
    sets = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b"#$%&*<>@\\^_`{}~=+", b"|", b"!", b".?", b",", bytes(range(128, 256))]
    return np.array([[b in s for b in range(256)] for s in sets], dtype=np.float64)


_SETS = _byte_sets()


def statistics(text: str | None) -> list[float]:
    """The numbers of STATISTICS for one text."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(STATISTICS)
    raw, n = text.encode("utf-8", "surrogatepass"), len(words)
    histogram, packed = np.zeros(256), 0
    for k in range(0, len(raw), PIECE):
        piece = raw[k : k + PIECE]
        histogram += np.bincount(np.frombuffer(piece, np.uint8), minlength=256)
        packed += len(zlib.compress(piece, 1))
    shares = histogram / len(raw)
    lengths = np.fromiter(map(len, words), np.float64, n)
    lines = [x for x in text.split("\n") if x.strip()]
    seen = Counter(words)
    present = shares[shares > 0]
    return [
        math.log(n), lengths.mean(), lengths.std(), *(_SETS @ shares).tolist(),
        float(-(present * np.log2(present)).sum()), math.log(n / len(lines)), 1 - len(set(lines)) / len(lines), len(seen) / n, len(set(zip(words, words[1:]))) / max(1, n - 1),
        max(seen.values()) / n, sum([not w[-1].isalnum() for w in words]) / n, float((lengths <= 2).mean()), float((lengths >= 12).mean()), sum([w[0].isupper() for w in words]) / n, packed / len(raw),
    ]


@dataclass
class Forest:
    """Complete trees in flat arrays: statistic and threshold of every inner node, value of every leaf, and the odds to start from."""

    start: float
    statistic: np.ndarray  # trees x (2 ** depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # trees x 2 ** depth

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of statistics."""
        n, (trees, inner) = len(rows), self.statistic.shape
        node = np.zeros((n, trees), np.int64)
        every, own = np.arange(n)[:, None], np.arange(trees)[None, :]
        for _ in range(inner.bit_length()):
            node = 2 * node + 1 + (rows[every, self.statistic[own, node]] > self.threshold[own, node])
        odds = self.start + self.value[own, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-odds))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Upper bounds of the bins but the last: quantiles, each once."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="lower"))


def fit_forest(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, ridge: float = RIDGE, least: float = LEAST) -> Forest:
    """Boost trees on binned rows. A node is split where the loss falls most, if both sides hold ``least`` rows; one that isn't
    split sends all rows left."""
    inner = 2**depth - 1
    good = float(labels.sum())
    start = math.log((good + 1) / (len(labels) - good + 1))
    if not 0 < good < len(labels):
        return Forest(start if len(labels) else 0.0, np.zeros((1, inner), np.int64), np.full((1, inner), np.inf), np.zeros((1, inner + 1)))
    edges = [_edges(c, bins) for c in rows.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, rows.T, strict=True)])
    odds = np.full(len(labels), start)
    statistic, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-odds))
        slope, curve, node = p - labels, p * (1 - p), np.zeros(len(labels), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            gain, place = np.zeros(width), np.zeros((width, 2), np.int64)
            for j, own in enumerate(binned):
                # Sums of the rows at or below each bin's upper bound, by node.
                slot = (node - first) * bins + own
                g, h, m = (np.bincount(slot, w, width * bins).reshape(width, bins).cumsum(axis=1) for w in (slope, curve, np.ones(len(labels))))
                left, right = g**2 / (h + ridge), (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge)
                better = left + right - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                better[(m < least) | (m[:, -1:] - m < least)] = 0.0
                at = better.argmax(axis=1)
                best = better[np.arange(width), at]
                improved = best > gain + 1e-9
                gain[improved], place[improved] = best[improved], np.stack([np.full(width, j), at], axis=1)[improved]
            for k in np.flatnonzero(gain > 0):
                j, at = place[k]
                statistic[t, first + k], threshold[t, first + k] = j, edges[j][at]
            node = 2 * node + 1 + (rows[np.arange(len(labels)), statistic[t, node]] > threshold[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, curve, inner + 1)
        value[t] = -rate * g / (h + ridge)
        odds += value[t][leaf]
    return Forest(start, statistic, threshold, value)


def held_out(id_column: str = "doc_id") -> Column:
    """Whether a document is kept out of learning: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def with_statistics(docs: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """The columns in keep and ``statistics`` of the whole text."""

    def run(batches):
        for batch in batches:
            found = pa.array([statistics(t.as_py()) for t in batch.column(len(keep))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], found], [*keep, "statistics"])

    plain = docs.select(*keep, F.col(text_column).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    return plain.mapInArrow(run, f"{schema}, statistics array<double>")


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, **options) -> Forest:
    """Fit to the statistics of at most ``rows`` labelled documents, those with the smallest hash of their id."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    met = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    found = with_statistics(met, ["doc_id", "quality"]).groupBy("doc_id", "quality").agg(F.min("statistics").alias("statistics"))
    sample = sorted((r["doc_id"], r["quality"], r["statistics"]) for r in found.collect())
    values = np.array([s for _, _, s in sample], dtype=np.float64).reshape(len(sample), len(STATISTICS))
    return fit_forest(values, np.array([float(q == 1) for _, q, _ in sample]), **options)


def scored(docs: DataFrame, forest: Forest, keep: list[str], text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns in keep with score and predicted, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            values = np.array([statistics(t.as_py()) for t in batch.column(len(keep))], dtype=np.float64).reshape(-1, len(STATISTICS))
            score = shared.value.scores(values)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    plain = docs.select(*keep, F.col(text_column).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    return plain.mapInArrow(run, f"{schema}, score double, predicted int")


def classified(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learnt from the labelled ones that aren't held out."""
    forest = learn(docs, labels.where(~held_out()), rows)
    return scored(docs.select("doc_id", "text").withColumn("held_out", held_out()), forest, ["doc_id", "held_out"])
