"""Benchmark decontamination with spaced seeds, in DataFrame expressions only.

Words are runs of letters and digits, lower-cased. A mask fixes which of some neighbouring words count; the hash of those
words is a seed, so that words at the ignored places may differ. Seeds of all texts meet the benchmark's seeds in a hash
join, and around each hit the words themselves are compared on the hit's diagonal: an item and a text overlap if some
window of WINDOW words (or the whole item, if shorter) agrees in at least NEED of 100 words. That is so for items of every
length; ``shortest`` leaves out items of fewer words, for benchmarks with answers of a word or two. By default none is left out.

No such overlap goes without a hit: wherever the words that may differ stand in a window, some mask ignores them all
(``masks_of``). So the result is what comparing every item with every place of every text would give.

The benchmark's seeds are broadcast without its words, the words once for each piece of at most PIECE of an item, in
blocks of about BLOCK_SEEDS seeds; each block reads the texts once. Texts are neither shuffled nor exploded into rows
that carry them. Of the places of an item with one seed and the same words all around, one is listed: comparing another would
come to the same. So an item that repeats itself meets each place of a text a bounded number of times. Where only the
documents are asked for (clean()), one is listed of all items.

Defined cases: null and empty texts and items overlap with nothing; one word repeated in text and item overlaps like others; null ids are carried along; repeated rows are reported once for each id; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Places that count, of a window of WINDOW words or at one of its later places. Fixed values, found by search: of any
#: two words of the window, some mask at some place in it ignores both.
MASKS = [(0, 1, 2, 4, 5, 6, 9), (0, 1, 3, 6, 8, 9, 10), (0, 3, 4, 5, 6, 9, 10)]
WINDOW, NEED = 13, 80
#: Words between the start of a window and the last place that a mask can take in it.
SLACK = WINDOW - 1 - min(m[-1] for m in MASKS)
#: Seeds aimed at in one broadcast, words in a piece of an item.
BLOCK_SEEDS, PIECE = 1_000_000, 20_000


def masks_of(n: int) -> list[tuple[int, ...]]:
    """The masks for windows of n words. Shorter ones than WINDOW: places are dealt into two groups more than words may
    differ, and each choice of as many groups is ignored by a mask."""
    if n >= WINDOW:
        return MASKS
    differ = n - -(-NEED * n // 100)
    groups = min(n, differ + 2)
    return [tuple(p for p in range(n) if p % groups not in out) for out in combinations(range(groups), differ)]


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(masks: list[tuple[int, tuple[int, ...]]], own_length: bool) -> Column:
    """At place ``at`` of ``h`` a seed for each mask that fits; masks: (window, places). With own_length a text takes
    only the masks of its own length, and those of short windows at its start."""
    each = []
    for m, (n, places) in enumerate(masks):
        room = places[-1] + 1 if n >= WINDOW else n
        fits = F.col("at") + room <= F.size("h")
        if own_length:
            fits = fits & (F.size("h") >= WINDOW if n >= WINDOW else F.size("h") == n)
        each.append(F.when(fits, F.xxhash64(F.lit(m), *[F.get(F.col("h"), F.col("at") + p) for p in places])))
    return F.array(*each)


def _seeded(rows: DataFrame, keep: list[str], masks: list[tuple[int, tuple[int, ...]]], own_length: bool, *more: Column) -> DataFrame:
    least = min(places[-1] + 1 if n >= WINDOW else n for n, places in masks)
    starts = F.when(F.size("h") >= least, F.sequence(F.lit(0), F.size("h") - least))  # no filter, which would hash the words again
    placed = rows.select(*keep, "h", F.explode(starts).alias("at"))
    return placed.select(*keep, "h", "at", *more, F.explode(_seeds(masks, own_length)).alias("seed"))


def pieces_of(benchmark: DataFrame, item_column: str = "item_id", item_text: str = "text", shortest: int = 1) -> DataFrame:
    """piece, item_id, h of the items of at least ``shortest`` words: long ones in pieces that overlap by a window less a word."""
    items = benchmark.select(F.col(item_column).alias("item_id"), word_hashes(text_or_empty(item_text)).alias("h")).where(F.size("h") >= max(1, shortest)).distinct()
    cut = items.withColumn("from", F.explode(F.sequence(F.lit(0), F.greatest(F.size("h") - WINDOW, F.lit(0)), F.lit(PIECE))))
    return cut.select(F.xxhash64("item_id", "h", "from").alias("piece"), "item_id", F.slice("h", F.col("from") + 1, F.lit(PIECE + WINDOW - 1)).alias("h"))


def _around(at: str) -> list[Column]:
    """The words of ``h`` that a hit at a place compares, null where there is none."""
    return [F.get("h", F.col(at) + k) for k in range(-SLACK, WINDOW)]


def overlaps(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_column: str = "text", item_column: str = "item_id", item_text: str = "text", shortest: int = 1, each_item: bool = True) -> DataFrame:
    """A row for each text and item that overlap: the columns in keep, item_id, words matched in the best window, its length. Without
    each_item a row for each text that overlaps with any."""
    pieces = pieces_of(benchmark, item_column, item_text, shortest)
    size = F.size("h")
    found = pieces.agg(F.sum(size).alias("words"), F.collect_set(F.when(size < WINDOW, size)).alias("short")).first()
    masks = [(n, places) for n in (WINDOW, *sorted(found["short"])) for places in masks_of(n)]
    blocks = max(1, -(-(found["words"] or 0) * len(MASKS) // BLOCK_SEEDS))
    rows = docs.select(*keep, word_hashes(text_or_empty(text_column)).alias("h"))
    seeded = _seeded(rows, keep, masks, False)
    out = None
    for block in range(blocks):
        own = pieces.where(F.pmod(F.col("piece"), F.lit(blocks)) == block)
        # Places with one seed and the same words all around are one; the words outside an item are told by their place.
        words_around = F.xxhash64(*[F.coalesce(w, F.lit(k)) for k, w in enumerate(_around("at"))]).alias("words_around")
        listed = _seeded(own, ["piece"], masks, True, words_around).where("seed IS NOT NULL").select("seed", "piece", F.col("at").alias("item_at"), "words_around", F.least(F.size("h"), F.lit(WINDOW)).alias("n"))
        listed = listed.dropDuplicates(["seed", "words_around", "n", *(["piece"] if each_item else [])]).select("seed", "piece", "item_at")
        words = own.select("piece", "item_id", F.col("h").alias("item_h"))
        met = seeded.join(F.broadcast(listed), "seed").join(F.broadcast(words), "piece")
        out = met if out is None else out.union(met)
    # Which of the words around a hit agree (null: none there), as generated code that passes no text's words on.
    n = F.size("item_h")
    agree = [(own == F.get("item_h", F.col("item_at") + k)).cast("int") for k, own in zip(range(-SLACK, WINDOW), _around("at"), strict=True)]
    group = [*keep, *(["item_id"] if each_item else [])]
    near = out.select(*group, F.least(n, F.lit(WINDOW)).alias("window"), F.array(*agree).alias("_agree"))
    starts = F.sequence(F.lit(1), F.size("_agree") - F.lit(WINDOW - 1))
    best = F.array_max(F.transform(starts, lambda s: F.aggregate(F.slice("_agree", s, F.col("window")), F.lit(0), lambda a, x: a + x)))
    # One number for whether a window agrees enough, words matched and its length; the greatest counts, as an item may have texts of several lengths.
    enough = (100 * F.col("matched") >= NEED * F.col("window")).cast("int")
    pairs = near.withColumn("matched", best).groupBy(*group).agg(F.max(enough * 10_000 + F.col("matched") * 100 + F.col("window")).alias("_best"))
    # Judged after the aggregate: as a join condition the lambdas would bar code generation.
    return pairs.where("_best >= 10000").select(*group, F.floor(F.col("_best") % 10_000 / 100).cast("int").alias("matched"), (F.col("_best") % 100).alias("window"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", shortest: int = 1) -> DataFrame:
    """A row for each document and item that overlap: doc_id, item_id, most words matched in a window, the window's length."""
    own = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    pairs = overlaps(own, benchmark, ["doc_id"], shortest=shortest)
    return pairs.select("doc_id", "item_id", F.col("matched").cast("long").alias("matched_words"), F.col("window").cast("long").alias("window_words"))


def clean(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", shortest: int = 1) -> DataFrame:
    """The documents that overlap with no item, with their columns."""
    key = F.xxhash64(F.col(id_column), text_or_empty(text_column)).alias("key")
    gone = overlaps(docs.select(key, F.col(text_column).alias("text")), benchmark, ["key"], shortest=shortest, each_item=False).select("key")
    rows = docs.select(key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(gone, "key", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
