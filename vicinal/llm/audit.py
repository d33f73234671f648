"""Audit of how filters interact: in every order of five filters, what each step removes and what others had removed before.

Direct relational replay: the flags of every document (which filters it fails) are crossed with the 120 orders, a
broadcast table of fixed size, each crossed row finds the first step that fails, and five exploded steps are counted
conditionally. Counts are added up on the map side, so that what moves is one row for each part, order and step of a task.

Texts are read once; narrow rows of flags are written to the shared folder. Copies are found by SHA-256 over these: of
texts that occur more than once the smallest id comes back to the rows. Texts with more than one row in MANY of the table,
fewer than MANY texts whatever its size, come back in a broadcast, so that no text is a hot key of the join of the rest.

Defined cases: null texts count as empty, have no words, and are copies of one another; a null id is neither smaller nor
greater than others, so its row fails E never, and has no labels; repeated rows count each; a null source is the part '',
as an empty one is; of several labels of a document the greatest counts; a table without rows has no parts; other
columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, text_or_empty, word_array, written

#: The filters; a document that fails the k-th has bit k set.
FILTERS = "ABCDE"
COPY_BIT = 1 << FILTERS.index("E")
#: A text with more than one in so many of all rows comes back to them in a broadcast.
MANY = 1000


def text_flags(text: Column) -> Column:
    """The bits of the filters that see the text alone: A to D."""

    def of_words(words: Column) -> Column:
        n = F.size(words)
        few = F.when(n < 200, 1).otherwise(0)
        return few + F.when(100 * F.size(F.array_distinct(words)) < 50 * n, 2).otherwise(0)

    upper = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    loud = F.when(100 * upper > 2 * F.char_length(text), 4).otherwise(0)
    return let(word_array(text), of_words) + loud + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)


def flagged(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """part, flags, good, toxic of every document."""
    text = text_or_empty(text_column)
    rows = docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("sha"), text_flags(text).alias("flags"),
        # Rows without id meet no label; a number that is written with them spreads them over all tasks.
        F.when(F.col(id_column).isNull(), F.monotonically_increasing_id()).otherwise(0).alias("spread"),
    )
    rows = written(rows, "audit-flags")
    total = rows.count()
    groups = rows.groupBy("sha").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL")
    groups = written(groups, "audit-copies")
    hot = groups.where(F.col("n") * MANY > total).select("sha", F.col("first_id").alias("hot_id"))
    rest = groups.where(F.col("n") * MANY <= total).select("sha", "first_id")
    met = rows.join(F.broadcast(hot), "sha", "left")
    common = met.where("hot_id IS NOT NULL").select("id", "spread", "part", "flags", F.col("hot_id").alias("first_id"))
    others = met.where("hot_id IS NULL").drop("hot_id").join(rest, "sha", "left").select("id", "spread", "part", "flags", "first_id")
    copy = F.when(F.col("id") > F.col("first_id"), COPY_BIT).otherwise(0)
    whole = common.unionByName(others).select("id", "spread", "part", (F.col("flags") + copy).alias("flags"))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = known.select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("spread"), "quality", "toxic")
    both = whole.join(known, ["id", "spread"], "left")
    is_one = lambda c: F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)).alias(c)
    return both.select("part", "flags", is_one("quality"), is_one("toxic"))


def orders(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """filter_order and, in that order, the filters' bits."""
    rows = [("".join(p), [1 << filters.index(f) for f in p]) for p in permutations(filters)]
    return spark.createDataFrame(rows, "filter_order string, bits array<int>").coalesce(1)


def replayed(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts of a table of part, flags, quality, toxic. One row for each part, order and step."""
    n = len(filters)
    plan = orders(flags.sparkSession, filters)
    fails = lambda k: F.col("flags").bitwiseAND(F.get("bits", F.lit(k))) != 0
    first = F.lit(n + 1)
    for k in range(n - 1, -1, -1):
        first = F.when(fails(k), k + 1).otherwise(first)
    alone = F.when(F.bit_count("flags") == 1, F.col("flags")).otherwise(0)
    crossed = flags.crossJoin(F.broadcast(plan)).select("part", "filter_order", "flags", alone.alias("alone"), "quality", "toxic", first.alias("first"), F.posexplode("bits").alias("place", "bit"))
    step = F.col("place") + 1
    failed = F.col("flags").bitwiseAND(F.col("bit")) != 0
    count = lambda condition, name: F.sum(F.when(condition, 1).otherwise(0)).cast("long").alias(name)
    removed = F.col("first") == step
    counts = crossed.groupBy("part", "filter_order", step.alias("step"), "bit").agg(
        count(F.col("first") > step, "kept"), count(removed, "removed"), count(failed & (F.col("first") < step), "redundant"),
        count(F.col("alone") == F.col("bit"), "unique_fails"), count(removed & (F.col("quality") == 1), "good_lost"), count(removed & (F.col("toxic") == 1), "toxic_lost"),
    )
    # A filter's removals over all orders: sums over counts, a fixed number of rows for each part.
    counts = written(counts, "audit-counts")
    credit = counts.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return counts.join(credit, ["part", "bit"]).select("part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The whole audit of documents with the labels of some of them."""
    return replayed(flagged(docs, labels))
