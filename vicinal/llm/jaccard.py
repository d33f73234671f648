"""N-gram Jaccard join by vertical partitioning.

The n-grams (hashes of word runs) of all texts stand in one global order: by number of texts that have them, then by
fragment and place in it. Fragments are ranges of hash values. Each fragment counts, for its own n-grams only, which
texts share them; n-grams of one text alone are dropped there. A text whose unshared n-grams already exceed what the
threshold allows can have no link and drops out whole; others keep a prefix in the global order that any partner must
meet, and two texts whose shared n-grams are too few for the threshold are not paired. Partial overlaps of candidate pairs are counted fragment by fragment and summed per pair, exactly.

Equal sets are one class from the start. Among texts that share a prefix n-gram, all are first compared with one pivot
(two rounds, two choices of pivot); what is then in one component needs no further pairs, and all remaining pairs
across components are compared exhaustively. So no link between components is lost, and a group of thousands of near
copies costs pairs in proportion to its size.

N-grams that very many texts have are not sent to their fragment, which one task reads whole, but stay with their texts
(``frequent_grams``); the sample that finds them grows with the corpus, so that what is left of one n-gram is bounded.
N-grams go to fragments, and sets to buckets, in rounds of bounded fan-out (``dealing``): the number of blobs grows with the
data, not with its square. Hot keys of the joins between pairs and sets are split by the planner's skew join.

Defined cases: texts without words have an empty set and are linked with nothing; with fewer than k words the whole
sequence is the one n-gram; a null id takes part and is never a component's smallest unless all are null; repeated
rows are copies of each other; an empty table gives no rows; other columns are ignored. Sets are told apart by a
64-bit hash of their n-gram hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dealing, scan
from .common import drop_written, written
from .components import components, salted_join

#: Bytes of text hashed at once; n-grams aimed at in a fragment; vertical segments of a set when pairs are counted.
CHUNK, FRAGMENT, SEGMENTS = 2 << 20, 2_500_000, 4
#: Texts sampled to find the most frequent n-grams, or the part of all texts, if more; the share of the texts that makes an
#: n-gram frequent, the least number that does, and how many there may be.
SAMPLE, PART, FREQUENT, AT_LEAST, MOST = 20_000, 1e-4, 1 / 200, 50, 1 << 20


def _sets(batches, k: int):
    """(batch, row, set) of every text."""
    for batch in batches:
        for first, data, offsets in scan.chunks(batch.column(batch.num_columns - 1), CHUNK):
            for d, own in enumerate(scan.shingles(data, offsets, k)):
                yield batch, first + d, own


def _signature(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64)) if len(own) else 0


def set_sizes(docs: DataFrame, k: int, id_column: str, text_column: str) -> DataFrame:
    """doc_id, n (size of the set), sig (names the set)."""

    def run(batches):
        for batch in batches:
            found = [(len(own), _signature(own)) for _, _, own in _sets([batch], k)]
            n, sig = pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, sig], ["doc_id", "n", "sig"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, f"doc_id {kind}, n long, sig long")


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(a.tobytes() for a in arrays)


def frequent_grams(docs: DataFrame, k: int, total: int, text_column: str) -> np.ndarray:
    """Hashes of n-grams that many texts have, sorted: MOST of them at most, from a random sample of texts. Which n-grams
    it holds changes how work is dealt, not what comes out."""

    def run(batches):
        for _, _, own in _sets(batches, k):
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array([own.astype(np.int64)], pa.list_(pa.int64()))], ["grams"])

    spot = F.rand(17) < min(1.0, max(SAMPLE / max(total, 1), PART))
    sample = docs.where(spot & F.col(text_column).isNotNull()).select(F.col(text_column).alias("text")).mapInArrow(run, "grams array<long>")
    counts = sample.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    often = counts.where(F.col("n") >= max(AT_LEAST, int(FREQUENT * min(total, SAMPLE)))).orderBy(F.desc("n"), "gram").limit(MOST)
    return np.sort(np.array([r[0] for r in often.select("gram").collect()], dtype=np.int64).view(np.uint64))


def _fragment_of(grams: np.ndarray, count: int) -> np.ndarray:
    return (((grams >> np.uint64(40)) * np.uint64(count)) >> np.uint64(24)).astype(np.int64)


def _by_fragment(sig: np.ndarray, size: np.ndarray, owner: np.ndarray, grams: np.ndarray, count: int, width: int):
    """(range of fragments, blob) of n-grams, ordered by owner (a place in sig)."""
    to = _fragment_of(grams, count) // width
    for own in dealing.runs(np.argsort(to, kind="stable"), to):
        start = np.flatnonzero(np.concatenate(([True], owner[own][1:] != owner[own][:-1])))
        who = owner[own][start]
        n = np.diff(np.append(start, len(own)))
        yield int(to[own[0]]), _pack(np.array([len(who), len(own)], dtype=np.int64), sig[who], size[who].astype(np.int32), n.astype(np.int32), grams[own].astype(np.uint64))


def _unpacked(blobs: list[bytes], last: list[type]):
    """Of blobs: sig, size and number of n-grams of every set, then arrays of the given types over all n-grams."""
    out = [[] for _ in range(3 + len(last))]
    for blob in blobs:
        docs, total = np.frombuffer(blob, dtype=np.int64, count=2)
        at = 16
        for column, kind, n in zip(out, (np.int64, np.int32, np.int32, *last), (docs, docs, docs, *[total] * len(last)), strict=True):
            column.append(np.frombuffer(blob, dtype=kind, count=n, offset=at))
            at += n * np.dtype(kind).itemsize
    return tuple(map(np.concatenate, out))


def _recut_fragments(count: int):
    def recut(blobs: list[bytes], width: int):
        sig, size, n, grams = _unpacked(blobs, [np.uint64])
        yield from _by_fragment(sig, size, np.repeat(np.arange(len(sig)), n), grams, count, width)

    return recut


def _fragments(docs: DataFrame, k: int, count: int, text_column: str, frequent: np.ndarray) -> DataFrame:
    """Rows for dealing: of each distinct set of a task, its n-grams by range of fragments (kind 0). Frequent n-grams go
    with their set, by range of buckets of sets (kind 1); they come last in the global order."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    width, gather = dealing.widths(count)[0], dealing.GATHER

    def flush(held):
        sig = np.array([s for s, _ in held], dtype=np.int64)
        size = np.array([len(x) for _, x in held], dtype=np.int64)
        grams, owner = np.concatenate([x for _, x in held]), np.repeat(np.arange(len(held), dtype=np.int32), size)
        if len(shared.value):
            place = np.searchsorted(shared.value, grams)
            often = shared.value[np.minimum(place, len(shared.value) - 1)] == grams
            last = place[often] | np.int64(count << 32)
            for b, blob in _by_set(sig, size, owner[often], last, np.full(len(last), 255, dtype=np.uint8), count, width):
                yield 1, b, blob
            grams, owner = grams[~often], owner[~often]
        for f, blob in _by_fragment(sig, size, owner, grams, count, width):
            yield 0, f, blob

    def run(batches):
        seen, held, size = set(), [], 0
        for _, _, own in _sets(batches, k):
            sig = _signature(own)
            if len(own) and sig not in seen:
                seen.add(sig)
                held.append((sig, own))
                size += 8 * len(own)
                if size >= gather:
                    yield from dealing.rows(flush(held))
                    held, size = [], 0
        if held:
            yield from dealing.rows(flush(held))

    return docs.select(F.col(text_column).alias("text")).mapInArrow(run, dealing.SCHEMA)


def _by_set(sig: np.ndarray, size: np.ndarray, owner: np.ndarray, gram: np.ndarray, df: np.ndarray, buckets: int, width: int):
    """(range of buckets of sets, blob) of n-grams named by fragment and place, with their counts, ordered by owner."""
    to = (sig.view(np.uint64) % np.uint64(buckets)).astype(np.int64)[owner] // width
    for own in dealing.runs(np.argsort(to, kind="stable"), to):
        start = np.flatnonzero(np.concatenate(([True], owner[own][1:] != owner[own][:-1])))
        who = owner[own][start]
        n = np.diff(np.append(start, len(own)))
        yield int(to[own[0]]), _pack(np.array([len(who), len(own)], dtype=np.int64), sig[who], size[who].astype(np.int32), n.astype(np.int32), gram[own].astype(np.int64), df[own])


def _recut_sets(buckets: int):
    def recut(blobs: list[bytes], width: int):
        sig, size, n, gram, df = _unpacked(blobs, [np.int64, np.uint8])
        yield from _by_set(sig, size, np.repeat(np.arange(len(sig)), n), gram, df, buckets, width)

    return recut


def _shared_in_fragment(buckets: int):
    """For a fragment: the n-grams that two sets or more have, as places in the fragment's order with their counts, by
    range of buckets of sets. Kind 1 is passed on."""
    width = dealing.widths(buckets)[0]

    def run(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == 1:
            return table.select(["kind", "key", "blob"])
        sig, size, count, gram = _unpacked(table.column("blob").to_pylist(), [np.uint64])
        _, keep = np.unique(sig, return_index=True)  # a set that several tasks sent counts once
        once = np.zeros(len(sig), dtype=bool)
        once[keep] = True
        owner = np.repeat(np.arange(len(sig), dtype=np.int32), count)
        mask = once[owner]
        owner, gram = owner[mask], gram[mask]
        order = np.argsort(gram, kind="stable")
        gram, owner = gram[order], owner[order]
        start = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, dtype=np.int64)
        times = np.diff(np.append(start, len(gram)))
        place = np.cumsum(times > 1) - 1
        row = np.repeat(times > 1, times)
        owner, df, place = owner[row], np.minimum(np.repeat(times, times)[row], 255).astype(np.uint8), np.repeat(place, times)[row].astype(np.int64)
        order = np.argsort(owner, kind="stable")
        place |= np.int64(table.column("key")[0].as_py() << 32)
        out = list(_by_set(sig, size, owner[order], place[order], df[order], buckets, width))
        return pa.table({"kind": pa.array([1] * len(out), pa.int32()), "key": pa.array([b for b, _ in out], pa.int64()), "blob": pa.array([x for _, x in out], pa.binary())})

    return run


def _candidate_sets(percent: int, fragments: int):
    """For a bucket of sets: those that may have a link, in vertical segments, with their prefix in the global order."""

    def run(table: pa.Table) -> pa.Table:
        sig, size, n, gram, df = _unpacked(table.column("blob").to_pylist(), [np.int64, np.uint8])
        sig, size = np.repeat(sig, n), np.repeat(size, n)
        order = np.lexsort((gram, df, sig))
        order = order[np.concatenate(([True], (sig[order][1:] != sig[order][:-1]) | (gram[order][1:] != gram[order][:-1])))]  # several tasks may send a set's frequent ones
        sig, size, gram = sig[order], size[order].astype(np.int64), gram[order]
        start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, dtype=np.int64)
        held = np.diff(np.append(start, len(sig)))
        n = size[start]
        prefix = n - (percent * n + 99) // 100 + 1 - (n - held)  # of the shared ones, how many belong to the prefix
        rank = np.arange(len(sig)) - np.repeat(start, held)
        inside = rank < np.repeat(prefix, held)
        keep = np.repeat(prefix > 0, held)
        shared, at = np.repeat(held, held)[keep], (rank + np.repeat(n - held, held))[keep]  # at: place in the global order
        sig, size, gram, inside = sig[keep], size[keep], gram[keep], inside[keep]
        segment = ((gram >> np.int64(32)) * SEGMENTS // (fragments + 1)).astype(np.int32)
        order = np.lexsort((gram, segment, sig))
        sig, size, gram, inside, segment, shared, at = (x[order] for x in (sig, size, gram, inside, segment, shared, at))
        cut = np.flatnonzero(np.concatenate(([True], (sig[1:] != sig[:-1]) | (segment[1:] != segment[:-1])))) if len(sig) else np.zeros(0, dtype=np.int64)
        ends = np.append(cut, len(sig)).astype(np.int32)
        marks = np.concatenate(([0], np.cumsum(inside))).astype(np.int32)
        return pa.table(
            {
                "sig": pa.array(sig[cut], pa.int64()),
                "n": pa.array(size[cut], pa.int64()),
                "held": pa.array(shared[cut].astype(np.int64), pa.int64()),
                "segment": pa.array(segment[cut], pa.int32()),
                "grams": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(gram, pa.int64())),
                "prefix": pa.ListArray.from_arrays(pa.array(marks[ends], pa.int32()), pa.array(gram[inside], pa.int64())),
                "places": pa.ListArray.from_arrays(pa.array(marks[ends], pa.int32()), pa.array(at[inside], pa.int64())),
            }
        )

    return run


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of sets those that reach the threshold: partial overlaps by segment, summed per pair."""
    left = sets.select(F.col("sig").alias("a"), "segment", F.col("n").alias("n_a"), F.col("grams").alias("grams_a"))
    right = sets.select(F.col("sig").alias("b"), "segment", F.col("n").alias("n_b"), F.col("grams").alias("grams_b"))
    # A pivot may stand in very many pairs: their other sides come first, so that it is the skew join that copies the pivot.
    parts = pairs.join(right, "b").join(left, ["a", "segment"])
    parts = parts.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("part"))
    total = parts.groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("both"))
    return total.where(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def _may_link(percent: int, a: str, b: str):
    """What is possible for two texts that share an n-gram at ``place``, by sizes, by the n-grams that each shares with any
    other text at all (an overlap can't exceed them), and by place: of the overlap that their sizes need, the first
    n-gram comes so early that the rest fits behind it.
    """
    n_a, n_b, least = F.col(f"{a}.n"), F.col(f"{b}.n"), F.least(f"{a}.held", f"{b}.held")
    need = F.expr(f"({percent} * ({a}.n + {b}.n) + {99 + percent}) div {100 + percent}")
    early = (F.col(f"{a}.place") <= n_a - need) & (F.col(f"{b}.place") <= n_b - need)
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (least >= need) & early


def links(sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) for all sets that have a link."""
    step = float(np.log(100 / percent))
    posts = sets.select("sig", "n", "held", F.inline(F.arrays_zip(F.col("prefix").alias("gram"), F.col("places").alias("place")))).withColumn("size_class", F.floor(F.log(F.col("n").cast("double")) / step))
    posts = written(posts, "posts")
    # Pivots: first the text with the largest share of shared n-grams (the origin of a group of copies), then any.
    central, random = F.col("held") / F.col("n"), F.xxhash64("sig", "gram").cast("double")
    edges, roots, tables = None, None, [posts]
    for score in (central, random):
        own = posts.withColumn("root", F.col("sig")) if roots is None else _labelled(posts, roots)
        own = own.select("gram", "size_class", F.struct("sig", "n", "held", "place", "root").alias("own"), score.alias("score"))
        groups = own.groupBy("gram", "size_class").agg(F.max(F.struct("score", "own")).alias("best"), F.min("own.root").alias("low"), F.max("own.root").alias("high"))
        groups = groups.where("low <> high").select("gram", "size_class", F.col("best.own").alias("pivot"))
        met = salted_join(own.drop("score"), groups, ["gram", "size_class"]).where((F.col("own.root") != F.col("pivot.root")) & _may_link(percent, "own", "pivot"))
        pairs = met.select(F.col("pivot.sig").alias("a"), F.col("own.sig").alias("b")).distinct()
        found = written(_similar(pairs, sets, percent), "links")
        edges = found if edges is None else edges.union(found)
        roots = components(edges)
        tables += [found, roots]
    own = _labelled(posts, roots).select("gram", F.struct("sig", "n", "held", "place", "root").alias("own"))
    mixed = own.groupBy("gram").agg(F.min("own.root").alias("low"), F.max("own.root").alias("high")).where("low <> high").select("gram")
    open_posts = written(salted_join(own, mixed, ["gram"]), "open-posts")
    # Sizes of two texts with a link are in one class or in neighbouring ones.
    size_class = F.floor(F.log(F.col("own.n").cast("double")) / (step * 1.0001))
    left = open_posts.withColumn("size_class", size_class)
    other = left.select("gram", F.explode(F.sequence(F.col("size_class") - 1, F.col("size_class") + 1)).alias("size_class"), F.col("own").alias("other"))
    fits = (F.col("own.sig") < F.col("other.sig")) & (F.col("own.root") != F.col("other.root")) & _may_link(percent, "own", "other")
    pairs = left.join(other, ["gram", "size_class"]).where(fits).select(F.col("own.sig").alias("a"), F.col("other.sig").alias("b")).distinct()
    found = written(_similar(pairs, sets, percent), "links")
    out = components(edges.union(found))
    for table in (*tables, open_posts, found):
        drop_written(table)
    return out


def _labelled(posts: DataFrame, roots: DataFrame) -> DataFrame:
    named = roots.select(F.col("node").alias("sig"), "root")
    return salted_join(posts, named, ["sig"], "left").withColumn("root", F.coalesce("root", "sig"))


def joined(docs: DataFrame, k: int = 4, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) of every row."""
    sizes = written(set_sizes(docs, k, id_column, text_column), "set-sizes")
    total, texts = sizes.agg(F.sum("n"), F.count("*")).first()
    count = max(1, min(1 << 24, -(-(total or 0) // FRAGMENT)))
    frequent = frequent_grams(docs, k, texts, text_column)
    grams = 8 * (total or 0)
    fragments = dealing.dealt(_fragments(docs, k, count, text_column, frequent), count, 0, _recut_fragments(count), grams)
    shared = fragments.groupBy("kind", "key").applyInArrow(_shared_in_fragment(count), dealing.SCHEMA)
    shared = dealing.dealt(shared, count, 1, _recut_sets(count), grams)
    schema = "sig long, n long, held long, segment int, grams array<long>, prefix array<long>, places array<long>"
    sets = written(shared.groupBy("key").applyInArrow(_candidate_sets(percent, count), schema), "sets")
    roots = links(sets, percent)
    drop_written(sets)
    groups = sizes.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    groups = groups.join(roots.withColumnRenamed("node", "sig"), "sig", "left").where("copies > 1 OR root IS NOT NULL")
    groups = groups.select("sig", "first_id", F.coalesce("root", "sig").alias("root"))
    smallest = groups.groupBy("root").agg(F.min("first_id").alias("component"))
    named = salted_join(groups.select("sig", "root"), smallest, ["root"]).select("sig", "component")
    rows = salted_join(sizes, named, ["sig"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with one row of each component: that with its smallest id, then the smallest hash of id and text; of rows
    that repeat both, one. Rows without words stay. Texts with a null id stay beside those that have one; of components
    without ids one row stays."""
    key = F.xxhash64(F.col(id_column), F.col(text_column)).alias("key")
    named = F.struct(F.col(id_column).isNull().alias("absent"), F.col(id_column).alias("id"), key)
    own = docs.select(named.alias("doc_id"), F.col(text_column).alias("text"))
    rows = written(joined(own, k, percent), "one-of-each").where("n_shingles > 0")
    copy = (F.col("doc_id") != F.col("component_id")) & ~(F.col("doc_id.absent") & ~F.col("component_id.absent"))
    gone = rows.where(copy).select("doc_id.key").distinct()
    again = rows.where(~copy).select("doc_id.key").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    left = docs.select(key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(gone, "key", "left_anti")
    if not again.isEmpty():
        left = left.join(again, "key", "left_anti").union(left.join(again, "key", "left_semi").dropDuplicates(["key"]))
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
