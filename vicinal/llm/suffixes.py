"""Removal of byte strings that occur in earlier documents, by column-wise construction of a collection's suffix order.

Every 50-byte string is held by the run of positions around its anchor: the 16-byte substring of least hash within it.
Equal strings have equal anchors, so all occurrences of a string meet in the bucket of its anchor, in rows aligned at
the anchor, and no string is cut by a bucket's edge. In a bucket the collection of distinct rows is sorted column by
column from the right: each round inserts one symbol of every row before its suffix, reorders the suffixes stably by
the new symbol (the last round's column of the Burrows-Wheeler transform) and updates the common prefixes of
neighbours. Suffixes of one round with a common prefix of 50 bytes or more are one string; the smallest doc_id among
its rows decides what is removed where. Buckets are small (BUCKET bytes of text), so their columns stay in memory
where a construction over one whole collection would keep them in sequential external files.

A piece that several texts of one chunk share is sent once, for the smallest doc_id; the others lose it there and
then. A task remembers pieces that many texts of a chunk shared, and sends them again only for a smaller doc_id. So a
passage that a third of all documents share puts a few rows a task into its bucket, not one a document. A piece that one
text repeats at equal distances is sent once with its first place, step and number, so that a text of one repeated byte
sends a few rows. Long texts are cut into parts of CHUNK bytes that overlap by a string less a byte. Pieces are dealt to
buckets, and spans to documents, in rounds of bounded fan-out (``dealing``), so that work grows with the data, not with
its square.

Defined cases: a null text is empty; texts under 50 bytes lose nothing; a document loses nothing to itself or to rows
with an equal doc_id; a null doc_id counts as larger than any other; repeated rows get equal results; an empty table
gives no rows; other columns are ignored. Documents are told apart by doc_id and a CRC of their text. One text may
have up to 1 GB; a task holds a few times the longest text and some hundred MB.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom, dealing, scan
from .common import text_or_empty, written
from .scan import U

LENGTH, ANCHOR = 50, 16
#: Anchor positions in a string, columns of an aligned row.
PLACES = LENGTH - ANCHOR + 1
WIDTH = LENGTH + PLACES - 1
#: Bytes of text cut into pieces at once, and bytes of text aimed at in a bucket.
CHUNK, BUCKET = 2 << 20, 10 << 20
#: Ranges in a round of dealing (many, as pieces are whole in themselves: one round suffices up to 80 GB of text, two up
#: to 600 TB), and compressed bytes of a range that are cut again at once.
FAN, RECUT = 8192, 6 << 20
#: Texts of a chunk that make a task remember the piece they share, and pieces it remembers.
MANY, REMEMBERED = 8, 1 << 20
POSITION = U((1 << 28) - 1)
LAST = (1 << 63) - 1


def _anchored(data: np.ndarray, offsets: np.ndarray):
    """All strings of LENGTH bytes as runs that share an anchor: first and last start, anchor's place, anchor's hash, text."""
    n = len(data)
    rolling = scan.Rolling(data)
    key = rolling.all(ANCHOR)
    key &= ~POSITION
    key |= np.arange(len(key), dtype=np.uint64)
    size, least = 1, key
    while 2 * size <= PLACES:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    least = np.minimum(least[: n - LENGTH + 1], least[PLACES - size : PLACES - size + n - LENGTH + 1])
    fits = np.zeros(n + 1, dtype=np.int32)
    length = np.diff(offsets)
    long = length >= LENGTH
    np.add.at(fits, offsets[:-1][long], 1)
    np.add.at(fits, offsets[1:][long] - LENGTH + 1, -1)
    start = np.flatnonzero(np.cumsum(fits)[: n - LENGTH + 1] > 0)
    anchor = (least[start] & POSITION).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)))) if len(start) else np.zeros(0, dtype=np.int64)
    first, last = start[cut], start[np.append(cut[1:], len(start)) - 1] if len(start) else start
    anchor = anchor[cut]
    text = np.searchsorted(offsets, first, side="right") - 1
    return first, last, anchor, scan.mix(key[anchor] >> U(28)), text, scan.mix(rolling.of(first, last + LENGTH) + (anchor - first).astype(np.uint64))


def _share(hashes: np.ndarray, count: int) -> np.ndarray:
    return (((hashes >> U(40)) * U(count)) >> U(24)).astype(np.int32)


def _owner(ids: np.ndarray, crcs: np.ndarray, count: int) -> np.ndarray:
    return _share(scan.mix(ids.view(np.uint64) * U(0x9E3779B97F4A7C15) + crcs.astype(np.uint64)), count)


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(a.tobytes() for a in arrays))


def _merged(ids, crcs, start, stop):
    """Spans of the same documents as maximal ones: ids, crcs, start, stop, ordered."""
    order = np.lexsort((start, crcs, ids))
    ids, crcs, start, stop = ids[order], crcs[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    if not len(ids):
        return ids, crcs, start, stop
    doc = np.cumsum(np.concatenate(([0], (ids[1:] != ids[:-1]) | (crcs[1:] != crcs[:-1])))) << 31
    reach = np.maximum.accumulate(stop + doc)
    new = np.flatnonzero(np.concatenate(([True], (start + doc)[1:] > reach[:-1])))
    return ids[new], crcs[new], start[new], (reach - doc)[np.append(new[1:], len(doc)) - 1]


def _spans_by_range(ids, crcs, start, stop, buckets: int, width: int):
    """(range, blob) of merged spans, by the bucket of their document."""
    ids, crcs, start, stop = _merged(ids, crcs, start, stop)
    to = _owner(ids, crcs, buckets) // width
    for b in np.unique(to):
        own = to == b
        yield int(b), _packed(np.array([own.sum()], dtype=np.int64), ids[own], crcs[own].astype(np.uint32), start[own].astype(np.uint32), stop[own].astype(np.uint32))


def _unpacked_spans(blobs: list[bytes]):
    cols = [[], [], [], []]
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, at = int(np.frombuffer(raw, dtype=np.int64, count=1)[0]), 8
        for out, kind in zip(cols, (np.int64, np.uint32, np.uint32, np.uint32), strict=True):
            out.append(np.frombuffer(raw, dtype=kind, count=n, offset=at))
            at += n * np.dtype(kind).itemsize
    return tuple(np.concatenate(x) for x in cols)


#: Columns of pieces beside their bytes: id and crc of the text, start in it, bytes before the anchor, further strings, step and number of repeats.
KINDS = (np.int64, np.uint32, np.uint32, np.uint8, np.uint8, np.uint32, np.uint32)


def _taken(data: np.ndarray, begin: np.ndarray, size: np.ndarray, before: np.ndarray | int = 0, width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``width`` bytes that hold pieces of data from column ``before`` on, and which columns are theirs; some rows at a time."""
    padded = np.concatenate((np.zeros(width, dtype=np.uint8), data, np.zeros(width, dtype=np.uint8)))
    view = np.lib.stride_tricks.sliding_window_view(padded, width)
    before = np.broadcast_to(np.asarray(before, dtype=np.int64), begin.shape)
    column = np.arange(width)
    for k in range(0, len(begin), 1 << 16):
        low, high = before[k : k + (1 << 16), None], (before + size)[k : k + (1 << 16), None]
        yield view[(begin - before)[k : k + (1 << 16)] + width], (column >= low) & (column < high)


def _pieces_by_range(cols: list[np.ndarray], to: np.ndarray, taken) -> Iterator[tuple[int, bytes]]:
    """(range, blob) of pieces; to: each one's range; taken(places): their bytes, as rows and which columns are theirs."""
    for own in dealing.runs(np.argsort(to, kind="stable"), to):
        pieces = [rows[mine] for rows, mine in taken(own)]
        yield int(to[own[0]]), _packed(np.array([len(own)], dtype=np.int64), *[c[own].astype(k) for c, k in zip(cols, KINDS, strict=True)], *pieces)


def _unpacked_pieces(blobs: list[bytes]):
    """Columns, offsets and bytes of packed pieces. The list is emptied on the way."""
    cols, bytes_of = [[] for _ in KINDS], []
    for k in range(len(blobs)):
        raw, blobs[k] = zstandard.ZstdDecompressor().decompress(blobs[k]), None
        n, at = int(np.frombuffer(raw, dtype=np.int64, count=1)[0]), 8
        for out, kind in zip(cols, KINDS, strict=True):
            out.append(np.frombuffer(raw, dtype=kind, count=n, offset=at))
            at += n * np.dtype(kind).itemsize
        bytes_of.append(np.frombuffer(raw, dtype=np.uint8, offset=at))
    cols = [np.concatenate(x) for x in cols]
    offsets = np.concatenate(([0], np.cumsum(cols[4].astype(np.int64) + LENGTH)))
    return cols, offsets, np.concatenate(bytes_of)


def _recut_pieces(buckets: int):
    def recut(blobs: list[bytes], width: int):
        cols, offsets, data = _unpacked_pieces(blobs)
        hashed = np.empty(len(offsets) - 1, dtype=np.uint64)
        for a in range(0, len(hashed), 1 << 14):  # a few MB of hashes at once
            b = min(a + (1 << 14), len(hashed))
            anchor = offsets[a:b] - offsets[a] + cols[3][a:b]
            hashed[a:b] = scan.mix(scan.Rolling(data[offsets[a] : offsets[b]]).of(anchor, anchor + ANCHOR) >> U(28))
        size = np.diff(offsets)
        yield from _pieces_by_range(cols, _share(hashed, buckets) // width, lambda own: _taken(data, offsets[own], size[own]))

    return recut


def _repeats(text: np.ndarray, piece: np.ndarray, first: np.ndarray):
    """Pieces that a text repeats at equal distances as one: places of those kept, step and number of each."""
    order = np.lexsort((first, piece, text))
    t, p, f = text[order], piece[order], first[order]
    same = np.concatenate(([False], (t[1:] == t[:-1]) & (p[1:] == p[:-1])))
    step = np.diff(f, prepend=f[:1])
    goes_on = same & ~(np.concatenate(([False], same[:-1])) & (step != np.concatenate((step[:1], step[:-1]))))
    starts = np.flatnonzero(~goes_on)
    number = np.diff(np.append(starts, len(order)))
    after = np.minimum(starts + 1, max(len(step) - 1, 0))
    return order[starts], np.where(number > 1, step[after], 0), number


def _pieces(buckets: int):
    """From texts: pieces by range of their anchor's bucket (kind 0), and what is removed within the chunk (kind 1, by document)."""
    width, gather = dealing.widths(buckets, FAN)[0], dealing.GATHER

    def cut(ids, crcs, data, offsets, base, known):
        """Spans that are removed (or None), and the columns, ranges and bytes of pieces to send (or None)."""
        if len(data) < LENGTH:
            return None, None
        first, last, anchor, hashed, text, piece = _anchored(data, offsets)
        if not len(first):
            return None, None
        order = np.lexsort((ids[text], piece))
        start = np.flatnonzero(np.concatenate(([True], piece[order][1:] != piece[order][:-1])))
        texts, own = np.diff(np.append(start, len(order))), ids[text][order][start]
        name = piece[order][start]
        if len(known[0]):
            at = np.minimum(np.searchsorted(known[0], name), len(known[0]) - 1)
            own = np.where(known[0][at] == name, np.minimum(known[1][at], own), own)
        least = np.repeat(own, texts)
        many = texts >= MANY
        if many.any():
            names, values = np.concatenate((name[many], known[0])), np.concatenate((ids[text][order][start][many], known[1]))
            by = np.lexsort((values, names))
            first_of = np.concatenate(([True], names[by][1:] != names[by][:-1]))
            known[:] = [names[by][first_of][:REMEMBERED], values[by][first_of][:REMEMBERED]]
        copy = np.empty(len(order), dtype=bool)
        copy[order] = ids[text][order] > least
        begins = first - offsets[text] + base
        gone = np.flatnonzero(copy)
        removed = (ids[text[gone]], crcs[text[gone]], begins[gone], (begins + last - first)[gone] + LENGTH) if len(gone) else None
        alone = np.empty(len(order), dtype=bool)
        alone[order] = np.repeat(texts == 1, texts)
        single, often = np.flatnonzero(~copy & alone), np.flatnonzero(~copy & ~alone)
        kept, step, number = _repeats(text[often], piece[often], first[often])
        kept = np.concatenate((single, often[kept]))
        step, number = np.concatenate((np.zeros(len(single), dtype=np.int64), step)), np.concatenate((np.ones(len(single), dtype=np.int64), number))
        if not len(kept):
            return removed, None
        spread = (last - first)[kept]
        rows = np.concatenate([x for x, _ in _taken(data, first[kept], spread + LENGTH)])
        cols = [ids[text[kept]], crcs[text[kept]], begins[kept], (anchor - first)[kept], spread, step, number]
        cols = [c.astype(k) for c, k in zip(cols, KINDS, strict=True)]
        return removed, (cols, _share(hashed[kept], buckets) // width, rows)

    def sent(held):
        cols = [np.concatenate(x) for x in zip(*(h[0] for h in held), strict=True)]
        to, rows, column = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), np.arange(WIDTH)
        held.clear()

        def taken(own):
            for k in range(0, len(own), 1 << 16):
                some = own[k : k + (1 << 16)]
                yield rows[some], column < cols[4][some, None].astype(np.int16) + LENGTH

        for key, blob in _pieces_by_range(cols, to, taken):
            yield 0, key, blob

    def run(batches):
        known = [np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)]
        held, size = [], 0
        for batch in batches:
            every = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
            gone = []
            for first, data, offsets in scan.chunks(batch.column(1), CHUNK):
                ids = every[first : first + len(offsets) - 1]
                crcs = np.array([zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], dtype=np.uint32)
                parts = [(data, offsets, 0)]
                if len(ids) == 1 and len(data) > CHUNK:
                    parts = [(p, np.array([0, len(p)]), a) for a in range(0, len(data) - LENGTH + 1, CHUNK) for p in [data[a : a + CHUNK + LENGTH - 1]]]
                for part, cuts, base in parts:
                    removed, pieces = cut(ids, crcs, part, cuts, base, known)
                    if removed:
                        gone.append(_merged(*removed))
                    if pieces:
                        held.append(pieces)
                        size += pieces[2].size
                        if size >= gather:
                            yield from dealing.rows(sent(held))
                            held, size = [], 0
            if gone:
                spans = (np.concatenate(x) for x in zip(*gone, strict=True))
                yield from dealing.rows((1, b, x) for b, x in _spans_by_range(*spans, buckets, width))
        if held:
            yield from dealing.rows(sent(held))

    return run


def common_prefixes(lcp: np.ndarray, order: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Common prefixes of neighbours after a round: suffixes at old places ``order`` got the new first symbols ``symbol``.

    lcp[i] is that of old places i - 1 and i. Two neighbours that share the new symbol have one more than the least of
    the old values between their old places; others have none. Values stop at LENGTH.
    """
    n = len(lcp)
    table = [lcp]
    while 2 << (len(table) - 1) <= n:
        half = 1 << (len(table) - 1)
        prior = table[-1]
        grown = prior.copy()
        np.minimum(prior[: n - half], prior[half:], out=grown[: n - half])
        table.append(grown)
    levels = np.stack(table)
    low, high = order[:-1] + 1, order[1:]
    same = np.flatnonzero(symbol[1:] == symbol[:-1])
    low, high = low[same], high[same]
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    least = np.minimum(levels[level, low], levels[level, high - (1 << level) + 1])
    out = np.zeros(n, dtype=np.uint8)
    out[same + 1] = np.minimum(least + 1, LENGTH)
    return out


def first_holders(rows: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each aligned row and start column the smallest id of a row that has the same string there; LAST where the row has none.

    rows: one distinct row of WIDTH bytes each; a row has strings at the start columns low to high.
    """
    n = len(rows)
    out = np.full((n, PLACES), LAST, dtype=np.int64)
    columns = np.ascontiguousarray(rows.T)
    order, lcp = np.arange(n), np.zeros(n, dtype=np.uint8)
    for c in range(WIDTH - 1, -1, -1):
        symbol = columns[c][order]  # of the transform: what stands before the suffixes of the last round
        moved = np.argsort(symbol, kind="stable")
        lcp = common_prefixes(lcp, moved, symbol[moved])
        order = order[moved]
        if c < PLACES:
            string = np.cumsum(lcp < LENGTH) - 1
            has = (low[order] <= c) & (c <= high[order])
            least = np.full(int(string[-1]) + 1, LAST, dtype=np.int64)
            np.minimum.at(least, string[has], ids[order[has]])
            out[order[has], c] = least[string[has]]
    return out


def _removed(buckets: int):
    """For a bucket of anchors: spans to remove, by range of their document's bucket. Kind 1 is passed on."""
    width = dealing.widths(buckets, FAN)[0]

    def run(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == 1:
            return table.select(["kind", "key", "blob"])
        out = list(_spans_by_range(*_sorted_bucket(table.column("blob").to_pylist()), buckets, width))
        return pa.table({"kind": pa.array([1] * len(out), pa.int32()), "key": pa.array([b for b, _ in out], pa.int64()), "blob": pa.array([x for _, x in out], pa.binary())})

    return run


def _sorted_bucket(blobs: list[bytes]):
    """ids, crcs, start and stop of every span to remove that a bucket's pieces show."""
    (ids, crcs, start, left, spread, step, number), offsets, data = _unpacked_pieces(blobs)
    low, spread = PLACES - 1 - left.astype(np.int16), spread.astype(np.int16)
    start, step, number = start.astype(np.int64), step.astype(np.int64), number.astype(np.int64)
    anchor = offsets[:-1] + left
    words = np.lib.stride_tricks.sliding_window_view(data, ANCHOR)[anchor]
    words = np.ascontiguousarray(words).view(np.uint64)
    name = scan.mix(scan.mix(words[:, 0]) * U(3) + words[:, 1])
    order = np.argsort(name, kind="stable")
    cut = np.flatnonzero(np.concatenate(([True], name[order][1:] != name[order][:-1])))
    held = np.diff(np.append(cut, len(order)))
    several = np.minimum.reduceat(ids[order], cut) != np.maximum.reduceat(ids[order], cut)
    keep = np.sort(order[np.repeat(several, held)])  # anchors of one document alone remove nothing
    ids, crcs, start, low, spread, step, number = (x[keep] for x in (ids, crcs, start, low, spread, step, number))
    if not len(ids):
        return ids, crcs, start, start
    size = np.diff(offsets)[keep]
    rows = np.concatenate([np.where(mine, x, np.uint8(0)) for x, mine in _taken(data, offsets[keep], size, low, WIDTH + 4)])  # to whole words of 8 bytes
    words = rows.view(np.uint64)
    name = scan.mix(low.astype(np.uint64) * U(64) + spread.astype(np.uint64))
    for k in range(words.shape[1]):
        name = scan.mix(name * U(0x9E3779B97F4A7C15) + words[:, k])
    _, one, which = np.unique(name, return_index=True, return_inverse=True)
    least = np.full(len(one), LAST, dtype=np.int64)
    np.minimum.at(least, which, ids)
    holder = first_holders(rows[one][:, :WIDTH], low[one], (low + spread)[one], least)
    out = np.zeros((len(ids), PLACES + 2), dtype=np.int8)
    for c in range(PLACES):
        out[:, c + 1] = holder[which, c] < ids
    change = np.diff(out, axis=1)
    row, begin = np.nonzero(change == 1)
    _, end = np.nonzero(change == -1)
    begin, size = start[row] + begin - low[row], end - begin - 1 + LENGTH
    # Repeats whose spans touch are one span, others as many as there are.
    touch = step[row] <= size
    times = np.where(touch, 1, number[row])
    size = np.where(touch, size + (number[row] - 1) * step[row], size)
    each = np.repeat(np.arange(len(row)), times)
    begin = begin[each] + (np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)) * step[row][each]
    return ids[row][each], crcs[row][each], begin, begin + size[each]


def _recut_spans(buckets: int):
    def recut(blobs: list[bytes], width: int):
        yield from _spans_by_range(*_unpacked_spans(blobs), buckets, width)

    return recut


def _joined_spans(table: pa.Table) -> pa.Table:
    """A row for each document: its maximal spans."""
    ids, crcs, start, stop = _merged(*_unpacked_spans(table.column("blob").to_pylist()))
    cut = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (crcs[1:] != crcs[:-1]))))
    ends = pa.array(np.append(cut, len(ids)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (start, stop)]
    return pa.table({"_id": pa.array(ids[cut], pa.int64()), "_crc": pa.array(crcs[cut].astype(np.int64), pa.int64()), "starts": lists[0], "stops": lists[1]})


def _key(id_column: str, text_column: str) -> list[Column]:
    return [F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)).alias("_id"), F.crc32(text_or_empty(text_column).cast("binary")).alias("_crc")]


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """_id, _crc, starts, stops (in bytes) of every document that has something to remove. Written to the shared folder."""
    total = docs.agg(F.sum(F.octet_length(text_or_empty(text_column)))).first()[0] or 0
    buckets = max(1, min(1 << 24, -(-total // BUCKET)))
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("binary").alias("text"))
    pieces = dealing.dealt(texts.mapInArrow(_pieces(buckets), dealing.SCHEMA), buckets, 0, _recut_pieces(buckets), 4 * total, FAN, RECUT)
    spans = pieces.groupBy("kind", "key").applyInArrow(_removed(buckets), dealing.SCHEMA)
    spans = dealing.dealt(spans, buckets, 1, _recut_spans(buckets), total, FAN, RECUT)
    return written(spans.groupBy("key").applyInArrow(_joined_spans, "_id long, _crc long, starts array<int>, stops array<int>"), "spans")


def _flags(spans: DataFrame) -> bloom.BlockedBloom:
    hashes = spans.select(F.xxhash64("_id", "_crc").alias("h"))
    return bloom.build(hashes, hashes.count())


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A Bloom filter of bounded size lets only texts with spans (and a few others) into the shuffle that cuts them.
    """
    spans = repeated_spans(docs, id_column, text_column)
    own = docs.select(*_key(id_column, text_column), F.col(id_column).alias("doc_id"), text_or_empty(text_column).cast("binary").alias("text"))
    marked = own.select("_id", "_crc", "text", F.xxhash64("_id", "_crc").alias("_hash"))
    texts = bloom.passing(marked, _flags(spans), "_hash").drop("_hash").dropDuplicates(["_id", "_crc"])

    def run(batches):
        for batch in batches:
            n, count, sha = [], [], []
            for text, starts, stops in zip(*(batch.column(k) for k in ("text", "starts", "stops")), strict=True):
                raw, at, digest, gone = memoryview(text.as_py()), 0, hashlib.sha256(), 0
                starts, stops = starts.as_py(), stops.as_py()
                for a, b in zip(starts, stops, strict=True):
                    digest.update(raw[at:a])
                    gone, at = gone + b - a, b
                digest.update(raw[at:])
                n.append(gone), count.append(len(starts)), sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_crc"), pa.array(n, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], ["_id", "_crc", "n_removed", "n_spans", "kept"])

    cut = texts.join(spans, ["_id", "_crc"]).select("_id", "_crc", "text", "starts", "stops").mapInArrow(run, "_id long, _crc long, n_removed long, n_spans long, kept string")
    plain = own.select("_id", "_crc", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    zero = F.lit(0).cast("long")
    return plain.join(cut, ["_id", "_crc"], "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"))


def _without(raw: bytes, starts: list[int], stops: list[int]) -> str:
    """The text without its spans; a span is narrowed to whole characters."""
    out, at, n = [], 0, len(raw)
    for a, b in zip(starts, stops, strict=True):
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < n and raw[b] & 0xC0 == 0x80:
            b -= 1
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """docs without the spans that earlier documents hold; length_column, where there is one, follows the text."""
    spans = repeated_spans(docs, id_column, text_column)
    flags = docs.sparkSession.sparkContext.broadcast(_flags(spans))
    names = docs.columns

    @F.pandas_udf("boolean")
    def marked(hashes):
        import pandas as pd

        return pd.Series(flags.value.might_hold(hashes.to_numpy()))

    @F.pandas_udf("string")
    def cut(texts, starts, stops):
        import pandas as pd

        return pd.Series([t if a is None else _without(t.encode(), list(a), list(b)) for t, a, b in zip(texts, starts, stops, strict=True)])

    own = docs.select(*_key(id_column, text_column), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    own = own.withColumn("_hit", marked(F.xxhash64("_id", "_crc")))
    hit = own.where("_hit").join(spans, ["_id", "_crc"], "left")
    text = F.when(F.col("starts").isNotNull(), cut(F.col("_row").getField(text_column), "starts", "stops")).otherwise(F.col("_row").getField(text_column))
    hit = hit.withColumn("_new", text)

    def column(c, new):
        value = F.col("_row").getField(c)
        if new and c == text_column:
            value = F.col("_new")
        elif new and c == length_column:
            value = F.when(F.col("starts").isNotNull(), F.char_length("_new").cast(docs.schema[c].dataType)).otherwise(value)
        return value.alias(c)

    return hit.select(*[column(c, True) for c in names]).union(own.where("NOT _hit").select(*[column(c, False) for c in names]))
