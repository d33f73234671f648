"""Byte-level BPE encoding and decoding with two tiers.

Tier one: a minimal perfect hash over the vocabulary resolves a whole pre-token that is itself a token. Tier two: a
miss is merged with a heap over linked bytes, in O(n log n) for a pre-token of n bytes. Ranks come from a public rank
file; nothing is trained. Whole texts are encoded in blocks of pre-tokens, so memory does not grow with a text, and
what a worker remembers of earlier pre-tokens is bounded.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to nothing; repeated rows are encoded
alike; an empty table gives no rows; null ids are carried along; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens handled at once, and pre-tokens that a worker remembers at most: few, as an idle worker stays for a while beside the next stage.
BLOCK, REMEMBERED = 1 << 16, 400_000
#: Letters, numbers and marks that Unicode has had since version 17 or later. The rank files' own splitter follows version
#: 16, in which they are unassigned. First and last code points.
LATER = """
558 58B-58C 5C8-5C9 88F B53-B54 C5C CDC 1ACF-1AF0 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7
10ECB-10ECF 10ED9-10EEE 10EF0-10EFB 11B0A 11B60-11B67 11DB0-11DDB 11DE0-11DE9 11DF0-11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3
16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D127-1D128 1D250-1D252 1D25B-1D25C
1D25F 1D280-1D281 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6F5 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD
323B0-33479 3D000-3FC3F
""".split()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PerfectHash:
    """A minimal perfect hash from tokens to ranks: as many slots as tokens, a displacement for each small bucket."""

    def __init__(self, ranks: dict[bytes, int]):
        self.n = n = len(ranks)
        self.n_buckets = max(1, n // 3)
        hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in ranks], dtype=np.uint64)
        if len(np.unique(hashes)) < n:
            raise ValueError("two tokens have one 64-bit hash")
        buckets, base, step = self._parts(hashes)
        order = np.argsort(buckets, kind="stable")
        starts = np.searchsorted(buckets[order], np.arange(self.n_buckets + 1))
        self.displacement = [0] * self.n_buckets
        taken, slots = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
        for b in np.argsort(starts[:-1] - starts[1:], kind="stable"):
            own = order[starts[b] : starts[b + 1]]
            if len(own):
                self.displacement[b], slots[own] = self._place(base[own], step[own], taken)
                taken[slots[own]] = True
        self.tokens, self.ranks = [b""] * n, [0] * n
        for slot, (token, rank) in zip(slots.tolist(), ranks.items(), strict=True):
            self.tokens[slot], self.ranks[slot] = token, rank

    def _parts(self, h):
        return h % np.uint64(self.n_buckets), (h >> np.uint64(20)) % np.uint64(self.n), (h >> np.uint64(7)) % np.uint64(max(1, self.n - 1)) + np.uint64(1)

    def _place(self, base, step, taken):
        """The first displacement that puts a bucket's tokens on free slots, no two on one."""
        first, tried = 0, 32
        while True:
            d = np.arange(first, first + tried, dtype=np.uint64)[:, None]
            slots = ((base + (d // np.uint64(self.n)) * step + d) % np.uint64(self.n)).astype(np.int64)
            free = ~taken[slots].any(axis=1)
            if len(base) > 1:
                s = np.sort(slots, axis=1)
                free &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if free.any():
                k = int(free.argmax())
                return first + k, slots[k]
            if first > 64 * self.n:
                raise ValueError("no displacement found")
            first, tried = first + tried, min(2 * tried, 4096)

    def get(self, token: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(token)
        d = self.displacement[h % self.n_buckets]
        slot = ((h >> 20) % self.n + d // self.n * ((h >> 7) % max(1, self.n - 1) + 1) + d) % self.n
        return self.ranks[slot] if self.tokens[slot] == token else None


def merge(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token: of all neighbouring parts the pair of lowest rank is joined, leftmost first, till none has a rank."""
    n = len(token)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(token[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop or end[i] != j:
            continue
        end[i], after[i], alive[j] = stop, after[j], False
        if after[i] < n:
            k = after[i]
            before[k] = i
            if (r := ranks.get(token[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(token[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : end[i]]])
        i = after[i]
    return out


class _Remembered(dict):
    """What made() gives for a pre-token: made on demand and remembered, half of the bound in each of two generations; what is met again moves on to the next."""

    def __init__(self, made: Callable[[str], Sequence[int]]):
        super().__init__()
        self.made, self.old = made, {}

    def __missing__(self, piece: str) -> Sequence[int]:
        out = self.old.get(piece) or self.made(piece)
        if len(piece) <= 64:
            if len(self) >= REMEMBERED // 2:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out


_LATER_SET = "[" + "".join("-".join(rf"\U{int(x, 16):08X}" for x in span.split("-")) for span in LATER) + "]"
_LATER_FOUND = regex.compile(_LATER_SET)
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def splitters(pattern: str) -> tuple[regex.Pattern, regex.Pattern]:
    """The pattern as the rank files' own splitter reads it: for texts without LATER code points, and for those with some.

    It takes White_Space, which this library's \\s exceeds by U+001C to U+001F; classes of letters, numbers and marks are
    those of Unicode 16, in which U+0295 was a small letter.
    """
    plain = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    plain = plain.replace(r"\p{Ll}", r"[\p{Ll}\u0295]").replace(r"\p{Lo}", r"[\p{Lo}--\u0295]")
    strict = regex.sub(r"\\p\{(?:L|N|M)[a-z]?\}", lambda m: f"[{m[0]}--{_LATER_SET}]", plain)
    return regex.compile(plain, regex.V1), regex.compile(strict, regex.V1)


def narrow(pattern: str) -> re.Pattern | None:
    """The pattern for texts of the first 65,536 code points, with its classes written out for the standard library's faster matcher; the same for texts with LATER code points
    and for those without. None where the pattern names other classes than \\s, \\S, \\p{L} and \\p{N}."""
    if "\\" in regex.sub(r"\\(?:[sS]|p\{[LN]\})", "", pattern) or "(?i" in pattern:
        return None
    every = "".join(map(chr, range(0x10000)))
    spans = {}
    for name, members in ((r"\s", r"\p{White_Space}"), (r"\p{L}", rf"[\p{{L}}--{_LATER_SET}]"), (r"\p{N}", rf"[\p{{N}}--{_LATER_SET}]")):
        found = regex.finditer(members + "+", every, regex.V1)
        spans[name] = "".join(rf"\u{m.start():04x}-\u{m.end() - 1:04x}" for m in found)
    out = []
    for part in regex.split(r"(\[[^\]]*\])", pattern):
        inside = part.startswith("[")
        if inside and r"\S" in part:
            return None
        for name, members in spans.items():
            part = part.replace(name, members if inside else f"[{members}]")
        out.append(part.replace(r"\S", f"[^{spans[r'\s']}]"))
    return re.compile("".join(out))


class Codec:
    """Encodes whole texts and decodes ids."""

    def __init__(self, hashed: PerfectHash, pattern: str):
        self.hashed = hashed
        self.by_token = dict(zip(hashed.tokens, hashed.ranks, strict=True))
        self.known, self.named = _Remembered(self._ids), _Remembered(self._named)
        self.plain, self.strict = splitters(pattern)
        self.narrow = narrow(pattern)
        self.token = dict(zip(hashed.ranks, hashed.tokens, strict=True))
        self.name = {rank: b",%d" % rank for rank in hashed.ranks}
        self.by_name = {b"": b""} | {b"%d" % rank: token for rank, token in self.token.items()}

    def _ids(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8")
        whole = self.hashed.get(raw)
        return (whole,) if whole is not None else tuple(merge(raw, self.by_token))

    def _named(self, piece: str) -> bytes:
        """A pre-token's ids as decimals, each after a comma."""
        return b"".join(map(self.name.__getitem__, self._ids(piece)))

    def pattern(self, text: str) -> re.Pattern | regex.Pattern:
        """What splits a text fastest."""
        if self.narrow and (text.isascii() or not _ASTRAL.search(text)):
            return self.narrow
        return self.strict if not text.isascii() and _LATER_FOUND.search(text) else self.plain

    def blocks(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, block by block."""
        pattern = self.pattern(text)
        pieces = iter(pattern.findall(text)) if len(text) < 1 << 20 else (m[0] for m in pattern.finditer(text))
        while block := list(islice(pieces, BLOCK)):
            yield block

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(chain.from_iterable(map(self.known.__getitem__, block) for block in self.blocks(text))))

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as decimals joined by commas, SHA-256 of the ids decoded again."""
        n, ids_hash, bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
        for block in self.blocks(text):
            ids = b"".join(map(self.named.__getitem__, block))
            ids_hash.update(ids if n else ids[1:])
            bytes_hash.update(b"".join(map(self.by_name.__getitem__, ids.split(b","))))
            n += ids.count(b",")
        return n, ids_hash.hexdigest(), bytes_hash.hexdigest()


_CODECS: dict[str, Codec] = {}


def _codec(shared, pattern: str, key: str) -> Codec:
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(shared.value, pattern)
    return _CODECS[key]


def _with_codec(docs: DataFrame, vocabulary: str, pattern: str, make, columns: list, schema: str) -> DataFrame:
    hashed = PerfectHash(read_ranks(vocabulary))
    shared, key = docs.sparkSession.sparkContext.broadcast(hashed), f"{vocabulary}\n{pattern}"

    def run(batches):
        codec = _codec(shared, pattern, key)
        for batch in batches:
            yield make(codec, batch)

    return docs.select(*columns).mapInArrow(run, schema)


def encoded(docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and the ids of the whole text."""

    def make(codec, batch):
        ids = pa.array([codec.encode(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return _with_codec(docs, vocabulary, pattern, make, [F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")], f"doc_id {kind}, ids array<int>")


def decoded(ids: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of encoded()'s ids."""

    def make(codec, batch):
        raw = pa.array([codec.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), raw], ["doc_id", "bytes"])

    kind = ids.schema["doc_id"].dataType.simpleString()
    return _with_codec(ids, vocabulary, pattern, make, [F.col("doc_id"), F.col("ids")], f"doc_id {kind}, bytes binary")


def digests(docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of what they decode to; ids don't leave the worker."""

    def make(codec, batch):
        n, ids, raw = zip(*(codec.digest(t.as_py() or "") for t in batch.column(1)), strict=True) if len(batch) else ((), (), ())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_column].dataType.simpleString()
    return _with_codec(docs, vocabulary, pattern, make, [F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")], f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
