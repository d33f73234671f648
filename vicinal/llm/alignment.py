"""Alignment of two tokenizers over a corpus: which tokens of one stand for which of the other.

Both tokenizers cut a text into tokens that cover the same bytes. Wherever a token of A and one of B end at the same byte a
group ends; two pointers merge the cumulative ends inside mapInPandas. Every occurrence of A linked with every one of
B in its group makes the links of a document. Spark counts in how many documents an id pair is linked, and brings that
count and the greatest count of each A id back to the documents.

Texts are encoded whole, in segments: neither tokenizer has a token across a space between two visible characters (A's
splitter starts a new piece there, no piece of B has its space mark after another character; this is checked when
they are loaded, and otherwise nothing is cut). So a segment's groups are the same in every text, and a worker keeps what
it has aligned, up to REMEMBERED segments. A text without such a space is one segment. A's merges come in the order of its
ids (checked, too), so ASCII segments are encoded by ranks, by a faster library, to the same ids.

A document's pairs are written once, as arrays, to the shared folder. Counts are added up before they move. Pairs with more than
one in COMMON of all (document, pair) rows, fewer than COMMON of them whatever the corpus, are joined back in a broadcast,
which leaves no hot pair for the join of the rest.

Defined cases: texts that are null, empty or not reproduced by either tokenizer have no tokens, zeros and an empty digest; repeated
rows and null ids are documents of their own; an empty table gives no rows; other columns are ignored. In a group
of many tokens equal ids are counted before they are paired, so that long runs of one token don't multiply.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: A space between visible characters, at which both tokenizers begin a token.
CUT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
SPACE_MARK = "▁"
#: A's rule of splitting, as a pattern. Fixed value.
SPLITTER = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Segments that a worker remembers, the longest of these, segments of a long text aligned at once, characters of text looked up together.
REMEMBERED, SHORT, BLOCK, GATHER = 240_000, 64, 20_000, 500_000
#: Links of a group above which equal ids are counted before they are paired.
LARGE = 256
#: A pair with more than one in so many of all rows is joined back in a broadcast.
COMMON = 100_000
B_BITS = 32


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters stand for themselves,
    the other bytes, in order, for the characters from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the segments aligned so far."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size_a = self.a.get_vocab_size(with_added_tokens=True)
        names = [self.a.id_to_token(i) or "" for i in range(size_a)]
        of = byte_characters()
        self.bytes_a = [bytes(of[c] for c in name) if all(c in of for c in name) else name.encode() for name in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.name = [str(i) for i in range(max(size_a, len(pieces)))]
        with open(path_a, encoding="utf-8") as file:
            model = json.load(file)
        splitter = model["pre_tokenizer"] or {}
        by_rule = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space") and not model["normalizer"]
        self.cuts = bool(by_rule) and not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        self.ranked = self._by_ranks(model["model"], by_rule)
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def _by_ranks(self, model: dict, by_rule: bool):
        """The same encoding for ASCII texts by a faster library, if A's merges come in the order of the ids that they make; else None."""
        vocabulary, added = model["vocab"], {t for t in self.a.get_added_tokens_decoder()}
        made = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1)) for m in model["merges"]]
        if not by_rule or None in made or made != sorted(made):
            return None
        import tiktoken

        ranks = {self.bytes_a[i]: i for i in vocabulary.values() if i not in added}
        return tiktoken.Encoding("ranks", pat_str=SPLITTER, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == len(vocabulary) - len(added & set(vocabulary.values())) else None

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        out: list = [self.ranked.encode_ordinary(t) if self.ranked and t.isascii() else None for t in texts]
        others = [k for k, ids in enumerate(out) if ids is None]
        for k, found in zip(others, self.a.encode_batch_fast([texts[k] for k in others], add_special_tokens=False), strict=True):
            out[k] = found.ids
        return out

    def segments(self, text: str) -> Iterator[list[str]]:
        """The segments of a text, in blocks."""
        if not self.cuts:
            yield [text]
        elif len(text) <= GATHER:
            every = CUT.split(text)
            for k in range(0, len(every), BLOCK):
                yield every[k : k + BLOCK]
        else:
            start, block = 0, []
            for found in CUT.finditer(text):
                block.append(text[start : found.start()])
                start = found.end()
                if len(block) == BLOCK:
                    yield block
                    block = []
            yield [*block, text[start:]]

    def aligned(self, a: list[int], b: list[int], raw: bytes) -> tuple | None:
        """(groups as text, linked pairs as bytes, tokens of A, pairs of large groups with their times) of two token lists over raw; None if
        their bytes are others."""
        bytes_a, bytes_b, name = self.bytes_a, self.bytes_b, self.name
        if b"".join([bytes_a[x] for x in a]) != raw or b"".join([bytes_b[x] for x in b]) != raw:
            return None
        if len(a) == 1 and len(b) == 1:
            return name[a[0]] + "|" + name[b[0]], (a[0] << B_BITS | b[0]).to_bytes(8, sys.byteorder), 1, None
        ends_a, ends_b = list(accumulate([len(bytes_a[x]) for x in a])), list(accumulate([len(bytes_b[y]) for y in b]))
        said: list[str] = []
        pairs, large = [], None
        i = j = from_a = from_b = 0
        n = len(a)
        while i < n:
            # Whichever list is behind moves on; where both end at one byte, a group ends.
            end_a, end_b = ends_a[i], ends_b[j]
            if end_a < end_b:
                i += 1
                continue
            j += 1
            if end_b < end_a:
                continue
            i += 1
            if i - from_a == 1 and j - from_b == 1:
                x, y = a[from_a], b[from_b]
                said.append(name[x] + "|" + name[y])
                pairs.append(x << B_BITS | y)
            else:
                own, other = a[from_a:i], b[from_b:j]
                said.append(",".join([name[x] for x in own]) + "|" + ",".join([name[y] for y in other]))
                if len(own) * len(other) <= LARGE:
                    pairs += [x << B_BITS | y for x in own for y in other]
                else:
                    large = large or Counter()
                    for x, times in Counter(own).items():
                        for y, more in Counter(other).items():
                            large[x << B_BITS | y] += times * more
            from_a, from_b = i, j
        return ";".join(said), array("q", pairs).tobytes(), n, large

    def _found(self, block: list[str]) -> list[tuple | None]:
        """What each segment of a block comes to; those not met before are encoded together."""
        young, old = self.young, self.old
        new = [s for s in set(block) if s not in young]
        if old:
            for s in new:
                if s in old:
                    young[s] = old[s]
            new = [s for s in new if s not in young]
        if new:
            for s, x, y in zip(new, self.encode_a([" " + s for s in new]), self.b.encode(new, num_threads=1), strict=True):
                young[s] = self.aligned(x, y, b" " + s.encode("utf-8", "surrogatepass"))
        each = [young[s] for s in block]
        for s in new:
            if len(s) > SHORT:
                del young[s]
        if len(young) > REMEMBERED // 2:  # what is met again moves on to the next generation
            self.old, self.young = young, {}
        return each

    def documents(self, texts: list[str | None]) -> list[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """Of each whole text: tokens of A and B, groups, links, digest of the groups, distinct pairs and their links. Short texts are looked up
        together, long ones in blocks."""
        out: list = [self._together([])] * len(texts)
        short = {}
        for k, text in enumerate(texts):
            if text and self.cuts and len(text) <= GATHER:
                short[k] = CUT.split(text)
            elif text:
                out[k] = self._together(self._found(block) for block in self.segments(text))
        each, start = self._found([s for own in short.values() for s in own]), 0
        for k, own in short.items():
            out[k] = self._together([each[start : start + len(own)]])
            start += len(own)
        return out

    def _together(self, blocks) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """What the blocks of a text's segments come to; nothing if a segment has no alignment."""
        digest, large = hashlib.sha256(), Counter()
        n_a = tokens = groups = 0
        codes, times = [], []
        for each in blocks:
            if None in each:
                codes = []
                break
            said, linked, numbers, larger = zip(*each, strict=True)
            said = ";".join(said)
            digest.update((";" + said if codes else said).encode())
            n_a += sum(numbers)
            groups += said.count("|")
            tokens += said.count(",") + said.count(";") + said.count("|") + 1
            found, n = np.unique(np.frombuffer(b"".join(linked), np.int64), return_counts=True)
            codes.append(found)
            times.append(n)
            for more in filter(None, larger):
                large.update(more)
        if not codes:
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        if large:
            codes.append(np.fromiter(large.keys(), np.int64, len(large)))
            times.append(np.fromiter(large.values(), np.int64, len(large)))
        found, n = (codes[0], times[0]) if len(codes) == 1 else _summed(np.concatenate(codes), np.concatenate(times))
        return n_a, tokens - n_a, groups, int(n.sum()), digest.hexdigest(), found, n


def _summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(codes, return_inverse=True)
    out = np.zeros(len(distinct), np.int64)
    np.add.at(out, place, times)
    return distinct, out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def documents_aligned(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times (links of each pair), key (a number of its own) of every document."""
    names = ["doc_id", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(tables):
        aligner = _aligner(path_a, path_b)
        for table in tables:
            texts = table["text"].tolist()
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and size < GATHER:
                    size += len(texts[stop] or "")
                    stop += 1
                done = aligner.documents(texts[start:stop])
                yield packed([(i, k, *x) for i, k, x in zip(table["doc_id"][start:stop], table["key"][start:stop], done, strict=True)])
                start = stop

    def packed(done):
        return pd.DataFrame(done, columns=names)

    # Ids travel as text: pandas would read whole numbers with nulls among them as floats.
    rows = docs.select(F.col(id_column).cast("string").alias("doc_id"), F.monotonically_increasing_id().alias("key"), F.col(text_column).alias("text"))
    schema = "doc_id string, key long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    kind = docs.schema[id_column].dataType
    return written(rows.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(kind)), "aligned", compression="zstd")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (the greatest n of its A id)."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    own = Window.partitionBy(F.shiftright("pair", B_BITS))  # at most one row for each id of B
    return written(counts.withColumn("best", F.max("n").over(own)), "pair-counts")


def aligned(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    rows = documents_aligned(docs, path_a, path_b, id_column, text_column)
    counts = pair_counts(rows)
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * COMMON > total
    links = rows.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("key", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    met = links.join(F.broadcast(counts.where(often)), "pair", "left")
    sums = [F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")]
    common = met.where("n IS NOT NULL").groupBy("key").agg(*sums)
    rare = met.where("n IS NULL").select("key", "pair", "times").join(counts.where(~often), "pair").groupBy("key").agg(*sums)
    whole = common.unionByName(rare).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.drop("pairs", "times").join(whole, "key", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def links_of(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """a_id, b_id, n_documents, is_best of every id pair that the corpus links: the alignment itself."""
    counts = pair_counts(documents_aligned(docs, path_a, path_b, id_column, text_column))
    low = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    return counts.select(F.shiftright("pair", B_BITS).cast("int").alias("a_id"), low.cast("int").alias("b_id"), F.col("n").alias("n_documents"), (F.col("n") == F.col("best")).alias("is_best"))
