"""Language identification by cross-parsing: the language whose text explains a document in the fewest phrases wins.

For each language a suffix automaton is built over a bounded sample of labelled text. A document is parsed greedily
into the longest strings that occur in the sample; phrases times log2(sample length) over document length is an
estimate of its entropy relative to that language (Ziv and Merhav). The lowest estimate wins. Automata are transition
tables, dense for the most frequent letters and sorted lists for all others, and a worker moves through them with many
blocks of text at once, one character a step, in NumPy.

Whole texts are parsed, and phrases run across blocks: each block is parsed from its start as if a phrase began there,
and the block before is parsed TAIL characters into it. From the first place where both begin a phrase they agree, so the
count is that of one parse from the text's start to its end. Where they don't meet, the parse is carried on alone.

The sample is bounded, whatever the input: of each language at most ``rows`` documents, ``chars`` characters and, so that
many documents are heard, ``chars_each`` of one, at a place that its id's hash picks. With many languages each
gets an equal part of ``chars_in_all``; no language is left out.

Defined cases: a null text, or one without letters, is ``und`` with score 0; ties go to the first language in
code-point order; with one language only its score is 1; with nothing labelled every row is ``und``; repeated rows get
equal answers; null ids are carried along; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a block, how far the block before is parsed into it, blocks and languages moved at once, letters in the dense tables.
BLOCK, TAIL, LANES, LANGUAGES, ALPHABET = 512, 96, 8192, 8, 60


def transitions(codes: list[int]) -> list[dict[int, int]]:
    """The suffix automaton of a string of codes: by state, where each code leads."""
    link, length, moves = [-1], [0], [{}]
    last = 0
    for c in codes:
        cur = len(moves)
        link.append(0), length.append(length[last] + 1), moves.append({})
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(moves)
                link.append(link[q]), length.append(length[p] + 1), moves.append(dict(moves[q]))
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return moves


def automaton(codes: list[int], width: int) -> np.ndarray:
    """The suffix automaton of a string of codes: row = state, column = code, -1 = no such string."""
    return _dense(transitions(codes), width)


def _dense(moves: list[dict[int, int]], width: int) -> np.ndarray:
    """The moves by codes below width."""
    table = np.full((len(moves), width), -1, dtype=np.int32)
    for state, out in enumerate(moves):
        for c, to in out.items():
            if c < width:
                table[state, c] = to
    return table


class Model:
    """Automata of all languages in one table. Codes: 0 not a letter, 1 a letter of no sample, then the frequent ones,
    one that pads, then all other letters of the samples, whose moves stand in a sorted list."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(lang for lang, text in samples.items() if any(c.isalpha() for c in text))
        letters = Counter(c for lang in self.langs for c in samples[lang].lower() if c.isalpha())
        ranked = [c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))]
        self.pad = min(len(ranked), ALPHABET) + 2
        self.total = len(ranked) + 3
        code = np.zeros(sys.maxunicode + 1, dtype=np.min_scalar_type(self.total))
        code[[cp for cp in range(sys.maxunicode + 1) if chr(cp).isalpha()]] = 1
        for k, c in enumerate(ranked):
            code[ord(c)] = k + 2 + (k >= ALPHABET)
        self.code = code
        width, tables, self.bits, roots, states, keys, values = self.pad + 1, [], [], [], 0, [], []
        for lang in self.langs:
            codes = self.encode(samples[lang]).tolist()
            moves = transitions(codes)
            table = _dense(moves, width)
            table[table >= 0] += states
            table[:, self.pad] = np.arange(states, states + len(table))
            for state, out in enumerate(moves):
                for c, to in out.items():
                    if c > self.pad:
                        keys.append((state + states) * self.total + c)
                        values.append(to + states)
            roots.append(states)
            states += len(table)
            tables.append(table)
            self.bits.append(np.log2(len(codes) + 1))
        self.width = width
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys, self.values = np.array(keys, dtype=np.int64)[order], np.array(values, dtype=np.int32)[order]
        self.roots = np.array(roots, dtype=np.int32)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, dtype=np.int32)
        restart = np.full((len(self.langs), self.total), -1, dtype=np.int32)
        if tables:
            restart[:, :width] = self.table.reshape(-1, width)[self.roots]
            restart[:, width:] = self._listed(self.roots[:, None], np.arange(width, self.total))
        self.restart = np.where(restart < 0, self.roots[:, None], restart).astype(np.int32)

    def _listed(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Where codes outside the dense table lead."""
        wanted = state.astype(np.int64) * self.total + codes
        if not len(self.keys):
            return np.full(wanted.shape, -1, dtype=np.int32)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], -1).astype(np.int32)

    def encode(self, text: str) -> np.ndarray:
        return self.code[np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)]

    def moved(self, lanes: np.ndarray, langs: slice) -> tuple[np.ndarray, np.ndarray]:
        """Where a phrase ends before a character (step, language, lane), and the last states; lanes: a column for each, padded below."""
        roots, restart = self.roots[langs], self.restart[langs]
        state = np.repeat(roots[:, None], lanes.shape[1], axis=1)
        ends = np.zeros((len(lanes), len(roots), lanes.shape[1]), dtype=bool)
        for k, codes in enumerate(lanes):
            other = np.flatnonzero(codes > self.pad)
            to = self.table[state * np.int32(self.width) + np.minimum(codes, self.pad)]
            if len(other):
                to[:, other] = self._listed(state[:, other], codes[other])
            missed = to < 0
            ends[k] = missed
            state = np.where(missed, restart[:, codes], to)
        return ends, state

    def _step(self, lang: int, state: int, code: int) -> tuple[bool, int]:
        """One character alone: whether a phrase ends before it, and the next state."""
        if code <= self.pad:
            to = int(self.table[state * self.width + code])
        else:
            to = int(self._listed(np.array([state]), np.array([code]))[0])
        return (True, int(self.restart[lang, code])) if to < 0 else (False, to)

    def _carried(self, lang: int, texts_lanes: list[np.ndarray], ends: np.ndarray, state: np.ndarray, meets: np.ndarray) -> int:
        """Phrases of one text, block by block; its lanes' ends and states are given, and where each lane meets the one before (-1: not)."""
        total, now = 1 + int(ends[:BLOCK, 0].sum()), None  # now: the parse's state at the start of the next block, None if it is its lane's
        for k in range(1, len(texts_lanes)):
            codes = texts_lanes[k]
            at = 0
            if now is None:
                if meets[k] >= 0:
                    total += int(ends[BLOCK : BLOCK + meets[k], k - 1].sum()) + int(ends[meets[k] : BLOCK, k].sum()) + (meets[k] == 0 and not ends[0, k])
                    continue
                at = min(TAIL, len(codes))
                total += int(ends[BLOCK : BLOCK + at, k - 1].sum())
                now = int(state[k - 1])
            stop = min(BLOCK, len(codes))
            while at < stop:
                missed, now = self._step(lang, now, int(codes[at]))
                total += missed
                at += 1
                if missed and (at == 1 or ends[at - 1, k]):
                    total += int(ends[at:BLOCK, k].sum())
                    now = None
                    break
        return total

    def parse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases by language and text, length in characters, whether there is a letter."""
        total = np.zeros((len(self.langs), len(texts)), dtype=np.int64)
        length, lettered = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=bool)
        held: list[tuple[int, list[np.ndarray]]] = []  # texts and their lanes: blocks with TAIL characters of the next one

        def flush():
            pieces = [p for _, own in held for p in own]
            if not pieces:
                return
            order = np.argsort([-len(p) for p in pieces], kind="stable")
            lanes = np.full((len(pieces[order[0]]), len(pieces)), self.pad, dtype=self.code.dtype)
            place = np.empty(len(pieces), dtype=np.int64)
            for k, i in enumerate(order.tolist()):
                lanes[: len(pieces[i]), k], place[i] = pieces[i], k
            first = np.cumsum([0] + [len(own) for _, own in held])
            follows = np.ones(len(pieces), dtype=bool)
            follows[first[:-1]] = False
            for low in range(0, len(self.langs), LANGUAGES):
                langs = slice(low, min(low + LANGUAGES, len(self.langs)))
                ends, state = self.moved(lanes, langs)
                ends, state = ends[:, :, place], state[:, place]  # in order of text
                inside = ends[:BLOCK].sum(axis=0, dtype=np.int32).astype(np.int64)
                meets = np.full((langs.stop - low, len(pieces)), -1, dtype=np.int64)
                counts = inside + ~follows  # of a text's first lane all, and one phrase more
                later = np.flatnonzero(follows)
                if len(later):
                    tail = np.zeros((TAIL, langs.stop - low, len(later)), dtype=bool)
                    reach = ends[BLOCK : BLOCK + TAIL, :, later - 1]
                    tail[: len(reach)] = reach
                    begins = np.zeros_like(tail)
                    own = ends[: min(TAIL, BLOCK), :, later]
                    begins[: len(own)] = own
                    begins[0] = True
                    both = tail & begins
                    meets[:, later] = np.where(both.any(axis=0), both.argmax(axis=0), -1)
                    before = np.cumsum(np.concatenate((np.zeros((1, *tail.shape[1:]), dtype=bool), tail)), axis=0, dtype=np.int16)
                    skipped = np.cumsum(np.concatenate((np.zeros((1, *begins.shape[1:]), dtype=bool), begins)), axis=0, dtype=np.int16)
                    at = np.maximum(meets[:, later], 0)[None]
                    took, left = np.take_along_axis(before, at, 0)[0], np.take_along_axis(skipped, at, 0)[0]
                    counts[:, later] = took + inside[:, later] + ~ends[0][:, later] - left
                lost = meets < 0
                lost[:, ~follows] = False
                summed = np.add.reduceat(counts, first[:-1], axis=1)
                for lang, t in zip(*np.nonzero(np.add.reduceat(lost, first[:-1], axis=1)), strict=True):
                    a, b = first[t], first[t + 1]
                    summed[lang, t] = self._carried(low + lang, held[t][1], ends[:, lang, a:b], state[lang, a:b], meets[lang, a:b])
                total[langs, [d for d, _ in held]] = summed
            held.clear()

        waiting = 0
        for d, text in enumerate(texts):
            codes = self.encode(text)
            length[d], lettered[d] = len(codes), bool((codes > 0).any())
            if lettered[d] and self.langs:
                held.append((d, [codes[k : k + BLOCK + TAIL] for k in range(0, len(codes), BLOCK)]))
                waiting += len(held[-1][1])
                if waiting >= LANES:
                    flush()
                    waiting = 0
        flush()
        return total, length, lettered

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        phrases, length, lettered = self.parse([t or "" for t in texts])
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        entropy = phrases * np.array(self.bits)[:, None] / np.maximum(length, 1)
        best = entropy.argmin(axis=0)
        ranked = np.sort(entropy, axis=0)
        score = ranked[1] / (ranked[0] + ranked[1]) if len(self.langs) > 1 else np.ones(len(texts))
        return [(self.langs[b], float(s)) if ok else ("und", 0.0) for b, s, ok in zip(best, score, lettered, strict=True)]


def held_out(id_column: str = "doc_id"):
    """Whether a document is kept out of learning: crc32 of its id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(labelled: DataFrame, chars: int = 32_000, rows: int = 200, chars_each: int = 1_600, chars_in_all: int = 400_000) -> Model:
    """Learn from labelled rows (doc_id, text, lang); the module's docstring says from what sample."""
    learn = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = learn.groupBy("lang").agg(F.count("*").alias("n")).collect()
    chars = min(chars, max(1, chars_in_all // max(1, len(counts))))
    each = min(chars_each, chars)
    rows = min(rows, 10 * -(-chars // each))
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    limit = learn.sparkSession.createDataFrame([(c["lang"], int((1 << 40) * min(1.0, 2 * rows / c["n"]))) for c in counts], "lang string, limit long") if counts else None
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.char_length("text") - each, F.lit(0)) + 1).cast("int") + 1
    part = F.substring(F.col("text"), start, F.lit(each)).alias("text")
    texts: dict[str, list[str]] = {}
    if limit is not None:
        picked = learn.join(F.broadcast(limit), "lang").where(spot < F.col("limit"))
        for r in picked.select("lang", part, spot.alias("spot"), "doc_id").orderBy("spot", "doc_id").toLocalIterator():
            own = texts.setdefault(r["lang"], [])
            if len(own) < rows:
                own.append(r["text"])
    return Model({lang: "\n".join(x)[:chars] for lang, x in texts.items()})


def predicted(docs: DataFrame, model: Model, keep: list[str], text_column: str = "text") -> DataFrame:
    """The columns in keep, with lang_pred and score, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts, done, out = batch.column(len(keep)), 0, []
            while done < len(batch):  # by some MB of text
                part, size = [], 0
                while done < len(batch) and size < 4_000_000:
                    part.append(texts[done].as_py())
                    size += len(part[-1] or "")
                    done += 1
                out += shared.value.predict(part)
            langs, scores = pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], langs, scores], [*keep, "lang_pred", "score"])

    plain = docs.select(*keep, F.col(text_column).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    return plain.mapInArrow(run, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, chars: int = 32_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs, learnt from the labelled rows that aren't held out."""
    rows = docs.select("doc_id", "text", "lang")
    model = fit(rows.where(~held_out()), chars)
    return predicted(rows.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])
