"""Operators on documents against brute force, over a small table with nulls, empty, short, long, equal and near texts."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib

import pytest

from vicinal.llm import bpe, dealing, decontaminate, jaccard, langid, quality, sharding, suffixes

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig long, n long, root string"
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = "the of and river stone Über café naïve walks slowly under bridge light 42 x1 cold morning paper engine wide".split()


def rows():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))
    base, passage = say(120), say(70)
    texts = [None, "", " \t\n ", "one", "two words", base, base, base.replace("river", "RIVER"), base + " end", passage, say(60) + "\n" + passage + "\n" + say(30)]
    for _ in range(25):  # near copies, each with an edit or two
        w = base.split()
        for _ in range(rng.choice([1, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    texts += [say(rng.randrange(1, 200)) for _ in range(20)]
    texts += ["spam " * 400, say(9) * 30, "a\nb\na\nb\n" * 20, "### $$$ " * 60 + say(40), say(4000), "日本語 テキスト " * 40, "x" * 5000]
    out = [(i, t, rng.choice(["en", "de", None]), "hot" if i % 3 else rng.choice(["s1", None]), len(t or ""), 1, 2, "r") for i, t in enumerate(texts)]
    out.append(out[6])  # a repeated row
    out.append((None, base, "en", "hot", 5, 1, 2, "r"))
    out.append((None, None, None, None, None, None, None, None))
    return out


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(sets, percent):
    """Root by row, from all pairs."""
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("k", "percent", "often", "many"), [(4, 85, 50, False), (5, 80, 3, False), (2, 60, 10, False), (4, 85, 50, True), (2, 60, 10, True)])
def test_jaccard(docs, monkeypatch, k, percent, often, many):
    monkeypatch.setattr(jaccard, "AT_LEAST", often)  # below 50 some n-grams count as frequent here
    if many:  # some tens of fragments and buckets, dealt in three rounds, buffers of a few texts
        for module, name, value in ((jaccard, "FRAGMENT", 300), (dealing, "FAN", 4), (dealing, "GATHER", 4000), (dealing, "RANGE", 30_000)):
            monkeypatch.setattr(module, name, value)
    sets = []
    for r in ROWS:
        w = words(lowered(r[1]))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    root = components(sets, percent)
    least = {}
    for i, r in enumerate(ROWS):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], math.inf), r[0])
    want = sorted(((r[0], len(sets[i]), least.get(root[i]) if sets[i] else r[0]) for i, r in enumerate(ROWS)), key=str)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.joined(docs, k, percent).collect()), key=str)
    assert got == want


def test_jaccard_of_long_and_repeating_texts(spark):
    rng = random.Random(4)
    long = " ".join(rng.choices(WORDS, k=300_000))
    table = [(1, long), (2, long + " end"), (3, "spam " * 1_000_000), (4, "spam " * 999_999), (5, "x" * 5_000_000), (6, "x" * 5_000_001), (7, long[: len(long) // 2])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.joined(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert [got[i][1] for i in range(1, 8)] == [1, 1, 3, 3, 5, 6, 7] and got[3][0] == 1 and got[5][0] == 1


def test_one_of_each(docs):
    kept = jaccard.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 5 in ids and 6 not in ids and ids.count(None) == 2 and {0, 1, 2, 3} <= set(ids)


def test_one_row_of_each(spark):
    text = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcd"]
    table = [(1, text[0]), (1, text[0]), (2, text[0]), (2, text[1]), (3, text[2]), (3, text[2] + " end"), (None, text[3]), (None, text[3]), (None, text[3] + " end"), (4, ""), (4, ""), (None, None)]
    kept = jaccard.one_of_each(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()
    got = sorted(((r["doc_id"], (r["text"] or "").removesuffix(" end")) for r in kept), key=str)
    assert got == sorted([(1, text[0]), (2, text[1]), (3, text[2]), (None, text[3]), (4, ""), (4, ""), (None, "")], key=str)


def cut_rows(rows):
    """op2's rows by definition."""
    first = {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        raw, own = (rows[i][1] or "").encode(), math.inf if rows[i][0] is None else rows[i][0]
        for k in range(len(raw) - 49):
            first.setdefault(raw[k : k + 50], own)
    want = []
    for r in rows:
        raw, own = (r[1] or "").encode(), math.inf if r[0] is None else r[0]
        mask = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < own:
                mask[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(raw, mask, strict=True) if not m)
        want.append((r[0], len(raw), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(kept).hexdigest()))
    return want


def digested(docs):
    return [tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in suffixes.digests(docs).collect()]


@pytest.mark.parametrize("many", [False, True])
def test_suffixes(docs, monkeypatch, many):
    if many:  # three rounds of dealing to 40 buckets, texts in parts, buffers of a few pieces
        total = sum(len((r[1] or "").encode()) for r in ROWS)
        for module, name, value in ((suffixes, "BUCKET", total // 40), (suffixes, "CHUNK", 900), (suffixes, "FAN", 4), (suffixes, "RECUT", 2000), (dealing, "GATHER", 4000), (dealing, "RANGE", 30_000)):
            monkeypatch.setattr(module, name, value)
        assert len(dealing.widths(40, suffixes.FAN)) == 3
    want = cut_rows(ROWS)
    assert sorted(digested(docs), key=str) == sorted(want, key=str)
    assert any(0 < w[2] < w[1] for w in want)


def test_suffixes_of_texts_that_repeat_themselves(spark, monkeypatch):
    """Repeats at equal and unequal distances, below and above a string's length, over the edges of parts."""
    monkeypatch.setattr(suffixes, "CHUNK", 1000)
    rng = random.Random(12)
    line, other = "".join(rng.choice("abcdefgh ") for _ in range(70)), "".join(rng.choice("abcdefgh ") for _ in range(130))
    texts = ["x" * 3000, "x" * 3001, "ab" * 1500, "ba" * 700, line * 40, (line + other) * 9, line * 3 + other + line * 2 + "z" + line, "y" + other * 2, "x" * 49, "x" * 50, "xx" + line + "x" * 2500, "spam " * 500, "spam " * 501]
    rng.shuffle(texts)
    table = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[3])]
    own = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    assert sorted(digested(own), key=str) == sorted(cut_rows(table), key=str)


def test_suffixes_of_long_texts(spark):
    """One byte repeated 20 million times, twice, and two long texts that share a passage."""
    rng = random.Random(13)
    long = "".join(rng.choices("abcdefghij klmnop", k=3_000_000))
    table = [(1, "=" * 20_000_000), (2, "=" * 20_000_000), (3, long), (4, "q" * 10 + long[1_000_000:1_000_300] + "z" * 40)]
    got = {r[0]: r[1:] for r in digested(spark.createDataFrame(table, "doc_id long, text string"))}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (20_000_000, 0, 0, digest(table[0][1])), 2: (20_000_000, 20_000_000, 1, digest("")), 3: (3_000_000, 0, 0, digest(long)), 4: (350, 300, 1, digest("q" * 10 + "z" * 40))}


def test_suffixes_over_many_chunks(monkeypatch):
    """One task that meets a passage in chunk after chunk, in changing order of ids."""
    import pyarrow as pa

    monkeypatch.setattr(suffixes, "CHUNK", 700)
    monkeypatch.setattr(suffixes, "MANY", 2)
    rng = random.Random(8)
    passage = " ".join(rng.choice(WORDS) for _ in range(25))
    texts = [" ".join(rng.choice(WORDS) for _ in range(12)) + passage + str(i % 5) for i in range(60)]
    ids = list(range(60))
    rng.shuffle(ids)
    sent = collections.defaultdict(list)
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([t.encode() for t in texts], pa.binary())], ["id", "text"])
    for out in suffixes._pieces(1)(iter([batch])):
        sent[out.column(0)[0].as_py()].append(out.column(2)[0].as_py())
    blobs = [*sent[1], *[x for _, x in suffixes._spans_by_range(*suffixes._sorted_bucket(list(sent[0])), 1, 1)]]
    spans = {r["_id"]: list(zip(r["starts"], r["stops"], strict=True)) for r in suffixes._joined_spans(pa.table({"blob": blobs})).to_pylist()}
    first = {}
    for i, t in sorted(zip(ids, texts, strict=True)):
        raw, mask = t.encode(), bytearray(len(t.encode()))
        for k in range(len(raw) - 49):
            if first.setdefault(raw[k : k + 50], i) < i:
                mask[k : k + 50] = b"\1" * 50
        assert spans.get(i, []) == [m.span() for m in re.finditer(b"\1+", bytes(mask))]


def test_suffix_rounds():
    """The suffix order by rounds against sorted strings."""
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 60):
        rows = rng.integers(97, 99, (n, suffixes.WIDTH)).astype(np.uint8)
        rows[n // 2 :, 30:] = rows[0, 30:]
        low, high = rng.integers(0, 5, n), rng.integers(20, suffixes.PLACES, n)
        ids = rng.integers(0, 50, n)
        got = suffixes.first_holders(rows, low, high, ids)
        for c in range(suffixes.PLACES):
            least = {}
            for i in range(n):
                if low[i] <= c <= high[i]:
                    s = rows[i, c : c + 50].tobytes()
                    least[s] = min(least.get(s, suffixes.LAST), ids[i])
            for i in range(n):
                assert got[i, c] == (least[rows[i, c : c + 50].tobytes()] if low[i] <= c <= high[i] else suffixes.LAST)


def test_deduplicated(docs):
    out = suffixes.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    texts = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
    assert texts[6]["text"] == "" and texts[6]["n_chars"] == 0 and texts[5]["text"] == ROWS[5][1] and texts[0]["text"] is None
    assert suffixes._without("aéé".encode(), [2], [4]) == "aéé" and suffixes._without("aééb".encode(), [1], [5]) == "ab"


def base_counts(text):
    w = words(text)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(docs):
    got = {}
    for r in quality.judged(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for row in ROWS:
        n, chars, symbols, dups, repeats = base_counts(row[1])
        failed = n < 20 or 100 * repeats > 30 * n
        for r in got[row[0]]:
            if row[0] is not None:
                assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == (n, chars, symbols, dups, repeats, failed)
            assert not (r["base_failed"] and r["kept"]) and 0 <= r["p_good"] <= 1
    junk = next(i for i, r in enumerate(ROWS) if (r[1] or "").startswith("###"))
    assert not got[junk][0]["kept"] and got[5][0]["kept"]
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(i for i, rs in got.items() for r in rs if r["kept"])


def test_votes_by_hand():
    """One round of EM in plain arithmetic, and the posterior's direction."""
    rules = ["a", "b"]
    patterns = [({"a": 1, "b": 0}, 90), ({"a": -1, "b": -1}, 10)]
    model = quality.fit_votes(patterns, rules, good=0.85, rounds=1)
    odds = math.log(0.85 / 0.15)
    p = [1 / (1 + math.exp(-(odds + math.log(0.7 / 0.4)))), 1 / (1 + math.exp(-(odds + 2 * math.log(0.004 / 0.4))))]
    good = [1 + 10 * p[1], 1.0, 1 + 90 * p[0]]
    assert model.on_good["a"] == pytest.approx([g / sum(good) for g in good])
    odds, weights = quality.fit_votes(patterns, rules).weights()
    assert weights["a"][-1] < 0 <= weights["a"][1] and odds > 0


def test_decontamination(spark, docs):
    rng = random.Random(9)
    item = [rng.choice("abcdefghij") + str(rng.randrange(1000)) for _ in range(30)]
    swapped = list(item)
    swapped[3], swapped[17] = "other", "words"
    short = "seven small words stand here right now".split()
    table = [
        (1, "intro " + " ".join(item).upper() + " outro"), (2, " ".join(swapped)), (3, " ".join(item[:22])), (4, " ".join(item[:12])),
        (5, " ".join(short)), (6, "seven small words stand here left now"), (7, None), (8, ""), (None, " ".join(item)), (1, " ".join(item)),
    ]
    own = spark.createDataFrame([(i, t, "k", 0) for i, t in table], "doc_id long, text string, item_id string, key int")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, " ".join(short)), (12, "too short"), (13, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(own, bench).collect()}
    assert got == {(1, 10), (2, 10), (3, 10), (5, 11), (6, 11), (None, 10)}  # of seven words six are enough
    left = decontaminate.clean(own, bench)
    assert left.columns == own.columns and sorted(r["doc_id"] for r in left.collect()) == [4, 7, 8]
    assert sorted(r["doc_id"] for r in decontaminate.clean(own, bench, shortest=8).collect()) == [4, 5, 6, 7, 8]
    assert decontaminate.contaminated(own, bench.where("false")).count() == 0
    assert decontaminate.contaminated(docs, bench).count() == 0


def plain_overlaps(texts, items):
    """(text, item): (words matched, window), every place of every item against every place of every text."""
    out = {}
    for i, text in texts:
        w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
        for k, item in items:
            v = [x for x in re.split(r"[\W_]+", (item or "").lower()) if x]
            n = min(len(v), 13)
            best = max((sum(w[at + x] == v[own + x] for x in range(n)) for at in range(len(w) - n + 1) for own in range(len(v) - n + 1)), default=-1) if n else -1
            if n and 100 * best >= 80 * n:
                out[i, k] = (best, n)
    return out


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_decontamination_of_all_lengths(spark, monkeypatch, block):
    """Items of 1 to 20 words, some with words changed, repeated words, and items within items, against every place of every text."""
    monkeypatch.setattr(decontaminate, "BLOCK_SEEDS", block)
    rng = random.Random(12)
    say = lambda n: [rng.choice("abcdefghijklmnop") + str(rng.randrange(30)) for _ in range(n)]
    items = [(n, " ".join(say(n))) for n in range(1, 21)] + [(30, "la " * 40), (31, "la la la"), (32, "do re mi " * 9)]
    texts = [(1, None), (2, ""), (3, "la " * 60), (4, "do re mi do re mi fa " * 8), (5, "la")]
    for n, item in items[:20]:
        for changes in range(4):
            w = item.split()
            for at in rng.sample(range(n), min(n, changes)):
                w[at] = "changed"
            texts.append((100 * n + changes, " ".join(say(5) + w + say(5)) if changes % 2 else " ".join(w)))
    bench, own = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    want = plain_overlaps(texts, items)
    got = {(r["doc_id"], r["item_id"]): (r["matched_words"], r["window_words"]) for r in decontaminate.contaminated(own, bench).collect()}
    assert got == want and (400, 4) in got and (1002, 10) in got
    assert {r["doc_id"] for r in decontaminate.clean(own, bench).collect()} == {i for i, _ in texts} - {i for i, _ in want}


def test_decontamination_of_one_word_repeated(spark):
    """Twenty thousand equal words on both sides: places of an item that look alike are one."""
    import time

    table = [(1, "la " * 20_000), (2, "la " * 9 + "x"), (3, "other words"), (4, "do re " * 10_000)]
    own, bench = spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame([(1, "la " * 20_000), (2, "do re " * 9_000)], "item_id long, text string")
    began = time.time()
    got = {(r["doc_id"], r["item_id"]): r["matched_words"] for r in decontaminate.contaminated(own, bench).collect()}
    assert got == {(1, 1): 13, (4, 2): 13} and time.time() - began < 60
    phrase = "one phrase of six small words"
    many = spark.createDataFrame([(k, f"{phrase} item {k} has others {k * 7} {k * 11} {k * 13} and {k * 17} besides {k * 19}") for k in range(300)], "item_id long, text string")
    texts = spark.createDataFrame([(k, phrase + f" text {k}") for k in range(50)], "doc_id long, text string")
    assert decontaminate.clean(texts, many).count() == 50


def test_decontamination_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, " ".join(str(rng.randrange(10**6)) for _ in range(25))) for i in range(12)]
    bench, own = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame([(100 + i, "pre " + t) for i, t in items], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_SEEDS", 300)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(own, bench).collect()} == {(100 + i, i) for i in range(12)}


def test_decontamination_against_the_definition(spark, monkeypatch):
    """Every way to change two words of a passage, at random places of items of several lengths, in pieces and blocks."""
    monkeypatch.setattr(decontaminate, "BLOCK_SEEDS", 400)
    monkeypatch.setattr(decontaminate, "PIECE", 40)
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghijklmnop") + str(rng.randrange(60))
    items = [[word() for _ in range(n)] for n in (13, 12, 12, 14, 30, 150)]
    texts = []
    for item in items[:3]:
        for spots in itertools.combinations(range(len(item)), 2):
            texts.append([word() for _ in range(rng.randrange(4))] + [f"x{k}" if k in spots else w for k, w in enumerate(item)] + [word() for _ in range(rng.randrange(4))])
    for _ in range(150):
        item = rng.choice(items)
        a = rng.randrange(max(1, len(item) - 12))
        texts.append([word(), *[w if rng.random() < 0.85 else word() for w in item[a : a + rng.choice([9, 13, 14, 20, 40])]], word()])
    own = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    want = {}
    for i, t in enumerate(texts):
        for j, v in enumerate(items):
            n = min(13, len(v))
            best = max((sum(x == y for x, y in zip(t[a : a + n], v[b : b + n], strict=True)) for a in range(len(t) - n + 1) for b in range(len(v) - n + 1)), default=0)
            if 100 * best >= 80 * n:
                want[i, j] = (best, n)
    assert len(want) > 250
    assert {(r["doc_id"], r["item_id"]): (r["matched_words"], r["window_words"]) for r in decontaminate.contaminated(own, bench).collect()} == want


def test_masks_leave_no_two_changes_unseen():
    for n in (12, 13):
        for spots in itertools.combinations(range(n), 2):
            assert any(not set(spots) & {p + at for p in m} for m in decontaminate.masks_of(n) for at in range(n - m[-1] if n == 13 else 1)), spots


def test_decontamination_with_a_very_long_item_and_text(spark):
    rng = random.Random(6)
    item = [str(rng.randrange(10**9)) for _ in range(100_000)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "z " * 30)], "item_id long, text string")
    own = [(1, " ".join(item[50_000:50_013])), (2, " ".join(item[99_987:])), (3, " ".join(item)), (4, " ".join(item[::2])), (5, "y " * 1_000_000), (6, "z " * 12)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.createDataFrame(own, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_sharding(docs, shards):
    got = sharding.assign_shards(docs, shards).collect()
    assert len(got) == len(ROWS)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    facts = lambda i, t: (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted((facts(r[0], r[1]) for r in ROWS), key=str)


def test_sharding_keeps_the_mixture(spark):
    table = spark.createDataFrame([(i, "t", "big" if i % 3 else f"s{i % 9}") for i in range(3000)], "doc_id long, text string, source string")
    shards = sharding.assign_shards(table, 10).join(table, "doc_id")
    mix = collections.Counter((r["shard"], r["source"]) for r in shards.select("shard", "source").collect())
    total = collections.Counter()
    for (_, s), n in mix.items():
        total[s] += n
    assert all(abs(mix[k, s] - n / 10) <= 2 for s, n in total.items() for k in range(10))


def test_bpe(docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in ROWS:
        ids = plain.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    got = [tuple(r) for r in bpe.digests(docs, VOCABULARY, public_tokenizers.PATTERN).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    codec = bpe.Codec(bpe.PerfectHash(ranks), public_tokenizers.PATTERN)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(every), 2000):  # each between a letter and a number, and after a space
        text = "".join(f"a{c}1 {c}. " for c in every[k : k + 2000])
        assert codec.encode(text) == plain.encode_ordinary(text), k
    for text in ("ab" * 150_000, "x y" * 100_000):
        assert codec.encode(text) == plain.encode_ordinary(text)
    spaces = " " * 200_000 + "x"  # the library itself fails on these
    assert codec.decode(codec.encode(spaces)) == spaces.encode()
    ids = bpe.encoded(docs, VOCABULARY, public_tokenizers.PATTERN)
    back = bpe.decoded(ids, VOCABULARY, public_tokenizers.PATTERN)
    assert sorted(bytes(r["bytes"]) for r in back.collect()) == sorted((r[1] or "").encode() for r in ROWS)


def test_bpe_parts():
    ranks = bpe.read_ranks(VOCABULARY)
    hashed = bpe.PerfectHash(ranks)
    assert sorted(hashed.ranks) == sorted(ranks.values()) and len(hashed.tokens) == len(ranks)
    assert all(hashed.get(t) == r for t, r in list(ranks.items())[::97]) and hashed.get(b"no such token at all") is None
    assert bpe.PerfectHash({}).get(b"a") is None and bpe.PerfectHash({b"a": 7}).get(b"a") == 7
    rng = random.Random(1)
    for _ in range(200):
        token = "".join(rng.choice("abeént ") for _ in range(rng.randrange(1, 40))).encode()
        parts = [bytes([b]) for b in token]
        while True:  # the plain loop
            best = min(((ranks.get(a + b, math.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(math.inf, 0))
            if best[0] == math.inf:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert bpe.merge(token, ranks) == [ranks[p] for p in parts]


def test_bpe_splits_with_the_standard_library_and_remembers_in_generations(monkeypatch):
    """The faster matcher splits like the other two; what is met again outlives the bound."""
    monkeypatch.setattr(bpe, "REMEMBERED", 8)
    codec = bpe.Codec(bpe.PerfectHash({bytes([b]): b for b in range(256)}), public_tokenizers.PATTERN)
    every = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    text = "".join(f"a{c}1 {c}. " for c in every) + "it's  we'll\x1c x\n \n"
    assert codec.pattern(text) is codec.narrow and codec.narrow.findall(text) == codec.strict.findall(text)
    assert codec.pattern("a\U00010000") is codec.plain and codec.pattern("a\U00010940") is codec.strict
    assert bpe.narrow(r"\p{Lu}+|\s") is None and bpe.narrow(r"[\S]+") is None and bpe.narrow("(?i:a)") is None
    made = []
    known = bpe._Remembered(lambda piece: made.append(piece) or (len(piece),))
    for k in range(40):
        assert known["often"] == (5,) and known[f"{k}"] == (len(f"{k}"),) and known["x" * 65] == (65,)
        assert len(known) + len(known.old) <= 8
    assert made.count("often") == 1 and made.count("x" * 65) == 40
    text = "often a word, a wörd \u4e2d 12"
    assert codec.digest(text) == (len(text.encode()), hashlib.sha256(",".join(map(str, text.encode())).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_worker_remembers_little(monkeypatch):
    """What a worker remembers stays beside the stages that follow, so at its bound it takes less than 100 MB."""
    bound = bpe.REMEMBERED
    monkeypatch.setattr(bpe, "REMEMBERED", 40_000)
    codec = bpe.Codec(bpe.PerfectHash({bytes([b]): b for b in range(256)}), public_tokenizers.PATTERN)
    text = "".join(f" word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(15_000))
    tracemalloc.start()
    try:
        codec.digest(text)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(codec.named) == 15_000
    assert held / 15_000 * bound < 100e6


def test_language(spark, docs):
    import public_tokenizers  # noqa: F401

    en, de = "the quick brown fox and the lazy dog went over there with them ", "der schnelle braune Fuchs und der faule Hund gingen über die Straße "
    rng = random.Random(4)

    def say(text):
        w = text.split()
        return " ".join(rng.choice(w) for _ in range(60))

    table = [(i, say(en if i % 2 else de), "en" if i % 2 else "de") for i in range(60)] + [(100, None, "en"), (101, "123 !!", None), (None, say(en), "en"), (3, say(en), "en")]
    own = spark.createDataFrame(table, "doc_id long, text string, lang string")
    got = langid.identify(own).collect()
    assert len(got) == len(table)
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        want = "und" if r["doc_id"] in (100, 101) else "en" if r["doc_id"] is None or r["doc_id"] % 2 else "de"
        assert r["lang_pred"] == want
    assert {r["lang_pred"] for r in langid.identify(own.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")).collect()} == {"und"}
    assert langid.identify(docs).count() == len(ROWS)


def test_automaton():
    codes = [ord(c) - 97 for c in "abcbcabcaab"]
    table = langid.automaton(codes, 4)
    text = "abcbcabcaab"
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            state = 0
            for c in text[i:j]:
                state = table[state, ord(c) - 97]
            assert state >= 0
    state = 0
    for c in "acb":
        state = table[state, ord(c) - 97] if state >= 0 else -1
    assert state == -1


def greedy(text, sample):
    """Phrases of one greedy parse from the start to the end."""
    phrases, now = 1, ""
    for c in text:
        if now + c in sample:
            now += c
        else:
            phrases += 1
            now = c if c in sample else ""
    return phrases


@pytest.mark.parametrize("block, tail", [(512, 96), (7, 3), (16, 16), (5, 9)])
def test_phrases_are_greedy(monkeypatch, block, tail):
    """One parse of the whole text, however it is cut into blocks: short ones, long ones, such as never meet, in several flushes."""
    monkeypatch.setattr(langid, "BLOCK", block)
    monkeypatch.setattr(langid, "TAIL", min(tail, block))
    monkeypatch.setattr(langid, "LANES", 20)
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    rng = random.Random(3)
    samples = {"en": "the cat sat on the mat", "de": "die katze sass auf", "xx": "ab" * 61 + "cab", "yy": "".join(rng.choice("abc") for _ in range(300)), "el": "αβγδ εζη"}
    model = langid.Model(samples)
    texts = ["the cat on a mat", "zzz", "die die die die the", "katze sat" * 100, "ab" * 1000, "αβ" * 300 + "γδ εж", samples["yy"] * 7, "a", "cab" * 401]
    texts += ["".join(rng.choice("abc d") for _ in range(rng.randrange(1, 900))) for _ in range(30)]
    counts = model.parse(texts)[0]
    coded = {lang: "".join(map(chr, model.encode(x))) for lang, x in samples.items()}
    for d, text in enumerate(texts):
        codes = "".join(map(chr, model.encode(text)))
        for lang, n in zip(model.langs, counts[:, d], strict=True):
            assert greedy(codes, coded[lang]) == n, (text, lang)


SPOKEN = {
    "en": ("All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Everyone has the right to life, liberty and security of person. No one shall be held in slavery.", "Everyone has the right to freedom of thought and conscience."),
    "de": ("Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen. Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person. Niemand darf in Sklaverei gehalten werden.", "Jeder Mensch hat das Recht auf Gedankenfreiheit und Gewissensfreiheit."),
    "ru": ("Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность.", "Каждый человек имеет право на свободу мысли и совести."),
    "el": ("Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. Κάθε άτομο έχει δικαίωμα στη ζωή, την ελευθερία και την προσωπική του ασφάλεια.", "Κάθε άτομο έχει το δικαίωμα της ελευθερίας της σκέψης και της συνείδησης."),
    "zh": ("人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。人人有权享有生命、自由和人身安全。任何人不得使为奴隶或奴役。人人有资格享有本宣言所载的一切权利和自由。", "人人有思想、良心和宗教自由的权利。"),
    "ja": ("すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。すべて人は、生命、自由及び身体の安全に対する権利を有する。何人も、奴隷にされ、又は苦役に服することはない。", "すべて人は、思想、良心及び宗教の自由に対する権利を有する。"),
    "ko": ("모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다. 모든 사람은 생명과 신체의 자유와 안전에 대한 권리를 가진다.", "모든 사람은 사상과 양심의 자유에 대한 권리를 가진다."),
    "th": ("มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยเจตนารมณ์แห่งภราดรภาพ ทุกคนมีสิทธิในการมีชีวิต เสรีภาพ และความมั่นคงแห่งบุคคล", "ทุกคนมีสิทธิในเสรีภาพแห่งความคิด มโนธรรม และศาสนา"),
}


def test_eight_languages(spark):
    """Learnt from one text each, told on another; with an alphabet far beyond the dense tables."""
    rows = [(3 * k, text, lang) for k, (lang, (text, _)) in enumerate(SPOKEN.items())]
    rows = [(next(i for i in range(100 * n, 100 * n + 99) if zlib.crc32(str(i).encode()) % 3 != 1), t, lang) for n, t, lang in rows]
    told = [(10_000 + k, text, None) for k, (_, text) in enumerate(SPOKEN.values())]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(spark.createDataFrame(rows + told, "doc_id long, text string, lang string")).collect()}
    assert [got[10_000 + k][0] for k in range(len(SPOKEN))] == list(SPOKEN)
    assert len({score for i, (_, score) in got.items() if i >= 10_000}) == len(SPOKEN)


def test_no_language_is_left_out(spark):
    """600 languages of one word each, and a text of some MB."""
    name = lambda k: "".join(chr(97 + (k // 26**j) % 26) for j in range(3))
    rows = [(next(i for i in range(100 * k, 100 * k + 99) if zlib.crc32(str(i).encode()) % 3 != 1), f"{name(k)}{name(k)[::-1]} " * 3, f"l{k:03d}") for k in range(1, 600)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 599 and model.predict([rows[598][1] * 3])[0][0] == "l599"
    model = langid.Model({lang: text for lang, (text, _) in SPOKEN.items()})
    assert [x for x, _ in model.predict([SPOKEN["en"][1] * 30_000, "x" * 2_000_000, SPOKEN["ko"][1] * 3])][::2] == ["en", "ko"]


def test_many_scripts():
    """Languages whose words have equal lengths, in scripts that more frequent letters of others precede."""
    rng = random.Random(6)
    scripts = {"la": range(97, 123), "ru": range(0x430, 0x450), "el": range(0x3B1, 0x3CA), "he": range(0x5D0, 0x5EB), "th": range(0xE01, 0xE2F), "zh": range(0x4E00, 0x4FF4), "ko": range(0xAC00, 0xADF4)}
    pick = {lang: [[chr(rng.choice(own)) for _ in range(4)] for _ in range(150)] for lang, own in scripts.items()}
    say = lambda lang, n: " ".join("".join(rng.choice(pick[lang])) for _ in range(n))
    model = langid.Model({lang: say(lang, 2000 if lang in ("la", "ru") else 300) for lang in scripts})
    tests = [(lang, say(lang, 12)) for lang in scripts for _ in range(10)]
    assert [lang for lang, _ in model.predict([text for _, text in tests])] == [lang for lang, _ in tests]
    text = say("zh", 3) + " " + say("ko", 3)
    for lang, n in zip(model.langs, model.parse([text])[0][:, 0], strict=True):
        assert n > len(text) / 2 or lang in ("zh", "ko")


CLASHES = ["_row", "_hit", "_id", "_crc", "starts", "n_words", "symbols", "_salt", "component", "at", "seed", "lang_pred"]


def test_clashing_names(spark, docs):
    """Columns that share names with inner ones pass through untouched."""
    wide = docs.selectExpr("*", *[f"doc_id + {k} AS `{c}`" for k, c in enumerate(CLASHES)])
    bench = spark.createDataFrame([(1, "no such words in any of the texts here at all")], "item_id long, text string")
    for out in (jaccard.one_of_each(wide), suffixes.deduplicated(wide), quality.filtered(wide), decontaminate.clean(wide, bench)):
        assert out.columns == wide.columns
        for r in out.where("doc_id IS NOT NULL").collect():
            assert [r[c] for c in CLASHES] == [r["doc_id"] + k for k in range(len(CLASHES))]


def test_write_shards(spark, tmp_path):
    own = spark.createDataFrame([(i, f"t{i}", f"s{i % 3}") for i in range(50)], "doc_id long, text string, source string")
    sharding.write_shards(own, str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()} == {0: 13, 1: 12, 2: 13, 3: 12} and back.select("doc_id").distinct().count() == 50


@pytest.mark.parametrize("name", ["jaccard", "suffixes", "quality", "sharding", "bpe", "langid", "one", "cut", "filter"])
def test_empty(empty, name):
    calls = {
        "jaccard": lambda: jaccard.joined(empty), "suffixes": lambda: suffixes.digests(empty), "quality": lambda: quality.judged(empty), "sharding": lambda: sharding.assign_shards(empty),
        "bpe": lambda: bpe.digests(empty, VOCABULARY, public_tokenizers.PATTERN), "langid": lambda: langid.identify(empty), "one": lambda: jaccard.one_of_each(empty),
        "cut": lambda: suffixes.deduplicated(empty), "filter": lambda: quality.filtered(empty),
    }
    assert calls[name]().count() == 0


def test_recall_of_seeds():
    """Placements of substituted words that leave a passage overlapping but no mask whole: none."""

    def missed(n, k):
        found = 0
        for gone in itertools.combinations(range(n), k):
            starts = range(n - decontaminate.WINDOW + 1) if n > decontaminate.WINDOW else [0]
            window = min(n, decontaminate.WINDOW)
            stands = any(100 * (window - sum(s <= x < s + window for x in gone)) >= decontaminate.NEED * window for s in starts)
            ends = lambda mask: n - mask[-1] if n >= decontaminate.WINDOW else 1
            hit = any(not {at + p for p in mask} & set(gone) for mask in decontaminate.masks_of(n) for at in range(ends(mask)))
            found += stands and not hit
        return found

    assert [missed(n, 2) for n in (12, 13, 14, 15, 16, 20, 25, 30)] == [0] * 8
    assert [missed(n, 1) for n in (12, 13, 14)] == [0, 0, 0] and [missed(n, 3) for n in (14, 20)] == [0, 0]
