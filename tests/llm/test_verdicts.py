"""Quality verdicts of all documents against votes, EM and posterior in plain Python, document by document."""

import math
import os
import re
import unicodedata
from collections import Counter

import pytest

from vicinal.llm import quality

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text) if w]


def votes(text):
    w = words_of(text)
    n, chars = len(w), sum(map(len, w))
    windows = [tuple(w[i : i + 8]) for i in range(n - 7)]
    often = Counter(windows)
    repeats = len({j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 8)})
    lines = [x for x in text.split("\n") if words_of(x)]
    copies = len(lines) - len(set(lines))
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    upper = sum(unicodedata.category(c) == "Lu" for c in text)
    length = chars / n if n else None
    failed = n < 20 or 100 * repeats > 30 * n
    return failed, (
        -1 if n < 20 else 1 if n >= 50 else 0,
        0 if length is None else -1 if length < 2 or length > 15 else 1 if 3 <= length <= 10 else 0,
        -1 if n and symbols / n > 0.3 else 0,
        -1 if chars and symbols / chars > 0.05 else 0,
        -1 if copies >= 2 and copies / len(lines) > 0.3 else 0,
        -1 if n and repeats / n > 0.2 else 0,
        -1 if chars and upper / chars > 0.4 else 0,
    )


def probabilities(every):
    """Probability of each document to be good after a hundred rounds of EM with the share of good ones held at 0.85."""
    rules = range(len(every[0]))
    on_good, on_bad = [{-1: 0.004, 0: 0.296, 1: 0.7} for _ in rules], [{-1: 0.4, 0: 0.2, 1: 0.4} for _ in rules]

    def good(vote):
        odds = math.log(0.85 / 0.15)
        for r in rules:
            says = math.log(on_good[r][vote[r]] / on_bad[r][vote[r]]) if vote[r] else 0.0
            odds += max(0.0, says) if vote[r] > 0 else min(0.0, says)
        return 1 / (1 + math.exp(-odds))

    for _ in range(100):
        p = [good(v) for v in every]
        sums = [[{k: 1.0 for k in (-1, 0, 1)} for _ in rules] for _ in range(2)]
        for v, x in zip(every, p, strict=True):
            for r in rules:
                sums[0][r][v[r]] += x
                sums[1][r][v[r]] += 1 - x
        on_good, on_bad = ([{k: y / sum(s.values()) for k, y in s.items()} for s in side] for side in sums)
    return [good(v) for v in every]


def test_every_verdict(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    found = {i: votes(t) for i, t in texts.items()}
    p = dict(zip(found, probabilities([v for _, v in found.values()]), strict=True))
    got = {r["doc_id"]: r for r in quality.judged(docs).collect()}
    assert set(got) == set(texts)
    for i, (failed, _) in found.items():
        assert got[i]["p_good"] == pytest.approx(p[i], rel=1e-9), i
        assert (got[i]["base_failed"], got[i]["kept"]) == (failed, not failed and p[i] >= 0.5), i
    assert sorted(r["doc_id"] for r in quality.filtered(docs).collect()) == sorted(i for i, r in got.items() if r["kept"])
    assert 0 < sum(not r["kept"] and not r["base_failed"] for r in got.values())  # the method decides some
