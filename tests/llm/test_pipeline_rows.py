"""The pipeline's rows against its five stages in plain Python, over texts that only the base rules of the first stage judge."""

import base64
import hashlib
import random
import re

import pytest

import corpus_pipeline

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = "the of and river stone walks slowly under bridge light cold morning paper engine wide harbour field window letter garden to in a is was that with for".split()


def fixture():
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)) + "."
    texts, passage, item = [say(60) for _ in range(8)], say(25), say(18)
    near = texts[0].split()
    near[-1] = "other"
    edited = item.split()
    edited[4] = "edited"
    texts += [texts[1], " ".join(near), f"{say(40)} {passage} {say(40)}", f"{say(40)} {passage} {say(30)}", f"{say(40)} {' '.join(edited)} {say(40)}", "far too short", "", say(20) + " same words" * 60]
    return [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], [(1, item), (2, say(30))]


def plain(docs, items):
    import tiktoken

    texts = {}
    for i, text, *_ in docs:  # base rules: words, words in repeated runs of eight
        w = text.split()
        runs = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        repeated = {j for k, run in enumerate(runs) if runs.count(run) > 1 for j in range(k, k + 8)}
        if len(w) >= 20 and 100 * len(repeated) <= 30 * len(w):
            texts[i] = text
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.lower().split()) for i, t in texts.items())}
    root = {i: i for i in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    texts = {i: t for i, t in texts.items() if root[i] == i}
    seen, cut = set(), {}
    for i in sorted(texts):
        runs = [texts[i][k : k + 50] for k in range(len(texts[i]) - 49)]
        gone = {j for k, run in enumerate(runs) if run in seen for j in range(k, k + 50)}
        seen |= set(runs)
        cut[i] = "".join(c for j, c in enumerate(texts[i]) if j not in gone)

    def leaks(text):
        w = re.findall(r"[a-z0-9]+", text.lower())
        for _, item in items:
            v = re.findall(r"[a-z0-9]+", item.lower())
            if any(100 * sum(x == y for x, y in zip(w[a : a + 13], v[b : b + 13], strict=True)) >= 80 * 13 for a in range(len(w) - 12) for b in range(len(v) - 12)):
                return True
        return False

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, text in cut.items():
        if not leaks(text):
            ids = coder.encode_ordinary(text)
            want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return want, texts, cut


def test_rows(spark, tmp_path):
    docs, items = fixture()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want, texts, cut = plain(docs, items)
    assert {i for i, *_ in docs} - set(texts) == {8, 9, 13, 14, 15} and len(cut[11]) < len(texts[11]) and 12 not in [r[0] for r in want]
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(want)
