"""Operators on pages, against brute force and exact round trips."""

import base64
import hashlib
import io
import random

import numpy as np
import pytest

from vicinal.llm import bloom, htmltext, urls, warc

SCHEMA = "page_id long, url string, html string, text string, key long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


URLS = [
    None, "", "no scheme", "http://", "https://Www.Example.NET/en/1?x#y", "https://example.net/fr/1", "http://a.example.com/de/x", "http://a.example.com/DE/x", "http://a.org/fr/", "http://notorg/fr/",
    "http://net/", "http://net", "http://x.net?/q", "http://m.spam-farm.example.com/en/4", "http://spam-farm.example.com", "http://notspam-farm.example.com/a", "http://user@cheap-pills.example.org:80/a/b", "x://y/p?#/", "http://é.net/ü",
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest[: min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))]
    path = rest[len(host) :]
    path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    return "".join(c.lower() if c < "\x80" else c for c in host), path


def verdict(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return max(fits)[1:]
    bare, rooted = host.rpartition("@")[2].split(":")[0], path or "/"
    at_host = lambda x: bare == x or bare.endswith("." + x)
    listed = any(at_host(h) and (rooted == p or p.endswith("/") and rooted.startswith(p)) for h, p in LISTED)
    return None, "block" if bare and listed else "allow"


LISTED = [(f"{n}.{d}", "/") for n in urls.LISTED_NAMES for d in urls.LISTED_DOMAINS]
for _k in range(urls.LISTED_PAGES):
    _number = int(hashlib.md5(f"{urls.LISTED_SEED}{_k}".encode()).hexdigest()[:8], 16) % urls.LISTED_NUMBERS
    LISTED.append((urls.LISTED_DOMAINS[_k % 3], f"/{urls.LISTED_LANGUAGES[_k // 3 % 4]}/{_number}" + "/" * (_k // 12 % 2)))


@pytest.mark.parametrize("broadcast", [True, False])
def test_urls(spark, monkeypatch, broadcast):
    monkeypatch.setattr(urls, "BROADCAST_ENTRIES", 10**6 if broadcast else 0)
    more = [f"http://{rng}{h}{p}{tail}" for k in (20, 33, 500, 90_000) for h, p in LISTED[k : k + 2] for rng in ("", "m.", "not") for tail in ("", "/", "0", "/x/y?z")]
    rows = [(i, u, "") for i, u in enumerate([*URLS, *more])] + [(4, URLS[4], ""), (None, URLS[13], "")]
    got = urls.judged(table(spark, rows), urls.listed_entries(spark)).collect()
    want = [(i, *split(u), *verdict(*split(u))) for i, u, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_listed_pages(spark):
    pages = table(spark, [(1, "http://a.b.c/x/y", ""), (2, "http://a.b.c/x/y/", ""), (3, "http://b.c/x", ""), (4, "http://c/x/z", "")])
    listed = spark.createDataFrame([("http://B.c/x/y",), ("c/x/",), (None,)], "url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judged(pages, listed, rules=[]).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block"}
    assert {r["verdict"] for r in urls.judged(pages, listed.where("false"), rules=[]).collect()} == {"allow"}
    assert urls.judged(pages.where("false"), listed).count() == 0


def test_long_urls(spark):
    """Urls of 1 MB: of folders, of one folder, of host labels, of one label, listed or not."""
    urls_of = ["http://b.c/" + "x/" * 500_000, "http://b.c/" + "x" * 1_000_000, "http://" + "a." * 500_000 + "b.c/x", "http://" + "a" * 1_000_000 + "/", "http://b.c/x/" + "y" * 1_000_000, "http://c/" + "/" * 1_000_000, "http://@" + "@" * 500_000 + ":" * 500_000]
    pages = table(spark, [(i, u, "") for i, u in enumerate(urls_of)])
    listed = spark.createDataFrame([("b.c/x/",), ("q.r.s.t.u/1/2/3/4/5/6",)], "url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judged(pages, listed, rules=[]).select("page_id", "verdict").collect()}
    assert got == {0: "block", 1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "allow", 6: "allow"}


def test_bloom(spark):
    rng = np.random.default_rng(1)
    keys, others = rng.integers(-(2**63), 2**63, 5000), rng.integers(-(2**63), 2**63, 20000)
    own = bloom.BlockedBloom.sized(len(keys), 1 << 20)
    own.add(keys)
    assert own.might_hold(keys).all() and own.might_hold(others).mean() < 0.03
    tiny = bloom.BlockedBloom.sized(10**9, 1 << 12)
    assert tiny.words.nbytes <= 1 << 12
    built = bloom.build(spark.createDataFrame([(int(k),) for k in keys], "h long"), len(keys))
    assert (built.words == own.words).all()


def test_warc(spark):
    rng = random.Random(3)
    payloads = [None, "", "short", *("<p>" + " ".join(rng.choice("abcd") * 5 for _ in range(200)) for _ in range(30))]
    rows = [(i, f"http://h/{i}", payloads[i % len(payloads)]) for i in range(100)]
    rows += [(None, "u", "only null"), (None, None, "short"), (50, "http://h/50", payloads[50 % len(payloads)]), (200, "a\nb: c", "é" * 50_000)]
    got = sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in warc.archived(table(spark, rows).repartition(3), spark).collect()), key=str)
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    want = []
    for i, _, t in rows:
        raw, f = (t or "").encode(), first.get(t or "")
        revisit = f is not None and f != i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.archived(table(spark, rows).where("false"), spark).count() == 0


def test_record_ids_are_unique_and_strays_go(spark, tmp_path):
    rows = [(k % 20, f"http://h/{k}", f"page {k % 7}" * 50) for k in range(60)] + [(None, "u", "same")] * 3
    folder = f"{tmp_path}/warc"
    (tmp_path / "warc").mkdir()
    (tmp_path / "warc" / "stray.warc.zst").write_bytes(b"half")
    manifest = warc.write_archives(table(spark, rows).coalesce(1), folder)
    files = [r["uri"] for r in manifest.collect()]
    assert sorted(p.name for p in (tmp_path / "warc").glob("*.zst")) == sorted(f.rpartition("/")[2] for f in files)
    records = [warc.parse(raw)[0] for f in files for raw in warc.read_archive(open(f.removeprefix("file:"), "rb"))]
    ids = [f["WARC-Record-ID"] for f in records]
    assert len(ids) == len(rows) == len(set(ids))
    # Every page_id is there three times here, so revisits name the page, and no record.
    assert all("WARC-Refers-To" not in f and f["X-Refers-To-Page-ID"] for f in records if f["WARC-Type"] == "revisit")


@pytest.mark.parametrize("sent", [500_000, 0])
def test_record_ids_are_unique_across_tasks(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(warc, "BROADCAST_IDS", sent)
    rows = [(7, f"http://h/{k}", f"page {k}" * 50) for k in range(12)] + [(7, "http://h/1", "page 1" * 50)] * 6 + [(k, "u", f"text {k % 3}" * 40) for k in range(20, 40)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        manifest = warc.write_archives(table(spark, rows).repartition(6), f"{tmp_path}/warc").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(manifest) > 1
    records = [warc.parse(raw)[0] for r in manifest for raw in warc.read_archive(open(r["uri"].removeprefix("file:"), "rb"))]
    ids = [f["WARC-Record-ID"] for f in records]
    assert len(ids) == len(rows) == len(set(ids))
    revisits = [f for f in records if f["WARC-Type"] == "revisit"]
    assert len(revisits) == 17 and all(f["WARC-Refers-To"] in ids for f in revisits)


def test_small_payloads_are_all_responses(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (3, "u", "long enough"), (4, "u", "long enough")]
    got = {r["page_id"]: r["refers_to"] for r in warc.with_revisits(table(spark, rows), min_bytes=6).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_archive_format():
    """A leading skippable frame with a dictionary, then records that each decompress alone."""
    import zstandard

    out = io.BytesIO()
    out.close_, out.close = out.close, lambda: None
    writer = warc.ArchiveWriter(out)
    raws = [warc.record(f"http://h/{i}", i, f"<html><body>page {i} with a common frame of words</body></html>".encode() * 5, 315, "D") for i in range(300)]
    for r in raws:
        writer.add(r)
    writer.close()
    data = out.getvalue()
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert list(warc.read_archive(io.BytesIO(data))) == raws
    size = int.from_bytes(data[4:8], "little")
    trained = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    assert zstandard.ZstdDecompressor(dict_data=trained).decompressobj().decompress(data[8 + size :]) == raws[0]
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(data[:-3])))
    fields, block = warc.parse(raws[7])
    assert fields["WARC-Type"] == "response" and block.endswith(b"</html>")


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><a href="/x">menu</a></nav><!-- note --><div class="ad">buy</div><header>site</header><article><header><h1>A &amp; B</h1></header>
<p>One <b>two
 three.<br><p>Fo&#117;r&nbsp;&lt;5&gt;</p><aside>side</aside><form><input name="q">ask</form><ul><li>x<li>y</ul><div id="comments"><p>me too</p></div></article>
<footer>&copy; f</footer>"""


def text_of(page, shared=()):
    found = htmltext.lines(page)
    return [found[k][0] for k in htmltext.main_lines([m for _, m in found], list(shared))]


def test_lines():
    assert text_of(PAGE) == ["A & B", "One two three.", "Four <5>", "x", "y"]
    for junk in ("", "<", "<p", "<p class='", "a<b", "</p></div>", "<script>", "<!-- open", "<div hidden>x</div>y", "<p>a</p" * 3, "<" * 1000):
        htmltext.lines(junk)
    assert text_of("<div hidden>x</div>y<p role=navigation>z</p>") == ["y"]
    assert text_of("a < b and c > d") == ["a < b and c > d"]


@pytest.mark.parametrize(
    "page, text",
    [
        ('<main class="with-sidebar"><p>Real text.</p></main>', ["Real text."]),
        ('<article class="post has-comments"><p>Real text.</p></article>', ["Real text."]),
        ('<div class="site header-fixed"><div class="menu">m</div><article><p>Real text.</p></article></div>', ["Real text."]),
        ('<div class="search-results-page"><p>Real text.</p></div>', ["Real text."]),
        ('<div class="widget"><p>Real text.</p></div>', ["Real text."]),
        ('<div class="page-sidebar"><nav>n</nav><main>Real text.</main></div>', ["Real text."]),
        ('<form action="x"><nav>n</nav><main>Real text.<form>ask</form></main></form>', ["Real text."]),
        ('<article>Post.</article><div id="comments"><article class="comment">me too</article></div>', ["Post."]),
        ('<main><article>Post.</article><article class="comment">me too</article></main>', ["Post."]),
        ('<aside><article>teaser</article></aside><div class="cookie-notice">ok?</div><p>Real text.</p>', ["Real text."]),
        ('<body class="has-menu login"><p>Real text.</p><p class="ad">buy</p></body>', ["Real text."]),
        ('<main><div class="related-work"><p>Real text.</p></div><p>x</p></main>', ["Real text.", "x"]),
        ('<main><section id="search"><p>How search engines work</p></section><p>b</p></main>', ["How search engines work", "b"]),
        ('<article><p>a</p><div class="post ad">buy</div><section class="comments" id="c"><p>me too</p></section></article>', ["a"]),
        ("<svg><p>Real text.</p>", ["Real text."]),
        ("<p hidden>x<div>Real text.</div>", ["Real text."]),
        ("<p>&#" + "1" * 9000 + ";a&#00000000065;</p>", ["\ufffdaA"]),
    ],
)
def test_markup_drops_no_article(page, text):
    assert text_of(page) == text


@pytest.mark.parametrize(
    "unit",
    ["<a", "<a ", '<a "', "<a '>", '<a ">" ', "</a", "<!--", "<!-", "<script", "<script>", "</script", "<svg>", "<div>", "<div><b></p>", "<div class=", '<div class="x', "<div a", "<div a=  ", "&#1", "&amp", "<p>x", "<", "a ", "<div hidden>", "<article>", "<div class=ad><article>"],
)
def test_a_page_of_one_mb_takes_seconds(unit):
    import time

    began = time.time()
    found = htmltext.lines(unit * (1_000_000 // len(unit)))
    htmltext.lines("<div>" * 100_000 + "</i>" * 100_000 + "<b " + " " * 300_000 + "x" * 300_000)
    shifted = [(k * 7919) % 50 for k in range(len(found))]
    htmltext.common_lines(shifted, shifted[1:] + [-1])
    assert time.time() - began < 20


def test_common_lines():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in range(2))
        got = htmltext.common_lines(a, b)
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(got) == best[-1][-1] and got == sorted(set(got))
        kept, at = [a[i] for i in got], 0
        for y in b:
            at += at < len(kept) and kept[at] == y
        assert at == len(kept)


def test_differencing(spark):
    frame = "<div><p>Home of news</p><p>{}</p><p>Contact us today</p></div>"
    rows = [(i, f"http://h{i % 2}/a/{i:03d}", frame.format(f"story {i} alone")) for i in range(40)]
    rows += [(100, "http://solo/x", frame.format("only page")), (101, None, None), (102, "http://h0/a/004", PAGE), (None, "http://h1/a/001x", "<p>stray</p>")]
    rows.append(rows[4])
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in htmltext.extracted(table(spark, rows).repartition(4)).collect()]
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    text = dict((i, t) for i, t, _ in got)
    assert all(text[i] == f"story {i} alone" for i in range(40) if i not in (1, 4))  # the one neighbour of 1 shares nothing
    assert text[100] == "Home of news\nonly page\nContact us today" and text[101] == "" and text[102].startswith("A & B") and text[None] == "stray"
    assert htmltext.extracted(table(spark, rows).where("false")).count() == 0


def test_differencing_runs_where_it_decides(spark, monkeypatch):
    """Without it pages that name no article come out with their frame; where every page names one it isn't run."""
    frame = "<div>Home of news</div><div>{}</div><div>Contact us today</div>"
    rows = [(i, f"http://h/{i:03d}", frame.format(f"story {i}")) for i in range(6)]
    rows += [(10 + i, f"http://named/{i}", f"<nav>go</nav><article><p>Shared opening</p><p>story {i}</p></article>") for i in range(4)]
    asked = []
    plain = htmltext.shared_lines
    monkeypatch.setattr(htmltext, "shared_lines", lambda pages: asked.append(pages) or plain(pages))
    text = {r["page_id"]: r["text"] for r in htmltext.extracted(table(spark, rows)).collect()}
    assert [text[i] for i in (0, 3, 10, 13)] == ["story 0", "story 3", "Shared opening\nstory 0", "Shared opening\nstory 3"]
    assert {r["host"] for r in asked[0].select("host").distinct().collect()} == {"h"}
    assert htmltext.extracted(table(spark, rows[6:])).count() == 4 and len(asked) == 1
    monkeypatch.setattr(htmltext, "shared_lines", lambda pages: plain(pages.where("false")))
    assert htmltext.extracted(table(spark, rows)).where("page_id = 3").first()["text"] == "Home of news\nstory 3\nContact us today"


def test_neighbours_across_partitions(spark):
    rows = [(i, f"http://h/{i:02d}", f"<p>{i}</p>") for i in range(23)]
    got = {r["path"]: (r["path_before"], r["path_after"]) for r in htmltext.neighbours(htmltext.parsed(table(spark, rows).repartition(5))).collect()}
    names = [f"/{i:02d}" for i in range(23)]
    assert got == {n: (names[k - 1] if k else None, names[k + 1] if k < 22 else None) for k, n in enumerate(names)}


def common(a, b):
    """Places in a of the longest common subsequence that takes lines of a as early as it can."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def brute_texts(rows):
    """page_id -> text by the definition: nearest page of other lines on either side, shared lines, marks."""
    own = [(*split(u), [t for t, _ in htmltext.lines(h or "")], [m for _, m in htmltext.lines(h or "")], i) for i, u, h in rows]
    out = {}
    for host, path, texts, marks, i in own:
        side = sorted((x for x in own if x[0] == host and x[2] != texts), key=lambda x: x[1]) if host else []
        before, after = [x for x in side if x[1] < path][-1:], [x for x in side if x[1] > path][:1]
        prefix = lambda x: next((k for k, (p, q) in enumerate(zip(path, x[1], strict=False)) if p != q), min(len(path), len(x[1])))
        found = [common(texts, x[2]) for x in sorted(before + after, key=lambda x: -prefix(x))]
        gone = next((f for f in found if f and len(f) < 0.8 * len(texts)), [])
        if not gone and len(found) == 2 and found[0] == found[1] and len(found[0]) < len(texts):
            gone = found[0]
        kind = 1 if 1 in marks else 0
        out[i] = "\n".join(t for k, t in enumerate(texts) if marks[k] == kind and (kind or k not in gone))
    return out


def test_whole_query_against_brute_force(spark):
    """Unmarked templates, short stories in large templates, copies, near copies, articles that share lines, across partitions."""
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(n))
    rows = []
    for h in range(4):
        head, foot = [f"host {h} head {say(2)}" for _ in range(rng.choice([1, 3, 9]))], [f"foot {h}"]
        for i in range(60):
            story = [f"story {h} {i} {k} {say(5)}" for k in range(rng.choice([1, 2, 6]))]
            if i % 10 == 7:
                story = rows[-1][3] if rows and rows[-1][3] else story  # a copy of the page before
            body = "".join(f"<div>{x}</div>" for x in head + story + foot)
            if i % 6 == 0:
                body = f"<nav>go</nav><article><p>shared opening</p>{''.join(f'<p>{x}</p>' for x in story)}</article>" + "".join(f"<div>{x}</div>" for x in head)
            rows.append((len(rows), f"http://h{h}.org/{'ab'[i % 2]}/{i:02d}", body, story))
    rows = [r[:3] for r in rows]
    rows += [(900, None, "<p>no url</p>"), (901, "http://alone/", "<p>alone</p>"), (902, "no scheme", "<p>no host</p>"), (903, "http://h0.org/zz", None), (904, "http://long/1", "<p>" + "x" * 2_000_000 + "</p><p>t</p>"), (905, "http://long/2", "<p>other</p><p>z</p><p>t</p>")]
    got = {r["page_id"]: r["text"] for r in htmltext.extracted(table(spark, rows).repartition(7)).collect()}
    want = brute_texts(rows)
    assert {i for i in want if got[i] != want[i]} == set()
    assert got[904] == "x" * 2_000_000 and got[905] == "other\nz" and got[900] == "no url" and got[903] == ""


def test_copies_over_many_partitions(spark):
    """A run of equal pages that fills whole partitions is one copy: both its ends meet the pages around it."""
    frame = "<div>top</div><div>{}</div><div>end</div>"
    rows = [(i, f"http://h/{i:03d}", frame.format("one" if i == 0 else "two" if i == 99 else "same")) for i in range(100)]
    got = {r["page_id"]: r["text"] for r in htmltext.extracted(table(spark, rows).repartition(3)).collect()}
    assert got == {i: "one" if i == 0 else "two" if i == 99 else "same" for i in range(100)}
