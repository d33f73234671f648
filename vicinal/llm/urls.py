"""URL filter: ordered rules for hosts and paths, then a list of canonical URLs behind a blocked Bloom filter.

A listed canonical URL is ``host/`` or ``host/dir/`` or ``host/dir/page`` without scheme, port, query and fragment; it
covers the host's subdomains, and paths below an entry that ends with ``/``. A URL's candidates are all combinations
of its host's suffixes and its path's directory prefixes, as many and as long as the list's deepest and longest entries:
others can't be listed, so a URL costs no more than its length. The Bloom filter, of bounded size, lets possible hits
through; an exact hash join with the list removes its false positives.

Defined cases: a null URL or one without ``://`` has empty host and path, fits no rule and no entry, and is allowed;
host and path are taken as they stand (only A-Z of the host are lower-cased); repeated rows get equal verdicts; null
ids are carried along; an empty table gives no rows; an empty list blocks nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import let, written

#: Rules of the production query: host, path, verdict. Fixed values.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: The production list, there being none among the tables: names below each of the domains, and by a fixed seed so many
#: single pages and folders of the domains, in these languages. Fixed values; users pass a list of their own.
LISTED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_DOMAINS = ["example.com", "example.net", "example.org"]
LISTED_LANGUAGES = ["de", "en", "es", "fr"]
LISTED_SEED, LISTED_PAGES, LISTED_NUMBERS = "urls-1", 120_000, 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A list of at most so many entries of so many characters of path is broadcast; another is joined by shuffle, with hot candidates salted.
BROADCAST_ENTRIES, BROADCAST_LENGTH, SALTS = 100_000, 200, 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end."""
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _bare(host: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(host, r"^[^@]*+@|:[0-9]*+$", "")


def candidates(host: Column, path: Column, labels: int, folders: int, longest: int) -> Column:
    """The listed forms that would cover a URL: host suffixes times directory prefixes and the path itself, of entries with
    at most so many host labels, slashes in the path, and characters of path."""
    bare = _bare(host)
    suffixes = F.array_distinct(F.array(*[F.substring_index(bare, ".", -k) for k in range(1, max(1, labels) + 1)]))
    rooted = F.when(path == "", "/").otherwise(path)
    parts = F.split(F.substring(rooted, 1, longest + 1), "/", folders + 1)
    above = let(parts, lambda x: F.transform(F.sequence(F.lit(1), F.least(F.size(x) - 1, F.lit(max(1, folders)))), lambda i: F.concat(F.array_join(F.slice(x, 1, i), "/"), F.lit("/"))))
    itself = F.when(F.char_length(rooted) <= longest, F.array(rooted)).otherwise(F.array().cast("array<string>"))
    prefixes = F.array_distinct(F.concat(above, itself))
    every = let(prefixes, lambda ps: F.flatten(F.transform(suffixes, lambda h: F.transform(ps, lambda p: F.concat(h, p)))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(every)


def canonical(url: Column) -> Column:
    """The listed form of a URL given with or without a scheme."""
    host, path = host_and_path(F.when(url.contains("://"), url).otherwise(F.concat(F.lit("x://"), url)))
    return F.concat(_bare(host), F.when(path == "", "/").otherwise(path))


def listed_entries(spark) -> DataFrame:
    """The production list: 18 sites, and LISTED_PAGES pages (even places) and folders (odd ones) by hash."""
    sites = spark.createDataFrame([(f"{name}.{domain}/",) for name in LISTED_NAMES for domain in LISTED_DOMAINS], "url string")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    number = F.conv(F.substring(F.md5(F.concat(F.lit(LISTED_SEED), F.col("id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % LISTED_NUMBERS
    domain, language = pick(LISTED_DOMAINS, F.col("id")), pick(LISTED_LANGUAGES, F.floor(F.col("id") / len(LISTED_DOMAINS)))
    url = F.concat(domain, F.lit("/"), language, F.lit("/"), number.cast("string"), F.when(F.floor(F.col("id") / 12) % 2 == 0, "").otherwise("/"))
    return sites.union(spark.range(LISTED_PAGES).select(url.alias("url")))


def covered(pages: DataFrame, listed: DataFrame, keys: list[str], max_bytes: int = 16 << 20) -> DataFrame:
    """The distinct keys of pages (columns host, path) that the list (column url) covers."""
    entries = written(listed.where(F.col("url").isNotNull()).select(canonical(F.col("url")).alias("_candidate")).distinct(), "listed-urls")
    host, path = F.substring_index("_candidate", "/", 1), F.expr("substring(_candidate, locate('/', _candidate))")
    slashes = lambda x, c: F.char_length(x) - F.char_length(F.replace(x, F.lit(c), F.lit("")))
    most = entries.agg(F.count("*").alias("n"), F.max(slashes(host, ".") + 1).alias("labels"), F.max(slashes(path, "/")).alias("folders"), F.max(F.char_length(path)).alias("longest")).first()
    n = most["n"]
    filter_ = bloom.build(entries.select(F.xxhash64("_candidate").alias("h")), n, max_bytes)
    each = pages.select(*keys, F.explode(candidates(F.col("host"), F.col("path"), most["labels"] or 1, most["folders"] or 1, most["longest"] or 1)).alias("_candidate"))
    possible = bloom.passing(each.withColumn("_hash", F.xxhash64("_candidate")), filter_, "_hash")
    if n <= BROADCAST_ENTRIES and (most["longest"] or 0) <= BROADCAST_LENGTH:
        hits = possible.join(F.broadcast(entries), "_candidate", "left_semi")
    else:
        salted = entries.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        hits = possible.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")).join(salted, ["_candidate", "_salt"], "left_semi")
    return hits.select(*keys).distinct()


def judged(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    host, path = host_and_path(F.col(url_column))
    rows = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    open_rows = rows.where(verdict.isNull())
    hits = covered(open_rows, listed, ["page_id", "host", "path"]).select(
        F.col("page_id").alias("_id"), F.col("host").alias("_host"), F.col("path").alias("_path"), F.lit(True).alias("_hit")
    )
    same = rows["page_id"].eqNullSafe(hits["_id"]) & (rows["host"] == hits["_host"]) & (rows["path"] == hits["_path"])
    found = F.when(F.col("_hit"), "block").otherwise("allow")
    return rows.join(hits, same, "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, found).alias("verdict"))
