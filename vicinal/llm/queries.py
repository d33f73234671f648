"""The registered queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, audit, bpe, classifier, decontaminate, htmltext, jaccard, langid, quality, sharding, suffixes, urls, warc
from .common import read_table


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(read_table(spark, sf_dir, "documents"), k=4, percent=85)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(read_table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(read_table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(read_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.assign_shards(read_table(spark, sf_dir, "documents"), n_shards=40)
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return shards.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(read_table(spark, sf_dir, "pages"), urls.listed_entries(spark))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.archived(read_table(spark, sf_dir, "pages"), spark)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classified(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.aligned(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_jaccard_join, op2_suffix_dedup, op3_html_text, op4_quality_rules, op5_decontamination, op6_sharding, op7_bpe, op8_url_filter, op9_language_id, op10_warc,
        op11_quality_classifier, op12_filter_audit, op13_tokenizer_alignment,
    ]
    return {f.__name__: f for f in named}


OP1_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
         ELSE list_distinct([w[i + 1:i + 4] FOR i IN range(len(w) - 3)]) END AS grams FROM d
), g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS m FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM met WHERE 100 * m >= 85 * (na + nb - m)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (SELECT a, b FROM edge UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON r.other = e.a)
SELECT s.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(other), s.doc_id)) AS component_id
FROM s LEFT JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, grams
"""

OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS s FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)),
f AS (SELECT s, min(doc_id) AS first_id FROM p GROUP BY s),
hit AS (SELECT doc_id, i FROM p JOIN f USING (s) WHERE first_id < doc_id),
mark AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
run AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM mark),
span AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY ALL),
piece AS (SELECT doc_id, k, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS c FROM span),
cut AS (SELECT p.doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, CAST(2 * c + 1 AS BIGINT), CAST(2 * (a - c) AS BIGINT)), '' ORDER BY k)
  || substr(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) AS kept FROM piece p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)
"""

#: Without seeds: two differing words leave four equal ones in a row in any window, so runs of four find every overlap.
#: Over the tables' items, none of which is shorter than a window.
OP5_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS v FROM benchmark),
p AS (SELECT doc_id, i, w[i + 1:i + 4] AS four FROM (SELECT doc_id, w, unnest(range(len(w) - 3)) AS i FROM d WHERE len(w) > 3)),
q AS (SELECT item_id, j, v[j + 1:j + 4] AS four FROM (SELECT item_id, v, unnest(range(len(v) - 3)) AS j FROM b WHERE len(v) > 3)),
h AS (SELECT DISTINCT doc_id, item_id, i - j AS shift FROM p JOIN q USING (four)),
c AS (SELECT doc_id, item_id, w, v, shift, greatest(0, -shift) AS lo, least(len(v), len(w) - shift) AS hi FROM h JOIN d USING (doc_id) JOIN b USING (item_id)),
e AS (SELECT doc_id, item_id, list_transform(range(lo, hi), lambda x: CASE WHEN w[x + shift + 1] = v[x + 1] THEN 1 ELSE 0 END) AS eq
      FROM c WHERE hi - lo >= {decontaminate.WINDOW}),
m AS (SELECT doc_id, item_id, list_max(list_transform(range(len(eq) - {decontaminate.WINDOW - 1}), lambda x: list_sum(eq[x + 1:x + {decontaminate.WINDOW}]))) AS matched FROM e)
SELECT doc_id, item_id, CAST(max(matched) AS BIGINT) AS matched_words, CAST({decontaminate.WINDOW} AS BIGINT) AS window_words
FROM m WHERE 100 * matched >= {decontaminate.NEED} * {decontaminate.WINDOW} GROUP BY doc_id, item_id
"""

OP6_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce('s' || source, 'n') AS stratum,
         md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), poly AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, [CAST(0 AS BIGINT) FOR _ IN range(8)]),
                          lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM range(256) r(i))
), e AS (
  SELECT doc_id, t, stratum, k, octet_length(encode(t)) AS n, hex(encode(t)) AS h FROM d
), f AS (
  SELECT doc_id, stratum, k, n + 16 AS size,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
               [CAST('0x' || substr(h, CAST(2 * j + 1 AS BIGINT), 2) AS BIGINT) FOR j IN range(n)]),
             lambda a, b: xor(a >> 8, tab[CAST(xor(a & 255, b) AS BIGINT) + 1])), 4294967295) AS crc
  FROM e, poly
), g AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY k, doc_id, crc, size)
             - (CAST('0x' || substr(md5(stratum), 1, 8) AS BIGINT) + 1) / CAST(4294967298 AS DOUBLE))
            / count(*) OVER (PARTITION BY stratum) AS frac
  FROM f
), p AS (
  SELECT *, row_number() OVER (ORDER BY frac, stratum, k, doc_id, crc, size) - 1 AS place, count(*) OVER () AS total FROM g
), s AS (SELECT *, CAST(place * 40 // total AS INTEGER) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, shard,
       CAST(place - (shard * total + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""

_LISTED = ", ".join(f"('{n}.{d}', '/')" for n in urls.LISTED_NAMES for d in urls.LISTED_DOMAINS)
_DOMAINS = ", ".join(f"'{d}'" for d in urls.LISTED_DOMAINS)
_LANGUAGES = ", ".join(f"'{x}'" for x in urls.LISTED_LANGUAGES)

OP8_SQL = f"""
WITH a AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (
  SELECT page_id, translate(raw, '{urls.UPPER}', '{urls.LOWER}') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    regexp_replace(host, '^[^@]*@|:[0-9]*$', '', 'g') AS bare, CASE WHEN path = '' THEN '/' ELSE path END AS rooted FROM c
), l(name, place) AS (
  SELECT * FROM (VALUES {_LISTED}) UNION
  SELECT [{_DOMAINS}][i % {len(urls.LISTED_DOMAINS)} + 1],
    '/' || [{_LANGUAGES}][(i // {len(urls.LISTED_DOMAINS)}) % {len(urls.LISTED_LANGUAGES)} + 1]
    || '/' || CAST(CAST('0x' || substr(md5('{urls.LISTED_SEED}' || i), 1, 8) AS BIGINT) % {urls.LISTED_NUMBERS} AS VARCHAR) || CASE WHEN (i // 12) % 2 = 0 THEN '' ELSE '/' END
  FROM range({urls.LISTED_PAGES}) t(i)
), hit AS (
  SELECT DISTINCT page_id, host, path FROM r JOIN l ON (bare = name OR ends_with(bare, '.' || name)) AND (rooted = place OR (ends_with(place, '/') AND starts_with(rooted, place)))
  WHERE bare <> ''
)
SELECT r.page_id, r.host, r.path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN hit.host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN hit ON r.page_id = hit.page_id AND r.host = hit.host AND r.path = hit.path
"""

OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p),
w AS (SELECT *, [CAST('0x' || substr(h, CAST(5 * j + 1 AS BIGINT), 5) AS BIGINT) FOR j IN range(8)] AS parts FROM g)
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v >> 15 AS BIGINT) + 1, 1) ||
     substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 10) & 31 AS BIGINT) + 1, 1) ||
     substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 5) & 31 AS BIGINT) + 1, 1) ||
     substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v & 31 AS BIGINT) + 1, 1) FOR v IN parts], 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM w
"""

OP12_SQL = """
WITH t AS (SELECT doc_id, coalesce(CAST(source AS VARCHAR), '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
f AS (SELECT doc_id, part, CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails FROM w),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, fails, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, good, toxic, fails,
    strpos(fails, substr(filter_order, step, 1)) > 0 AS hit,
    length(regexp_replace(substr(filter_order, 1, step - 1), '[^' || fails || '_]', '', 'g')) AS earlier
  FROM d, o, range(1, 6) r(step)),
c AS (SELECT part, filter_order, step, letter, count(*) FILTER (NOT hit AND earlier = 0) AS kept, count(*) FILTER (hit AND earlier = 0) AS removed,
    count(*) FILTER (hit AND earlier > 0) AS redundant, count(*) FILTER (fails = letter) AS unique_fails,
    count(*) FILTER (hit AND earlier = 0 AND good) AS good_lost, count(*) FILTER (hit AND earlier = 0 AND toxic) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_join": OP1_SQL, "op2_suffix_dedup": OP2_SQL, "op5_decontamination": OP5_SQL, "op6_sharding": OP6_SQL, "op8_url_filter": OP8_SQL, "op10_warc": OP10_SQL, "op12_filter_audit": OP12_SQL}
