"""The training-data queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, decontamination, hard_negatives, mixing, ngram_join, order_minhash, quality_rules, secret_scans, suffix_dedup, toxicity, url_filters, warc, whitening
from marlstone.sources import table

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), with_text=False).withColumn("n_draws", F.size("draws")).drop("draws")


_MD5 = "CAST('0x' || left(md5('20240101|' || {}), 15) AS BIGINT)"
OP2 = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                     {_MD5.format("coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')")} AS h FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM docs GROUP BY 1),
weighed AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sums),
stops AS (SELECT *, 2 * source_size / CAST(weight AS DOUBLE) AS stop FROM weighed),
levels AS (SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(CAST(weight AS DOUBLE)) OVER (ORDER BY stop, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM stops),
aimed AS (SELECT source, source_size, n, least(2 * CAST(source_size AS DOUBLE), coalesce(max(CASE WHEN level <= stop THEN level END) OVER (), 0) * weight) AS target FROM levels),
quotas AS (SELECT *, least(CAST(round(target) AS BIGINT), 2 * source_size) AS quota, CAST(ceil(greatest(source_size / 100000.0, n / 10000.0)) AS BIGINT) AS blocks FROM aimed),
passed AS (SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS passes FROM quotas),
placed AS (SELECT docs.*, source_size, target, passes, quota - passes * source_size AS rest, h % blocks AS block FROM docs JOIN passed ON docs.source IS NOT DISTINCT FROM passed.source),
filled AS (SELECT source, block, sum(size) AS words FROM placed GROUP BY 1, 2),
ahead AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY {_MD5.format("CAST(block AS VARCHAR)")}, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM filled),
chosen AS (SELECT placed.*, greatest(0, least(words, rest - before)) AS extra,
                  coalesce(sum(size) OVER (PARTITION BY placed.source, placed.block ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
           FROM placed JOIN ahead ON placed.source IS NOT DISTINCT FROM ahead.source AND placed.block = ahead.block),
final AS (SELECT *, CASE WHEN 2 * earlier + size <= 2 * extra THEN size ELSE 0 END AS more FROM chosen)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(passes * size + more AS BIGINT) AS taken,
       CAST(CASE WHEN size > 0 THEN passes + (CASE WHEN more > 0 THEN 1 ELSE 0 END) ELSE 0 END AS INTEGER) AS n_draws
FROM final
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


OP3 = """
SELECT page_id, b AS payload_bytes, d AS payload_digest,
       CASE WHEN b >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN b >= 1000 AND page_id <> m THEN m END AS refers_to, url AS target_uri
FROM (SELECT *, max(page_id) OVER (PARTITION BY d) AS m
      FROM (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS b, sha1(coalesce(html, '')) AS d FROM pages))
"""


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copies")


#: Every two texts that share a shingle are compared, and classes are what links reach.
OP4 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM d WHERE len(w) > 0),
k AS MATERIALIZED (SELECT *, md5(array_to_string(list_sort(sh), '|')) AS node FROM s),
nodes AS MATERIALIZED (SELECT node, count(*) AS copies, min(doc_id) AS least, len(any_value(sh)) AS size, any_value(sh) AS sh FROM k GROUP BY 1),
flat AS MATERIALIZED (SELECT node, unnest(sh) AS x FROM nodes),
common AS (SELECT a.node AS a, b.node AS b, count(*) AS n_both FROM flat a JOIN flat b ON a.x = b.x AND a.node < b.node GROUP BY 1, 2),
near AS MATERIALIZED (SELECT a, b FROM common JOIN nodes p ON p.node = a JOIN nodes q ON q.node = b WHERE n_both >= 0.8 * (p.size + q.size - n_both) - 1e-9),
links AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
class AS (SELECT reach.a AS node, min(least) AS class_id FROM reach JOIN nodes ON nodes.node = reach.b GROUP BY 1),
linked AS (SELECT a AS node, sum(copies) AS n FROM links JOIN nodes ON nodes.node = b GROUP BY 1)
SELECT d.doc_id, CASE WHEN k.node IS NULL THEN d.doc_id ELSE class_id END AS class_id, CAST(coalesce(copies - 1 + coalesce(n, 0), 0) AS BIGINT) AS n_links, coalesce(copies, 1) AS copies
FROM d LEFT JOIN k USING (rid) LEFT JOIN nodes ON nodes.node = k.node LEFT JOIN class ON class.node = k.node LEFT JOIN linked ON linked.node = k.node
"""


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edit_and_compare(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


OP6 = """
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, coalesce(arg_max(rv, length(rh || rp)), 'allow') AS verdict
FROM named LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
GROUP BY page_id, host, path
"""

def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("n_lines")


def secret_columns(found: DataFrame) -> DataFrame:
    """doc_id and what op9 returns of a scan's spans."""
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scans.listed("secrets", 3), 256).alias("base_sha256"),
        secret_scans.listed("secrets").alias("spans"),
    )


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_columns(secret_scans.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _op9() -> str:
    """Spans by the gaps between matches, and links by comparing every two of a document."""
    word = lambda p: p.replace("(?<![A-Za-z0-9_])", r"\b").replace("'", "''")  # noqa: E731  before a letter these are the same
    kinds = [(secret_scans.ASSIGN, "length(regexp_extract(hit, '{p}', 2)) >= 6"), (secret_scans.ACCESS, "true"), (secret_scans.HEX, "true")]
    kinds += [(secret_scans.RUN, " AND ".join(f"regexp_matches(hit, '{t}')" for t in secret_scans.OPAQUE)), (secret_scans.IDENTITY, "true"), (secret_scans.ENDPOINT, "true")]
    one = """
SELECT rid, {k} AS kind, pos AS start, pos + length(hit) AS "end" FROM (
  SELECT rid, hits[i] AS hit, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS pos
  FROM (SELECT rid, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT rid, regexp_extract_all(body, '{p}') AS hits, string_split_regex(body, '{p}') AS gaps FROM d)))
WHERE {keep}"""
    spans = " UNION ALL ".join(one.format(k=k, p=word(p), keep=keep.replace("{p}", word(p))) for k, (p, keep) in enumerate(kinds))
    near = lambda test, gap=secret_scans.SCOPE: f'EXISTS (SELECT 1 FROM s o WHERE o.rid = p.rid AND o.kind IN ({test}) AND o."end" >= p.start - {gap} AND o.start <= p."end" + {gap})'
    secret, identity, endpoint, clear = near("0, 3"), near("1, 4"), near("5"), f"NOT {near('0, 1, 2', -1)}"
    linked = f"(kind = 3 AND {identity}) OR (kind = 4 AND {secret} AND {endpoint}) OR (kind = 5 AND {secret} AND {identity})"
    text = f"""[{", ".join(f"'{k}'" for k in secret_scans.KINDS)}][kind + 1] || ':' || start || ':' || "end\""""
    listed = lambda test: f"coalesce(string_agg({text}, ',' ORDER BY start, kind) FILTER ({test}), '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents), s AS MATERIALIZED ({spans}),
k AS (SELECT * FROM s p WHERE kind < 3 OR (({linked}) AND {clear}))
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256({listed("kind < 3")}) AS base_sha256, {listed("kind IS NOT NULL")} AS spans
FROM d LEFT JOIN k USING (rid) GROUP BY d.rid, doc_id
"""


OP9 = _op9()


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


#: Every string of 200 bytes is counted.
OP10 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT rid, unnest(range(0, greatest(0, octet_length(b) - 199))) AS i FROM d),
h AS (SELECT w.rid, i, md5(b[i + 1:i + 200]) AS h FROM w JOIN d USING (rid)),
again AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
hit AS (SELECT rid, i FROM h WHERE h IN (SELECT h FROM again)),
cut AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM hit),
numbered AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM cut),
runs AS (SELECT rid, run, min(i) AS a, max(i) + 200 AS z FROM numbered GROUP BY 1, 2),
kept AS (SELECT rid, a AS upto, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS first FROM runs
         UNION ALL SELECT d.rid, octet_length(b), coalesce(last, 0) FROM d LEFT JOIN (SELECT rid, max(z) AS last FROM runs GROUP BY 1) USING (rid)),
whole AS (SELECT kept.rid, unhex(string_agg(hex(b[first + 1:upto]), '' ORDER BY first)) AS rest FROM kept JOIN d USING (rid) GROUP BY 1),
n AS (SELECT rid, sum(z - a) AS removed, count(*) AS spans FROM runs GROUP BY 1)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(rest) AS kept_sha256
FROM d JOIN whole USING (rid) LEFT JOIN n USING (rid)
"""


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Every window of the items against every window of the documents, word by word.
OP12 = f"""
WITH items AS (SELECT row_number() OVER () AS no, item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT *, least(len(w), 10) AS size FROM items WHERE len(w) > 0),
grams AS MATERIALIZED (SELECT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM sized)),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT rid, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM sized))),
met AS MATERIALIZED (SELECT rid, i, windows.size, item_id FROM windows JOIN grams ON windows.size = grams.size AND windows.gram = grams.gram),
hit AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + size)) AS at FROM met) GROUP BY 1),
named AS (SELECT rid, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM met WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


#: Every anchor against every row.
OP13 = """
WITH rows AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (SELECT a.rid AS anchor, a.vec_id AS anchor_id, r.rid, r.vec_id, r.label = a.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM rows a JOIN rows r ON a.rid <> r.rid WHERE a.vec_id % 100 = 0),
positives AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS n FROM scored WHERE same) WHERE n <= 5),
negatives AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY s.score DESC, s.vec_id) AS n, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM positives p JOIN scored s ON p.anchor = s.anchor WHERE NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE n <= 5
"""

QUERIES: dict[str, Query] = {"op1_toxicity": op1_toxicity, "op2_mixing": op2_mixing, "op3_warc": op3_warc, "op4_ngram_join": op4_ngram_join, "op5_order_minhash": op5_order_minhash, "op6_url_filters": op6_url_filters, "op7_bpe": op7_bpe, "op8_quality_rules": op8_quality_rules, "op9_secret_scans": op9_secret_scans, "op10_suffix_dedup": op10_suffix_dedup, "op11_whitening": op11_whitening, "op12_decontamination": op12_decontamination, "op13_hard_negatives": op13_hard_negatives}
ORACLES: dict[str, str] = {"op2_mixing": OP2, "op3_warc": OP3, "op4_ngram_join": OP4, "op6_url_filters": OP6, "op9_secret_scans": OP9, "op10_suffix_dedup": OP10, "op12_decontamination": OP12, "op13_hard_negatives": OP13}
