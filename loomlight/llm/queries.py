"""The queries of this subpackage: name -> function of (spark, folder of tables), and their SQL where it can say the same."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlight.llm import bpe, centroids, decontaminate, filter_audit, licences, lines, quality, repeats, secrets, simhash, token_files, topk, warc, words
from loomlight.llm.shared import table

#: The tokenizer's file, and the id that ends a document in token files.
TOKENIZER, END_ID = public_tokenizers.path("word_bpe_49k.json"), 2


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets of every document. Null and empty texts have none; repeated rows and rows without an id each get a row; an empty table gives none."""
    return secrets.digests(table(spark, sf_dir, "documents"))


#: What makes a document of op2 a licence file, if its header holds it.
NOTICE = r"(?i)licen[sc]e|copyright|spdx|redistribution|warranty|public domain|permission is hereby granted"


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a directory for each source and language, and below it one for each hundred ids whose own id doesn't end in 0. One with a licence statement in its header is the licence file of its directory.

    A null source or language leaves that directory out; rows without an id are nameless files of
    theirs, and repeated rows give repeated rows. Null and empty texts declare nothing.
    """
    docs = table(spark, sf_dir, "documents")
    folder = F.concat_ws("/", "source", "lang", F.when(F.col("doc_id") % 10 != 0, F.floor(F.col("doc_id") / 100).cast("string")))
    header = F.array_join(F.slice(F.split(F.col("text"), "\n", -1), 1, licences.HEADER_LINES), "\n")
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    name = F.concat(F.when(header.rlike(NOTICE), F.lit("LICENSE.")).otherwise(F.lit("file.")), own)
    found = licences.resolve(docs.select(F.concat_ws("/", folder, name).alias("path"), "text"))
    number = lambda path: F.substring_index(path, ".", -1).try_cast("long")
    return found.select(number("path").alias("doc_id"), "path", "licence", "cosine", "declared", number("inherited_from").alias("inherited_from"), "steps")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets, counts and checksums of every document, read back from token files. A null or empty text is its end id alone; documents without an id come first, repeats side by side; an empty table gives no files and no rows."""
    return token_files.round_trip(table(spark, sf_dir, "documents"), functools.partial(token_files.library_encoder, TOKENIZER, words.rules_by_task(spark, TOKENIZER)), END_ID, id_bytes=2)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document. Null and empty texts are scored like any other, repeated rows each; without labels the score is 0.5."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other rows of every hundredth vector. Null, incomplete and non-finite vectors and rows without an id take no part; repeated rows are rows of their own."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line equals or nearly equals. A null text stays null, blank lines stay; rows that agree in id and text keep the same lines."""
    return lines.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), shortest=1)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of ids and decoded texts of every document. Null and empty texts have the digests of nothing; repeated rows each get a row."""
    return bpe.digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives hold of every page, read back. A null html is an empty payload; rows without an id are records too, and never the one that others revisit."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hits, items and the longest match of every document. Null and empty texts have none; items without an id, a text or words take no part; an empty benchmark hits nothing."""
    return decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Null and empty texts have fingerprint zero and link like any other; rows without an id name no component."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a repeated string of 100 bytes covers, and what is left without them. Null and empty texts lose nothing; rows that share an id lose nothing to each other; an empty table gives no rows."""
    return repeats.deduplicate(table(spark, sf_dir, "documents")).drop("spans")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every vector of 64 finite components. Others are left out; repeated rows each get a row; an empty table gives none."""
    return centroids.digests(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their orders, for each language. Null texts count as empty, a null language is the empty string; an empty table gives no rows."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_license_scan, op3_token_files, op4_quality_rules, op5_exact_top_k, op6_line_dedup, op7_bpe, op8_warc, op9_decontamination, op10_simhash, op11_suffix_dedup, op12_centroid_clusters, op13_filter_audit)}

def _clusters_sql(rounds: int = centroids.ROUNDS) -> str:
    """op12's rounds as one common table expression after another: a has the nearest centroid of each vector as 64 * distance + number, c the centroids."""
    nearest = """
a{k} AS MATERIALIZED (
  SELECT r, min(64 * CAST(list_sum(list_transform(list_zip(ints, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS HUGEINT) + k) AS best FROM v, c{k} GROUP BY r
)"""
    moved = """, c{next} AS MATERIALIZED (
  SELECT k, coalesce(m.c, c{k}.c) AS c FROM c{k} LEFT JOIN (
    SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
    FROM (SELECT best % 64 AS k, i, sum(CAST(ints[i] AS HUGEINT)) AS s, count(*) AS n FROM a{k} JOIN v USING (r), unnest(range(1, 65)) AS t(i) GROUP BY 1, 2) GROUP BY k
  ) AS m USING (k)
),"""
    body = "".join(nearest.format(k=k) + moved.format(k=k, next=k + 1) for k in range(rounds)) + nearest.format(k=rounds)
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, ints) - 1 AS k, ints AS c FROM v QUALIFY k < 40
),{body}, f AS (
  SELECT vec_id, best % 64 AS k, CAST(best // 64 AS BIGINT) AS distance FROM a{rounds} JOIN v USING (r)
)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM f JOIN c{rounds} USING (k)
"""


ORACLE_SQL = {
    "op5_exact_top_k": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.ints, c.ints), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.r <> q.r
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op8_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages
), k AS (SELECT html, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY html)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN k.kept <> p.page_id OR (p.page_id IS NULL AND k.kept IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k.kept <> p.page_id OR (p.page_id IS NULL AND k.kept IS NOT NULL) THEN k.kept END AS refers_to
FROM p LEFT JOIN k ON p.html = k.html AND p.payload_bytes >= 1000
""",
    "op9_decontamination": """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents
), b AS (
  SELECT row_number() OVER () AS b, CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
  SELECT b, item, i, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0
), dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM d, (SELECT DISTINCT n FROM bw) AS sizes, unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(i)
), m AS (SELECT r, dw.i, dw.n, item, b, dw.i - bw.i AS diagonal FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
h AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM m, unnest(range(0, n)) AS t(k) GROUP BY r),
g AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r),
runs AS (
  SELECT r, item, min(i) AS i, count(*) + any_value(n) - 1 AS longest
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, b, diagonal ORDER BY i) AS run FROM m) GROUP BY r, b, item, diagonal, run
), l AS (SELECT r, longest, i - 1 AS longest_at, item AS longest_item FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY longest DESC, i, item) = 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0) AS longest, longest_at, longest_item
FROM d LEFT JOIN h USING (r) LEFT JOIN g USING (r) LEFT JOIN l USING (r)
""",
    "op11_suffix_dedup": """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents
), w AS (
  SELECT r, doc_id, s, substr(h, 2 * s + 1, 200) AS k FROM d, unnest(range(0, greatest(n_bytes - 99, 0))) AS t(s)
), f AS (
  SELECT r, doc_id, s, min(doc_id) OVER (PARTITION BY k) AS least, min(s) OVER (PARTITION BY k, r) AS first FROM w
), g AS (
  SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 100 THEN 0 ELSE 1 END AS new
  FROM f WHERE s > first OR doc_id > least OR (doc_id IS NULL AND least IS NOT NULL)
), p AS (
  SELECT r, min(s) AS a, max(s) + 100 AS b FROM (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS span FROM g) GROUP BY r, span
), q AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS was FROM p),
c AS (
  SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * was + 1, 2 * (a - was)), '' ORDER BY a) AS head
  FROM q JOIN d USING (r) GROUP BY r
)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN c USING (r)
""",
    "op12_centroid_clusters": _clusters_sql(),
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CAST(len(words) < 100 AS INTEGER) + 2 * CAST(100 * list_unique(words) < 80 * len(words) AS INTEGER)
         + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS INTEGER)
         + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER)
         + 16 * CAST(coalesce(doc_id > least, doc_id IS NULL AND least IS NOT NULL) AS INTEGER) AS mask
  FROM w LEFT JOIN l USING (doc_id)
), n AS (SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT i, substr('ABCDE', i + 1, 1) AS name, 1 << i AS bit FROM unnest(range(0, 5)) AS t(i)),
o AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a JOIN f b ON b.i <> a.i JOIN f c ON c.i NOT IN (a.i, b.i) JOIN f d ON d.i NOT IN (a.i, b.i, c.i) JOIN f e ON e.i NOT IN (a.i, b.i, c.i, d.i)
), s AS (SELECT filter_order, k AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS BIGINT) AS before FROM o, unnest(range(1, 6)) AS t(k)),
r AS (
  SELECT part, filter_order, step, bit,
         CAST(coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost
  FROM n, s GROUP BY part, filter_order, step, bit, before
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
""",
}
