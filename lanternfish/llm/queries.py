"""The registered queries of this subpackage, each over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm import byte_bpe, decontaminate, html_text, line_dedup, nearest, ngram_join, substring_dedup, suffix_dedup, toxicity, warc
from lanternfish.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS = "byte_bpe_multi_50k.tiktoken"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = byte_bpe.tokenise(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep_ids=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.report(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@query
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", "n_chars")


@query
def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op5_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, html FROM p),
l AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND last > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND last > page_id THEN last END AS refers_to
FROM l
"""


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.deduplicate(docs, counts=True)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op1_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, i, line, regexp_replace(trim(regexp_replace(line, '[\x09-\x0D\x20]+', ' ', 'g')), '[^ ]*(?:[0-9@]|://)[^ ]*', '<*>', 'g') AS w FROM l),
g AS (SELECT w, string_split(w, ' ') AS tokens, count(DISTINCT doc_id) AS docs FROM t WHERE w <> '' GROUP BY w),
leaf AS (SELECT len(tokens) AS n, tokens[1:2] AS lead, sum(docs) AS total FROM g GROUP BY ALL),
place AS (SELECT w, len(tokens) AS n, tokens[1:2] AS lead, docs, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS p FROM g),
held AS (SELECT n, lead, p, token, sum(docs) AS c FROM place GROUP BY ALL),
made AS (SELECT w, n, p, CASE WHEN p <= 2 OR 5 * c >= total THEN token ELSE '<*>' END AS token FROM place JOIN held USING (n, lead, p, token) JOIN leaf USING (n, lead)),
tree AS (SELECT w, CASE WHEN 100 * count(*) FILTER (token <> '<*>') >= 70 * any_value(n) THEN string_agg(token, ' ' ORDER BY p) ELSE w END AS template FROM made GROUP BY w),
r AS (SELECT template, min(doc_id) AS first FROM t JOIN tree USING (w) GROUP BY template
      HAVING count(DISTINCT doc_id) >= 3 * pow(4, greatest(0, 4 - len([x FOR x IN string_split(template, ' ') IF x <> '<*>'])))),
k AS (SELECT t.doc_id, i, line, r.first IS NOT NULL AND t.doc_id > r.first AS gone FROM t LEFT JOIN tree USING (w) LEFT JOIN r USING (template)),
s AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, CASE WHEN d.text IS NULL THEN NULL ELSE sha256(kept) END AS kept_sha256
FROM documents d LEFT JOIN s USING (doc_id)
"""


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents"))


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


@query
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.join(table(spark, sf_dir, "documents"), counts=True)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")
