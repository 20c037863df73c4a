"""Queries of registry, storage, downloads, caches and the model catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish import session
from lanternfish.functions import sources
from lanternfish.operators import catalog
from lanternfish.plans.registry import query
from lanternfish.sources import tables

#: Files, what protects them, and downloads, all made of pages.
_F = "f AS (SELECT 'm' || page_id || CASE page_id % 4 WHEN 0 THEN '.task' WHEN 1 THEN '.bin' WHEN 2 THEN '.json' ELSE '.txt' END AS filename, length(html) * 500 AS size, page_id FROM pages)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.table(spark, sf_dir, "pages").createOrReplaceTempView("pages_view")
    return spark.sql("WITH " + _F.replace("FROM pages", "FROM pages_view") + " SELECT filename, cast(size as long) as size, page_id FROM f")


def _downloads(spark, sf_dir):
    f = _files(spark, sf_dir)
    keep = catalog.protected(f.where("page_id % 3 = 0"), f.where("page_id % 6 = 0"))
    tasks = f.where("page_id % 7 = 0").select("filename", (F.col("page_id") % 2 == 0).alias("can_resume"))
    records = f.where("page_id % 5 = 0").select("filename", F.when(F.col("page_id") % 10 == 0, "complete").otherwise("failed").alias("status"), F.lit(True).alias("can_resume"))
    return f, keep, tasks, records


_ORPHAN = "page_id % 4 != 3 AND page_id % 3 != 0 AND page_id % 7 != 0 AND NOT (page_id % 5 = 0 AND page_id % 10 != 0)"


@query(f"WITH {_F} SELECT filename, size FROM f WHERE {_ORPHAN}")
def orphan_files(spark, sf_dir):
    return catalog.orphans(*_downloads(spark, sf_dir)).select("filename", "size")


@query(f"WITH {_F} SELECT count(*) AS files, sum(size) :: BIGINT AS bytes, count(*) FILTER (WHERE {_ORPHAN}) AS orphans, (sum(size) FILTER (WHERE {_ORPHAN})) :: BIGINT AS orphan_bytes, round(sum(size) / 1048576, 6) AS megabytes FROM f WHERE page_id % 4 != 3")
def storage_summary(spark, sf_dir):
    f, *rest = _downloads(spark, sf_dir)
    return catalog.storage(f, catalog.orphans(f, *rest)).withColumn("megabytes", F.round("megabytes", 6))


@query(f"WITH {_F} SELECT count(*) AS protected, sum(size) :: BIGINT AS bytes, round(sum(size) / 1048576) :: BIGINT AS megabytes, count(*) FILTER (WHERE page_id % 2 = 0) AS inference, (count(*) FILTER (WHERE page_id % 2 = 1)) // 2 AS embedding FROM f WHERE page_id % 3 = 0")
def legacy_storage(spark, sf_dir):
    f = _files(spark, sf_dir)
    rows = f.where("page_id % 3 = 0").select(F.col("filename").alias("id"), F.when(F.col("page_id") % 2 == 0, "inference").otherwise("embedding").alias("type"))
    return catalog.legacy_storage(rows, f.select("filename", "size"))


_STATUS = "CASE WHEN page_id % 11 = 0 THEN 'file_not_found' WHEN size >= 1048576 THEN 'file_complete' WHEN page_id % 7 = 0 THEN CASE WHEN page_id % 2 = 0 THEN 'can_resume' ELSE 'cannot_resume' END WHEN page_id % 5 = 0 THEN 'can_resume' ELSE 'no_task' END"


def _resume(spark, sf_dir):
    f, _, tasks, records = _downloads(spark, sf_dir)
    here = f.select("filename", F.when(F.col("page_id") % 11 != 0, F.col("size")).alias("size"))
    return catalog.resume(here, tasks, records)


@query(f"WITH {_F}, s AS (SELECT filename, {_STATUS} AS status FROM f) SELECT filename, status, CASE status WHEN 'can_resume' THEN 'resume' WHEN 'file_complete' THEN 'skip' WHEN 'file_not_found' THEN 'download' ELSE 'restart' END AS action FROM s")
def resume_status(spark, sf_dir):
    return _resume(spark, sf_dir).select("filename", "status", "action")


@query(f"WITH {_F}, s AS (SELECT {_STATUS} AS status FROM f), d(status) AS (VALUES ('can_resume'), ('file_complete'), ('cannot_resume'), ('no_task'), ('file_not_found'), ('error')) SELECT d.status, count(s.status) AS n FROM d LEFT JOIN s USING (status) GROUP BY d.status UNION ALL SELECT 'total', count(*) FROM s")
def resume_histogram(spark, sf_dir):
    return catalog.resume_histogram(_resume(spark, sf_dir))


@query("WITH x AS (SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1) SELECT * FROM x UNION ALL SELECT 'total', sum(n) :: BIGINT FROM x")
def event_histogram(spark, sf_dir):
    rows = session.table(spark, sf_dir, "events").select(F.col("event_type").alias("status"))
    domain = tuple(sorted(r.status for r in rows.distinct().collect()))
    return catalog.resume_histogram(rows, domain)


@query("WITH e AS (SELECT 'k' || (event_id % 97) AS cache_key, event_id AS url, ts FROM events), n AS (SELECT max(ts) AS now FROM e), k AS (SELECT cache_key FROM e, n GROUP BY cache_key, now HAVING epoch(now) - epoch(max(ts)) <= 3600) SELECT cache_key, url FROM e JOIN k USING (cache_key)")
def cache_ttl(spark, sf_dir):
    """A limit of one hour, since the events span few days."""
    e = session.table(spark, sf_dir, "events").select(F.concat(F.lit("k"), F.col("event_id") % 97).alias("cache_key"), F.col("event_id").alias("url"), F.col("ts").cast("timestamp").alias("timestamp"))
    now = e.agg(F.max("timestamp")).first()[0]
    return catalog.cache_survivors(e, F.lit(now), days=1 / 24).select("cache_key", "url")


@query("WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '\\?[^#]*', ''), '/$', '') AS k FROM pages), h AS (SELECT DISTINCT k FROM p WHERE page_id % 2 = 0) SELECT page_id, k AS cache_key FROM p WHERE k NOT IN (SELECT k FROM h)")
def cache_misses(spark, sf_dir):
    p = session.table(spark, sf_dir, "pages").select("page_id", "url")
    have = p.where("page_id % 2 = 0").select(sources.normalize_url(F.col("url")).alias("cache_key"))
    return catalog.cache_misses(p, have).select("page_id", "cache_key")


@query("SELECT count(DISTINCT url) AS urls, 30 :: BIGINT AS usage, 40 :: BIGINT AS quota, 75.0 :: DOUBLE AS percent, 10 :: BIGINT AS available FROM pages")
def cache_stats(spark, sf_dir):
    return catalog.cache_stats(session.table(spark, sf_dir, "pages"), 30, 40)


def _models(spark, sf_dir) -> DataFrame:
    p = session.table(spark, sf_dir, "part")
    size = F.when(F.col("p_size") % 3 == 0, F.concat("p_size", F.lit(".5GB"))).otherwise(F.concat("p_size", F.lit("MB (Local - No Auth)")))
    return p.select(F.col("p_partkey").alias("name"), size.alias("size"), (F.col("p_size") % 2 == 0).alias("multimodal"), (F.col("p_size") % 5 == 0).alias("local"), F.when(F.col("p_size") % 7 == 0, F.lit("u")).alias("web_url"))


@query("SELECT p_partkey AS name, round(CASE WHEN p_size % 3 = 0 THEN (p_size + 0.5) * 1024 ELSE p_size END :: DOUBLE, 6) AS mb FROM part WHERE p_size % 2 = 0 AND (p_size % 5 = 0 OR p_size % 7 = 0)")
def catalog_filter_sort(spark, sf_dir):
    found = catalog.sort_catalog(catalog.filter_catalog(catalog.web_catalog(_models(spark, sf_dir)), multimodal=True, local=None), "size")
    return found.select("name", F.round(sources.size_in_mb(F.col("size")), 6).alias("mb"))


@query("SELECT page_id AS id, 'network' AS source_type, url, CASE WHEN page_id % 2 = 0 THEN 'inference' ELSE 'embedding' END AS type FROM pages WHERE page_id % 9 != 0")
def registry_codec(spark, sf_dir):
    """Rows to JSON and back; every ninth is damaged and goes."""
    p = session.table(spark, sf_dir, "pages")
    source = F.struct(F.lit("network").alias("type"), "url", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("resourceName"))
    rows = p.select(F.col("page_id").cast("string").alias("id"), source.alias("source"), F.lit("2025-01-01T00:00:00").alias("installedAt"), F.lit(5).cast("long").alias("sizeBytes"), F.when(F.col("page_id") % 2 == 0, "inference").otherwise("embedding").alias("type"), F.lit(False).alias("hasLoraWeights"))
    text = catalog.registry_json(rows).select(F.when(F.col("id").cast("long") % 9 == 0, F.lit("{broken")).otherwise(F.col("json")).alias("json"))
    return catalog.registry(text).select(F.col("id").cast("long").alias("id"), F.col("source.type").alias("source_type"), F.col("source.url").alias("url"), "type")


@query(f"WITH {_F} SELECT page_id % 20 AS spec, bool_and(page_id % 8 != 0 AND size >= CASE WHEN page_id % 4 = 2 THEN 1024 ELSE 1048576 END) AS installed FROM f GROUP BY 1")
def installed_specs(spark, sf_dir):
    f = _files(spark, sf_dir)
    rows = f.where("page_id % 8 != 0").select(F.col("filename").alias("id"))
    return catalog.installed_specs(f.select((F.col("page_id") % 20).alias("spec"), "filename"), rows, f.select("filename", "size"))


@query(f"WITH {_F} SELECT filename, CASE WHEN page_id % 3 = 0 THEN 'bundled' WHEN page_id % 5 = 0 THEN 'file' ELSE 'network' END AS source_type, CASE WHEN page_id % 3 = 0 THEN filename WHEN page_id % 5 = 0 THEN '/e/' || page_id ELSE 'https://unknown/' || filename END AS source FROM f")
def legacy_migration(spark, sf_dir):
    f = _files(spark, sf_dir)
    b = f.where("page_id % 3 = 0").select("filename", F.lit("x").alias("path"))
    e = f.where("page_id % 5 = 0").select("filename", F.concat(F.lit("/e/"), F.col("page_id")).alias("path"))
    lists = {("inference", False): f.where("page_id % 2 = 0"), ("embedding", False): f.where("page_id % 2 = 1")}
    return catalog.migrate(lists, b, e).select("filename", "source_type", "source")


@query("WITH e AS (SELECT event_id % 50 AS task, event_id % 4 AS i, event_id % 101 AS p, event_id FROM events), l AS (SELECT task, arg_max(i, event_id) AS i, arg_max(p, event_id) AS p FROM e GROUP BY task) SELECT task, least(greatest(round((i + p / 100.0) / 4 * 100), 0), 100) :: INTEGER AS percent FROM l")
def download_progress(spark, sf_dir):
    e = session.table(spark, sf_dir, "events").selectExpr("event_id % 50 AS task", "event_id % 4 AS file_index", "event_id % 101 AS percent", "4 AS files", "event_id AS ts")
    return tables.progress_events(e)


@query("SELECT page_id AS id FROM pages WHERE page_id % 2 = 1")
def replace_policy(spark, sf_dir):
    rows = session.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 2 == 0, "inference").otherwise("embedding").alias("type"))
    return catalog.replace_policy(rows, "inference", "replace").select("id")


@query("SELECT page_id AS id, page_id % 3 = 0 AS fresh FROM pages WHERE page_id % 4 != 0")
def registry_upsert(spark, sf_dir):
    rows = session.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit(False).alias("fresh"))
    saved = catalog.save(rows, rows.where("id % 3 = 0").withColumn("fresh", F.lit(True)))
    return catalog.remove(saved, rows.where("id % 4 = 0"))
