"""Model registry, storage, downloads and caches as joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.functions import sources

SOURCE = "struct<type:string,url:string,path:string,resourceName:string>"
REGISTRY = f"id string, source {SOURCE}, installedAt string, sizeBytes long, type string, hasLoraWeights boolean"
STATUSES = ("can_resume", "file_complete", "cannot_resume", "no_task", "file_not_found", "error")


class CacheQuotaError(RuntimeError):
    pass


def registry(rows: DataFrame, text: str = "json") -> DataFrame:
    """Registry rows from JSON text; what can't be read, has no id or an unknown source type, goes."""
    parsed = rows.select(F.from_json(text, f"{REGISTRY}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    good = parsed.where("_corrupt is null and id is not null and id != '' and source.type in ('network', 'asset', 'bundled', 'file')").drop("_corrupt")
    return good.withColumn("type", F.regexp_replace("type", r"^ModelType\.", ""))


def registry_json(rows: DataFrame) -> DataFrame:
    """(id, json): enums are printed with their class."""
    fields = [F.concat(F.lit("ModelType."), F.col("type")).alias("type") if n == "type" else F.col(n) for n in ("id", "source", "installedAt", "sizeBytes", "type", "hasLoraWeights")]
    return rows.select("id", F.to_json(F.struct(*fields)).alias("json"))


def save(current: DataFrame, new: DataFrame) -> DataFrame:
    """Registry with rows of `new` in place of those of equal ids; the greatest row stands for several of one id, and a
    row without an id is an error."""
    rest = [c for c in new.columns if c != "id"]
    one = new.groupBy("id").agg(F.max(F.struct(*rest)).alias("r")) if rest else new.distinct()
    named = F.when(F.coalesce(F.col("id").cast("string"), F.lit("")) != "", F.col("id")).otherwise(F.raise_error("a row has no id"))
    made = one.select(named.alias("id"), *[F.col(f"r.{c}").alias(c) for c in rest]).select(*new.columns)
    return current.join(new.select("id").distinct(), "id", "left_anti").unionByName(made)


def remove(current: DataFrame, ids: DataFrame) -> DataFrame:
    return current.join(ids.select("id"), "id", "left_anti")


def of_type(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.col("type") == kind).select("id")


def exists(rows: DataFrame, condition: Column) -> bool:
    return not rows.where(condition).limit(1).isEmpty()


def installed_specs(files: DataFrame, rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(spec, installed): all files (spec, filename) are registered and large enough."""
    known = rows.select(F.col("id").alias("filename"), F.lit(True).alias("registered"))
    joined = files.join(known, "filename", "left").join(sizes, "filename", "left")
    ok = F.col("registered").isNotNull() & F.coalesce(sources.file_valid(F.col("filename"), F.col("size")), F.lit(False))
    return joined.groupBy("spec").agg(F.bool_and(ok).alias("installed"))


def protected(*lists: DataFrame) -> DataFrame:
    """Different file names of several lists."""
    out = lists[0].select("filename")
    for x in lists[1:]:
        out = out.unionByName(x.select("filename"))
    return out.distinct()


def orphans(files: DataFrame, keep: DataFrame, tasks: DataFrame, records: DataFrame) -> DataFrame:
    """Supported files that nothing protects and no running or unfinished download holds."""
    busy = tasks.select("filename").unionByName(records.where("status != 'complete'").select("filename"))
    return files.where(sources.supported(F.col("filename"))).join(keep, "filename", "left_anti").join(busy, "filename", "left_anti")


def storage(files: DataFrame, orphan: DataFrame) -> DataFrame:
    """(files, bytes, orphans, orphan_bytes, megabytes) in one pass; names may stand in orphan several times."""
    marked = files.where(sources.supported(F.col("filename"))).join(orphan.select("filename").distinct().withColumn("o", F.lit(1)), "filename", "left")
    return marked.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("o").alias("orphans"), F.coalesce(F.sum(F.when(F.col("o") == 1, F.col("size"))), F.lit(0)).alias("orphan_bytes"), (F.coalesce(F.sum("size"), F.lit(0)) / 1048576).alias("megabytes"))


def legacy_storage(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(protected, bytes, megabytes, inference, embedding): sizes 0 where unknown, two files an embedding model."""
    joined = rows.join(sizes, rows["id"] == sizes["filename"], "left")
    return joined.agg(F.count("*").alias("protected"), F.coalesce(F.sum(F.coalesce("size", F.lit(0))), F.lit(0)).alias("bytes"), F.round(F.coalesce(F.sum(F.coalesce("size", F.lit(0))), F.lit(0)) / 1048576).cast("long").alias("megabytes"), F.count_if(F.col("type") == "inference").alias("inference"), F.expr("count_if(type = 'embedding') div 2").alias("embedding"))


def resume(files: DataFrame, tasks: DataFrame, records: DataFrame) -> DataFrame:
    """files (filename, size or null) with status and action; a task, else a record, tells whether it can go on."""
    one = lambda d, n: d.groupBy("filename").agg(F.min("can_resume").alias(n))
    joined = files.join(one(tasks, "t"), "filename", "left").join(one(records, "r"), "filename", "left")
    can = F.coalesce("t", "r")
    status = sources.resume_status(F.col("size"), can.isNotNull(), F.coalesce(can, F.lit(False)))
    return joined.select("filename", "size", status.alias("status")).withColumn("action", sources.resume_action(F.col("status")))


def resume_histogram(rows: DataFrame, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """(status, n) for every status, and the total."""
    domain = rows.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    counted = domain.join(rows.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    return counted.unionByName(rows.agg(F.lit("total").alias("status"), F.count("*").alias("n")))


def cache_survivors(entries: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Entries (cache_key, url, timestamp) without those older than the limit; one key may have several URLs, and
    goes only if its youngest is too old."""
    age = now.cast("double") - F.col("timestamp").cast("double")
    old = entries.groupBy("cache_key").agg(F.min(age).alias("age")).where(F.col("age") > days * 86400).select("cache_key")
    return entries.join(old, "cache_key", "left_anti")


def cache_misses(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Requested URLs whose normal form has no entry."""
    keyed = requests.withColumn("cache_key", sources.normalize_url(F.col("url")))
    return keyed.join(entries.select("cache_key").distinct(), "cache_key", "left_anti")


def cache_requests(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """requests (url) with cache_key, hit and percent: 100 at once for what is there, 0 for what is to be loaded."""
    keyed = requests.withColumn("cache_key", sources.normalize_url(F.col("url")))
    have = entries.select("cache_key").distinct().withColumn("hit", F.lit(True))
    found = keyed.join(have, "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return found.withColumn("percent", F.when(F.col("hit"), 100).otherwise(0))


def get_or_load(requests: DataFrame, entries: DataFrame, load: Callable[[DataFrame], DataFrame], now: Column, quota: int, days: int = 30) -> DataFrame:
    """entries (cache_key, url, timestamp, size) after the requests: load() gives (cache_key, url, size) for each missing
    key, once.  Where all together exceed the quota, entries beyond their time go and it is tried once more; if that is
    not enough, it is an error and nothing is added."""
    misses = cache_misses(requests, entries).groupBy("cache_key").agg(F.min("url").alias("url"))
    loaded = load(misses).select("cache_key", "url", now.alias("timestamp"), "size")
    need = loaded.agg(F.sum("size")).first()[0] or 0
    for kept in (entries, cache_survivors(entries, now, days)):
        if (kept.agg(F.sum("size")).first()[0] or 0) + need <= quota:
            return kept.select("cache_key", "url", "timestamp", "size").unionByName(loaded)
    raise CacheQuotaError(f"{need} bytes don't fit {quota}")


def cache_stats(entries: DataFrame, usage: int, limit: int) -> DataFrame:
    q = sources.quota(F.lit(usage), F.lit(limit))
    return entries.agg(F.count_distinct("url").alias("urls")).select("urls", F.lit(usage).cast("long").alias("usage"), F.lit(limit).cast("long").alias("quota"), q["percent"].alias("percent"), q["available"].cast("long").alias("available"))


def replace_policy(rows: DataFrame, kind: str, policy: str) -> DataFrame:
    """What of the registry stays before an install: 'replace' removes all of the type."""
    return rows.where(F.col("type") != kind) if policy == "replace" else rows


def migrate(lists: dict[tuple[str, bool], DataFrame], bundled: DataFrame, external: DataFrame, done: bool = False) -> DataFrame:
    """Registry rows of legacy lists ((type, has_lora) -> filename): bundled before external before unknown network.  done:
    the flag of an earlier run; then there is nothing left to migrate.  A name's least path counts."""
    every = None
    for (kind, lora), names in lists.items():
        part = names.select("filename", F.lit(kind).alias("type"), F.lit(lora).alias("has_lora"))
        every = part if every is None else every.unionByName(part)
    if done:
        every = every.limit(0)
    b, e = (x.groupBy("filename").agg(F.min("path").alias(n)) for x, n in ((bundled, "b"), (external, "e")))
    joined = every.join(b, "filename", "left").join(e, "filename", "left")
    kind = F.when(F.col("b").isNotNull(), "bundled").when(F.col("e").isNotNull(), "file").otherwise("network")
    value = F.when(F.col("b").isNotNull(), F.col("filename")).when(F.col("e").isNotNull(), F.col("e")).otherwise(F.concat(F.lit("https://unknown/"), F.col("filename")))
    return joined.select("filename", "type", "has_lora", kind.alias("source_type"), value.alias("source"))


def migration_counts(migrated: DataFrame, current: DataFrame) -> DataFrame:
    """(migrated, skipped): skipped are those registered already."""
    there = migrated.join(current.select(F.col("id").alias("filename"), F.lit(1).alias("x")), "filename", "left")
    return there.agg(F.count_if(F.col("x").isNull()).alias("migrated"), F.count("x").alias("skipped"))


def filter_catalog(models: DataFrame, **flags: bool | None) -> DataFrame:
    """Rows for which every flag that is asked for holds."""
    for name, wanted in flags.items():
        if wanted:
            models = models.where(F.col(name))
    return models


def web_catalog(models: DataFrame) -> DataFrame:
    return models.where("local or web_url is not null")


def sort_catalog(models: DataFrame, by: str = "default") -> DataFrame:
    if by == "name":
        return models.orderBy("name")
    if by == "size":
        return models.orderBy(sources.size_in_mb(F.col("size")))
    return models


def oldest_first(entries: DataFrame) -> DataFrame:
    return entries.orderBy("timestamp", "cache_key")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as (filename, path, size, modified); their content is not read."""
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("image_bytes"))


def latest(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])
