"""File names, URLs and typed model sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Supported extensions in order, those of small files, and least sizes.
EXTENSIONS = (".task", ".bin", ".tflite", ".json", ".model", ".litertlm")
SMALL = (".json", ".model")
LEAST_SMALL, LEAST = 1024, 1048576
#: HTTP status, kind of error, title, whether to retry, whether the user must act.
DOWNLOAD_ERRORS = (
    (401, "unauthorized", "Authentication Required", False, True),
    (403, "forbidden", "Access Forbidden", False, True),
    (404, "not_found", "Model Not Found", False, True),
    (429, "rate_limited", "Rate Limited", True, False),
    (500, "server", "Server Error", True, False),
    (None, "network", "Network Error", True, False),
    (None, "canceled", "Download Canceled", False, False),
    (None, "unknown", "Download Failed", False, False),
)
#: What to do by resume status.
RESUME_ACTIONS = {"can_resume": "resume", "file_complete": "skip", "cannot_resume": "restart", "no_task": "restart", "file_not_found": "download", "error": "restart"}
#: By source type, whether it downloads, reports progress, resumes.
CAPABILITIES = {"network": (True, True, True), "asset": (False, True, False), "bundled": (False, False, False), "file": (False, False, False)}


def base_name(name: Column) -> Column:
    """All occurrences of each supported extension go, in order."""
    for e in EXTENSIONS:
        name = F.replace(name, F.lit(e), F.lit(""))
    return name


def extension(name: Column) -> Column:
    """From the last dot; empty without one or with nothing behind it."""
    return F.regexp_extract(name, r"(\.[^.]+)\z", 1)


def file_extension(name: Column) -> Column:
    """From the last dot, which may stand alone."""
    return F.regexp_extract(name, r"(\.[^.]*)\z", 1)


def supported(name: Column) -> Column:
    return extension(name).isin(*EXTENSIONS)


def least_size(name: Column) -> Column:
    return F.when(extension(name).isin(*SMALL), LEAST_SMALL).otherwise(LEAST)


def file_valid(name: Column, size: Column) -> Column:
    """size -1 means unknown, so null."""
    return F.when(size >= 0, size) >= least_size(name)


def model_type(name: Column) -> Column:
    return F.when(F.lower(F.regexp_extract(name, r"([^.]*)\z", 1)).isin("tflite", "json"), "embedding").otherwise("inference")


def normalize_url(url: Column) -> Column:
    """Without query, then without one trailing slash; a fragment stays."""
    bare = F.regexp_replace(url, r"\?[^#]*", "")
    return F.regexp_replace(F.regexp_replace(bare, r"/\z", ""), r"\?\z", "")


def parse_source(url: Column) -> Column:
    """struct(type, value) of a URL text; without a scheme it is an asset."""
    out = F.when(url.startswith("https://") | url.startswith("http://"), F.struct(F.lit("network").alias("type"), url.alias("value")))
    for scheme, kind in (("asset", "asset"), ("native", "bundled"), ("file", "file")):
        out = out.when(url.startswith(f"{scheme}://"), F.struct(F.lit(kind).alias("type"), url.substr(F.lit(len(scheme) + 4), F.length(url)).alias("value")))
    return out.otherwise(F.struct(F.lit("asset").alias("type"), url.alias("value")))


def source_url(kind: Column, value: Column) -> Column:
    return F.when(kind == "network", value).when(kind == "asset", F.concat(F.lit("asset://"), value)).when(kind == "bundled", F.concat(F.lit("native://"), value)).otherwise(F.concat(F.lit("file://"), value))


def source_error(kind: Column, value: Column) -> Column:
    """Why a source is invalid; null if it is valid."""
    return (
        F.when(value == "", "empty")
        .when((kind == "network") & ~value.rlike(r"(?i)\Ahttps?:"), "not http")
        .when((kind == "asset") & value.contains(".."), "parent reference")
        .when((kind == "asset") & value.startswith("http"), "is a url")
        .when((kind == "bundled") & value.contains("/"), "separator")
        .when((kind == "bundled") & value.contains(" "), "space")
        .when((kind == "file") & ~value.startswith("/"), "not absolute")
    )


def asset_path(path: Column) -> Column:
    bare = F.regexp_replace(path, r"\A/", "")
    return F.when(bare.startswith("assets/"), bare).otherwise(F.concat(F.lit("assets/"), bare))


def asset_key(path: Column) -> Column:
    return F.regexp_replace(asset_path(path), r"\Aassets/", "")


def capabilities(kind: Column) -> Column:
    """struct(requires_download, supports_progress, supports_resume)."""
    out = None
    for k, flags in CAPABILITIES.items():
        s = F.struct(*[F.lit(x).alias(n) for n, x in zip(("requires_download", "supports_progress", "supports_resume"), flags, strict=True)])
        out = F.when(kind == k, s) if out is None else out.when(kind == k, s)
    return out


def lora_valid(kind: Column, lora_kind: Column) -> Column:
    return lora_kind.isNull() | (kind == lora_kind)


def source_filename(kind: Column, value: Column) -> Column:
    path = F.when(kind == "network", F.coalesce(F.try_parse_url(value, F.lit("PATH")), value)).otherwise(value)
    return F.element_at(F.split(path, "/", -1), -1)


def android_path(folder: Column, name: Column) -> Column:
    return F.concat(F.regexp_replace(folder, r"\A(.*?)/data/user/0/", "$1/data/data/"), F.lit("/"), name)


def retry_decision(status: Column, can_resume: Column, attempt: Column, most: int = 10) -> Column:
    """struct(decision, delay): fail on 401, 403, 404; else resume, or retry after 2 * attempt seconds."""
    terminal = F.coalesce(status.isin(401, 403, 404), F.lit(False))
    decision = F.when(terminal, "fail").when(F.coalesce(can_resume, F.lit(False)), "resume").when(attempt < most, "retry").otherwise("give_up")
    return F.struct(decision.alias("decision"), F.when(decision == "retry", attempt * 2).alias("delay"))


def error_of_status(status: Column) -> Column:
    """struct(kind, title, retryable, user_action) of an HTTP status; null is the network's."""
    made = {k: F.struct(F.lit(k).alias("kind"), F.lit(t).alias("title"), F.lit(r).alias("retryable"), F.lit(u).alias("user_action")) for _, k, t, r, u in DOWNLOAD_ERRORS}
    return F.when(status.isNull(), made["network"]).when(status == 401, made["unauthorized"]).when(status == 403, made["forbidden"]).when(status == 404, made["not_found"]).when(status == 429, made["rate_limited"]).when(status >= 500, made["server"]).otherwise(made["unknown"])


def resume_status(size: Column, has_task: Column, can_resume: Column) -> Column:
    """size null: no file.  One MiB counts as complete, whatever the file."""
    return F.when(size.isNull(), "file_not_found").when(size >= LEAST, "file_complete").when(~has_task, "no_task").when(can_resume, "can_resume").otherwise("cannot_resume")


def resume_action(status: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in RESUME_ACTIONS.items() for x in kv]), status)


def size_in_mb(text: Column) -> Column:
    """'3.1GB' in megabytes; 0 where no number can be read."""
    n = F.coalesce(F.regexp_replace(text, "[^0-9.]", "").try_cast("double"), F.lit(0.0))
    up = F.upper(text)
    return F.when(up.contains("GB"), n * 1024).when(up.contains("TB"), n * 1048576).otherwise(n)


def quota(usage: Column, limit: Column) -> Column:
    """struct(percent, available); percent is null without a limit."""
    return F.struct((F.try_divide(usage, limit) * 100).alias("percent"), (limit - usage).alias("available"))


def progress(index: Column, percent: Column, total: Column) -> Column:
    """Overall percent of several files."""
    value = F.round((index + percent / 100.0) / F.nullif(total, F.lit(0)) * 100)
    return F.coalesce(F.least(F.greatest(value, F.lit(0)), F.lit(100)), F.lit(0)).cast("int")


def is_hub_url(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")).contains("huggingface.co"), F.lit(False))
