"""Sources and sinks: documents, lookup files, REST dumps."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.operators.analyze import clean

#: Limits of lookup files: nesting, characters of a string, digits of a number.
NESTING, STRING, DIGITS = 64, 20_000_000, 1_000


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, adf: one document a file."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("adf"))
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "adf")


def write_results(results: DataFrame, path: str, kind: str = "json") -> None:
    """Whole results; Spark's committer makes the job's files appear together."""
    results.write.mode("overwrite").format(kind).save(path)


def _checked(value, depth: int = 0):
    if depth > NESTING:
        raise ValueError("nested too deep")
    if isinstance(value, str) and len(value) > STRING or isinstance(value, int) and not isinstance(value, bool) and len(str(abs(value))) > DIGITS:
        raise ValueError("too long")
    for x in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        _checked(x, depth + 1)
    return value


def _load(spark: SparkSession, path: str):
    """A lookup file; a missing one raises as Spark does, a broken one ValueError."""
    rows = spark.read.text(path, wholetext=True).take(1)
    return _checked(json.loads(rows[0]["value"] if rows else ""))


def _fields(x: dict, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> dict:
    if not isinstance(x, dict) or set(x) - {*required, *optional} or any(x.get(k) is None for k in required):
        raise ValueError(f"expected {required} and perhaps {optional}: {x}")
    return x


def string_map(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, url) of an object of URLs by id; null is an empty URL."""
    found = _load(spark, path)
    if not isinstance(found, dict):
        raise ValueError("expected an object")
    return spark.createDataFrame([(k, "" if v is None else str(v)) for k, v in found.items()], f"{key} string, url string")


def page_trees(spark: SparkSession, path: str) -> DataFrame:
    """(macro, root, ord, depth, title, page_node_id) of {pagetree: {root: [entry]}, children: …}; the empty root is the page's own."""
    rows = []
    for macro, roots in _fields(_load(spark, path), (), ("pagetree", "children")).items():
        for root, entries in (roots or {}).items():
            for i, e in enumerate(entries):
                e = _fields(e, (), ("depth", "title", "pageNodeId"))
                depth = int(e.get("depth") or 0)
                if depth < 0:
                    raise ValueError("depth below 0")
                rows.append((macro, root or None, i, depth, e.get("title"), e.get("pageNodeId")))
    return spark.createDataFrame(rows, "macro string, root string, ord int, depth int, title string, page_node_id string")


def excerpts(spark: SparkSession, path: str) -> DataFrame:
    """(page, name, markdown); a later entry of the same page and name wins."""
    found = {}
    for x in _load(spark, path):
        x = _fields(x, ("page", "markdown"), ("name",))
        found[x["page"], x.get("name")] = x["markdown"]
    return spark.createDataFrame([(*k, v) for k, v in found.items()], "page string, name string, markdown string")


def extension_templates(spark: SparkSession, path: str) -> tuple[tuple[str | None, str, str], ...]:
    """(type, key, template) in order, for Hooks; the first that fits wins."""
    return tuple((x.get("type"), x["key"], x["template"]) for x in (_fields(e, ("key", "template"), ("type",)) for e in _load(spark, path)))


def attachments(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """One document's inventory; that it was supplied holds even when it is empty."""
    rows = [(doc_id, i, x["fileId"], x.get("title"), x.get("mediaType"), x.get("downloadUrl")) for i, x in enumerate(_fields(e, ("fileId",), ("title", "mediaType", "downloadUrl")) for e in _load(spark, path))]
    return spark.createDataFrame(rows, "doc_id bigint, ord int, file_id string, title string, media_type string, download_url string")


# ---- dumps of the REST interface

PAGE = T.StructType().add("title", "string").add("body", T.StructType().add("atlas_doc_format", "string"))
ATTACHMENTS = "struct<results:array<struct<fileId:string,title:string,mediaType:string,downloadLink:string>>,_links:struct<next:string>>"
PAGE_PATH = r"/pages/(?:edit-v\d+/)?(\d+)"


def page_id(url: Column) -> Column:
    """From the query, else from the path."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"[?&]pageId=(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(url, PAGE_PATH, 1), F.lit("")))


META = r"""(?is)<{tag}\b(?=[^>]*\b{key}\s*=\s*["']{value}["'])[^>]*\b{wanted}\s*=\s*["']([^"']*)["']"""


def _meta(html: Column, tag: str, key: str, value: str, wanted: str) -> Column:
    found = F.regexp_extract(html, META.format(tag=tag, key=key, value=value, wanted=wanted), 1)
    return clean(found)


def document_page_id(url: Column, html: Column) -> Column:
    """From the URL, else from the canonical link, the page's own URL, or the ids that its metadata carry."""
    links = [_meta(html, "link", "rel", "canonical", "href"), _meta(html, "meta", "property", "og:url", "content"), _meta(html, "meta", "name", "ajs-page-url", "content")]
    ids = [_meta(html, "meta", "name", n, "content") for n in ("ajs-page-id", "ajs-content-id", "ajs-draft-id")]
    return F.coalesce(page_id(url), *map(page_id, links), *[F.when(x.rlike("^[0-9]+$"), x) for x in ids])


def document_title(response_title: Column, html: Column) -> Column:
    """From the response, else from the page's metadata, else its title without the product's name; white space squeezed."""
    titles = [_meta(html, "meta", "name", "ajs-page-title", "content"), _meta(html, "meta", "property", "og:title", "content")]
    own = F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"(?i)\s+-\s+Confluence\s*$", "")
    found = F.coalesce(clean(response_title), *titles, clean(own))
    return F.trim(F.regexp_replace(found, r"\s+", " "))


def next_requests(dump: DataFrame, base: str = "") -> DataFrame:
    """doc_id, ord and url of the attachment requests that follow: the next pages that responses (doc_id, ord, response) name, up to 20 a page."""
    link = clean(F.get_json_object("response", "$._links.next"))
    url = F.when(link.rlike("^https?://"), link).otherwise(F.concat(F.lit(base), F.when(link.startswith("/"), link).otherwise(F.concat(F.lit("/"), link))))
    last = dump.groupBy("doc_id").agg(F.max_by(F.struct(F.col("ord"), url.alias("url")), "ord").alias("l"))
    return last.filter(F.col("l.url").isNotNull() & (F.col("l.ord") < 19)).select("doc_id", (F.col("l.ord") + 1).alias("ord"), "l.url")


def is_wiki(url: Column) -> Column:
    return url.rlike(r"^https://[^/?#]+\.atlassian\.net/wiki/")


def page_request(base: Column, page: Column) -> Column:
    return F.concat(base, F.lit("/wiki/api/v2/pages/"), page, F.lit("?body-format=atlas_doc_format"))


def attachments_request(base: Column, page: Column) -> Column:
    return F.concat(base, F.lit("/wiki/api/v2/pages/"), page, F.lit("/attachments?limit=250"))


def page_bodies(dump: DataFrame) -> DataFrame:
    """doc_id, title, adf and error of page responses (doc_id, response); a body may be a string, or hold one or a document as value."""
    body = F.get_json_object("response", "$.body.atlas_doc_format")
    value = F.get_json_object(body, "$.value")
    title = F.regexp_replace(clean(F.get_json_object("response", "$.title")), r" - Confluence$", "")
    adf = F.coalesce(value, body)
    missing = F.when(clean(adf).isNull(), F.lit("Confluence response did not include body.atlas_doc_format.value"))
    return dump.select("doc_id", title.alias("document_title"), adf.alias("adf"), missing.alias("error"))


def page_attachments(dump: DataFrame, base: str = "") -> DataFrame:
    """The inventory from attachment responses (doc_id, ord, response): file ids trimmed, blank ones dropped, links made absolute below /wiki."""
    one = dump.select("doc_id", "ord", F.posexplode(F.from_json("response", ATTACHMENTS)["results"]).alias("i", "r"))
    link = clean(F.col("r.downloadLink"))
    absolute = F.when(link.rlike("^https?://"), link).when(link.startswith("/wiki/"), F.concat(F.lit(base), link)).otherwise(F.concat(F.lit(base + "/wiki"), F.when(link.startswith("/"), link).otherwise(F.concat(F.lit("/"), link))))
    rows = one.select("doc_id", (F.col("ord") * 1_000_000 + F.col("i")).alias("ord"), clean(F.col("r.fileId")).alias("file_id"), F.col("r.title").alias("title"), F.col("r.mediaType").alias("media_type"), absolute.alias("download_url"))
    return rows.filter("file_id is not null")


CONTEXT = "struct<attachments:array<struct<fileId:string,title:string,mediaType:string,downloadUrl:string>>>"
VERSION = "1.0"


def context_inventory(messages: DataFrame) -> DataFrame:
    """The attachments that contexts (doc_id, context) carry, as an inventory; entries without a file id drop out."""
    one = messages.select("doc_id", F.posexplode(F.from_json("context", CONTEXT)["attachments"]).alias("ord", "x"))
    rows = one.select("doc_id", "ord", clean(F.col("x.fileId")).alias("file_id"), F.col("x.title").alias("title"), F.col("x.mediaType").alias("media_type"), clean(F.col("x.downloadUrl")).alias("download_url"))
    return rows.filter("file_id is not null")


def bridge(results: DataFrame) -> DataFrame:
    """doc_id, ok, lossy, warnings, errors, body, error: failures stay in band."""
    count = lambda s: F.size(F.filter("diagnostics", lambda d: d["severity"] == s))
    return results.select("doc_id", F.col("error").isNull().alias("ok"), "lossy", count("WARNING").alias("warnings"), count("ERROR").alias("errors"), "body", "error")


def valid_messages(messages: DataFrame) -> DataFrame:
    """Messages (type, sender_url, payload, context) that may be converted: a wiki sender, a payload, a context of at most 5000 attachments and nothing else."""
    context = F.try_parse_json("context")
    keys = F.json_object_keys("context")
    fits = F.col("context").isNull() | (F.coalesce(keys == F.array(F.lit("attachments")), F.size(keys) == 0, F.lit(False)) & (F.coalesce(F.json_array_length(F.get_json_object("context", "$.attachments")), F.lit(0)) <= 5000) & context.isNotNull())
    return messages.filter((F.col("type") == "convert") & is_wiki(F.col("sender_url")) & clean(F.col("payload")).isNotNull() & fits)
