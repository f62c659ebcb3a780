"""Relations over the node table, with DataFrame operations only.

All group by document (or document and value), so tables of documents scale
with the shuffle; first-seen order is the least path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as t
from docspark.plans import tree

#: Columns of the node table that the relations below read, all of them and those of files only.
FIELDS = ("doc_id", "path", "type", "known", "text", "level", "anchor", "links", "file", "ext_type", "ext_key", "params", "person", "unknown_marks")
FILE_FIELDS = ("doc_id", "path", "file", "ext_type", "ext_key", "params")
#: Columns and nodes that a relation reads, as parse.nodes takes them.
PAGE_TREES = (("doc_id", "path", "ext_type", "ext_key", "params"), lambda n: n.type in tree.EXTENSIONS)
LINKS = (("doc_id", "path", "links", "file"), lambda n: n.type in tree.CARDS or n.type in ("media", "mediaInline") or n.type == "text" and bool(n.marks))
HEADINGS = (("doc_id", "path", "type", "known", "text", "level", "anchor"), lambda n: n.type == "heading")
FILES = (FILE_FIELDS, lambda n: n.type in ("media", "mediaInline") or n.type in tree.EXTENSIONS)
#: The same for all sections of the metadata.
METADATA = (tuple(c for c in FIELDS if c != "unknown_marks"), lambda n: n.type == "mention" or any(of[1](n) for of in (PAGE_TREES, LINKS, HEADINGS)))
#: URLs of pages, the page id in the group (fixed value).
PAGE_URL = r"(?i)^(?:https?://[^/]+)?(?:/wiki)?(?:/spaces/[^/]+)?/pages/(?:edit-v\d+/)?(\d+)(?:/[^?#]*)?(?:\?.*)?(?:#.*)?$"


def stripped(c: Column) -> Column:
    """Without white space at either end, as the JVM does it."""
    return F.btrim(c, F.lit(t.JVM_SPACE))


def clean(c: Column) -> Column:
    """Stripped, null when nothing is left."""
    return F.nullif(stripped(c), F.lit(""))


def slug(text: Column) -> Column:
    words = F.array_join(F.regexp_extract_all(F.replace(F.lower(text), F.lit(" "), F.lit("-")), F.lit(r"(?U)[\w\-_]+"), F.lit(0)), "")
    return F.coalesce(F.nullif(words, F.lit("")), F.lit("section"))


def is_macro(*keys: str) -> Column:
    return (F.col("ext_type") == tree.MACRO) & F.col("ext_key").isin(*keys)


def numbered(df: DataFrame, order: str = "path") -> DataFrame:
    """ord from 0 by path within each document, in place of path."""
    return df.withColumn("ord", (F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) - 1).cast("int")).drop(order)


def outline(nodes: DataFrame) -> DataFrame:
    """doc_id, ord, level, text, anchor: explicit anchors don't advance the counters of slugs."""
    heads = nodes.filter((F.col("type") == "heading") & F.col("known") & clean(F.col("text")).isNotNull()).select("doc_id", "path", "level", "text", "anchor", slug(F.col("text")).alias("base"))
    by_slug = Window.partitionBy("doc_id", "base", F.col("anchor").isNull()).orderBy("path")
    made = F.when(F.row_number().over(by_slug) == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.row_number().over(by_slug) - 1))
    return numbered(heads.withColumn("anchor", F.coalesce("anchor", made)).drop("base"))


def toc_levels(nodes: DataFrame) -> DataFrame:
    """doc_id, level: levels that some table of contents shows."""
    whole = lambda k, d: F.coalesce(F.expr(f"try_cast(params['{k}'] AS int)"), F.lit(d))
    low, high = F.least(whole("minLevel", 1), whole("maxLevel", 6)), F.greatest(whole("minLevel", 1), whole("maxLevel", 6))
    cut = lambda c: F.greatest(F.lit(1), F.least(F.lit(6), c))
    tocs = nodes.filter(is_macro("toc") & F.col("type").isin("extension", "inlineExtension"))
    return tocs.select("doc_id", F.explode(F.sequence(cut(low), cut(high))).alias("level")).distinct()


def _links(nodes: DataFrame, media: bool = False) -> DataFrame:
    """doc_id, path, i, url, page (null: external) of links, in one pass; with ``media`` the URLs of external media follow a node's links."""
    links = F.transform("links", lambda x: F.struct(x["url"].alias("url"), x["page"].alias("page"), F.lit(False).alias("media")))
    some = F.size("links") > 0
    if media:
        external = F.coalesce(F.lower(clean(F.col("file.type"))) == "external", F.lit(False))
        own = F.struct(F.col("file.url").alias("url"), F.lit(None).cast("string").alias("page"), F.lit(True).alias("media"))
        links, some = F.when(external, F.concat(links, F.array(own))).otherwise(links), some | external
    one = nodes.filter(some).select("doc_id", "path", F.posexplode(links).alias("i", "l"))
    url = clean(F.col("l.url"))
    page = F.when(~F.col("l.media"), F.coalesce(F.nullif(F.regexp_extract(url, PAGE_URL, 1), F.lit("")), F.col("l.page")))
    return one.filter(url.isNotNull() & (F.col("l.media") | (url != "#"))).select("doc_id", "path", "i", url.alias("url"), page.alias("page"))


def by_document(df: DataFrame, dealt: bool = False) -> DataFrame:
    """Dealt by document once, which serves the groups and windows within documents that follow; ``dealt``: it is so already."""
    return df if dealt else df.repartition("doc_id")


def _first_seen(df: DataFrame, *values: str, dealt: bool = False) -> DataFrame:
    found = by_document(df, dealt).groupBy("doc_id", *values).agg(F.min(F.struct("path", "i")).alias("path"))
    return numbered(found)


def page_refs(nodes: DataFrame, dealt: bool = False) -> DataFrame:
    return _first_seen(_links(nodes).filter("page is not null").withColumnRenamed("page", "page_node_id"), "page_node_id", dealt=dealt)


def external_refs(nodes: DataFrame, dealt: bool = False) -> DataFrame:
    return _first_seen(_links(nodes, media=True).filter("page is null"), "url", dealt=dealt)


def page_and_external_refs(nodes: DataFrame) -> DataFrame:
    """doc_id, ord, page_node_id, url: the rows of page_refs (url null) and external_refs (page_node_id null), in one pass and one shuffle."""
    url = F.when(F.col("page").isNull(), F.col("url")).alias("url")
    found = by_document(_links(nodes, media=True).select("doc_id", "path", "i", F.col("page").alias("page_node_id"), url)).groupBy("doc_id", "page_node_id", "url").agg(F.min(F.struct("path", "i")).alias("path"))
    within = Window.partitionBy("doc_id", F.col("url").isNull()).orderBy("path")
    return found.select("doc_id", (F.row_number().over(within) - 1).cast("int").alias("ord"), "page_node_id", "url")


def mention_refs(nodes: DataFrame, dealt: bool = False) -> DataFrame:
    people = nodes.filter((F.col("type") == "mention") & F.col("known")).select("doc_id", "path", F.lit(0).alias("i"), F.col("person").alias("mention_id"), F.coalesce("text", F.lit("")).alias("text"))
    return _first_seen(people, "mention_id", "text", dealt=dealt)


def media_type(name: Column) -> Column:
    """By the extension of the last path segment; one with a slash in it isn't that segment's, and isn't known."""
    path = F.substring_index(F.substring_index(clean(name), "?", 1), "#", 1)
    extension = F.when(F.contains(path, F.lit(".")), F.lower(F.substring_index(path, ".", -1)))
    return F.element_at(F.create_map(*[F.lit(x) for kv in t.MEDIA_TYPES.items() for x in kv]), extension)


def attachment_refs(nodes: DataFrame, inventory: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """doc_id, ord, file_id, title, media_type: first-seen order, the last title and type that aren't blank."""
    seen = _files(nodes.filter(F.col("file").isNotNull() | is_macro("viewpdf")), inventory)
    if inventory is not None:
        own = valid_inventory(inventory)
        listed = nodes.filter(is_macro("attachments")).select("doc_id", "path").join(own.hint("merge"), "doc_id").select("doc_id", "path", F.col("ord").alias("i"), "file_id", clean(F.col("title")).alias("title"), clean(F.col("media_type")).alias("media_type"))
        seen = seen.unionByName(listed)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("path", "i"))).alias(c)
    return numbered(by_document(seen, dealt and inventory is None).groupBy("doc_id", "file_id").agg(F.min(F.struct("path", "i")).alias("path"), last("title"), last("media_type")))


def referenced_file_ids(nodes: DataFrame, inventory: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """doc_id, ord, file_id: each file that a document refers to, once, in first-seen order."""
    return attachment_refs(nodes, inventory, dealt).filter(clean(F.col("file_id")).isNotNull()).select("doc_id", "ord", "file_id")


def valid_inventory(inventory: DataFrame) -> DataFrame:
    """The first entry of each title, white space and case aside; entries without title or file id drop out."""
    norm = inventory.withColumn("title_key", F.lower(clean(F.col("title")))).filter(F.col("title_key").isNotNull() & clean(F.col("file_id")).isNotNull())
    return norm.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "title_key").orderBy("ord"))).filter("n = 1").drop("n")


def viewed(nodes: DataFrame, inventory: DataFrame | None) -> DataFrame:
    """Files that viewpdf macros show: by title in the inventory, else by the ids they carry."""
    return _files(nodes.filter(is_macro("viewpdf")), inventory)


def _files(shown: DataFrame, inventory: DataFrame | None) -> DataFrame:
    """doc_id, path, i, file_id, title, media_type of media nodes by what they carry, and of viewpdf macros; one pass over the nodes for both.

    Step by step: in one expression its parts would stand many times, in a method too long for the JVM to compile.
    """
    p = lambda k: F.col("params")[k]
    own_id = F.coalesce(*[F.nullif(p(k), F.lit("")) for k in ("fileId", "id", "attachmentId")])
    medium, known = F.col("medium"), F.col("known.file_id").isNotNull()
    fields = {f"m_{k}": stripped(F.col(f"file.{k}")) for k in ("file_name", "name", "alt", "mime", "media_type", "type", "id", "local_id")}
    rows = shown.select("doc_id", "path", F.col("file").isNotNull().alias("medium"), p("name").alias("name"), own_id.alias("own_id"), *[c.alias(k) for k, c in fields.items()])
    rows = rows.withColumns({k: F.nullif(F.col(k), F.lit("")) for k in fields}).withColumn("carried", F.coalesce("m_file_name", "m_name", "m_alt"))
    rows = rows.withColumn("named", media_type(F.when(medium, F.col("carried")).otherwise(F.col("name"))))
    if inventory is not None:
        rows = rows.withColumn("title_key", F.when(~medium, F.lower(clean(F.col("name")))))
        listed = valid_inventory(inventory).select("doc_id", "title_key", F.struct("file_id", "title", "media_type").alias("known"))
        rows = rows.join(listed.hint("merge"), ["doc_id", "title_key"], "left")
    else:
        rows = rows.withColumn("known", F.lit(None).cast("struct<file_id:string,title:string,media_type:string>"))
    file_id = F.when(medium, F.coalesce("m_id", "m_local_id")).otherwise(F.coalesce("known.file_id", "own_id"))
    title = F.when(medium, F.col("carried")).when(known, clean(F.col("known.title"))).otherwise(clean(F.col("name")))
    kind = F.when(medium, F.coalesce("m_mime", "m_media_type", "named", "m_type")).when(known, clean(F.col("known.media_type"))).otherwise(F.col("named"))
    found = rows.select("doc_id", "path", F.lit(0).alias("i"), file_id.alias("file_id"), title.alias("title"), kind.alias("media_type"))
    return found.filter("file_id is not null")


def page_tree_refs(nodes: DataFrame) -> DataFrame:
    """doc_id, ord, macro, root, depth, all_levels, params: every occurrence."""
    root = clean(F.when(F.col("ext_key") == "pagetree", F.col("params")["root"]).otherwise(F.col("params")["page"]))
    depth = F.expr("try_cast(params['depth'] AS int)")
    everything = F.lower(F.coalesce(clean(F.col("params")["all"]), clean(F.col("params")["allChildren"]))) == "true"
    found = nodes.filter(is_macro("pagetree", "children")).select("doc_id", "path", F.col("ext_key").alias("macro"), F.when(~root.startswith("@"), root).alias("root"), F.when(depth > 0, depth).alias("depth"), F.coalesce(everything, F.lit(False)).alias("all_levels"), "params")
    return numbered(found)


def excerpt_refs(nodes: DataFrame) -> DataFrame:
    page = clean(F.col("params")[""])
    return numbered(nodes.filter(is_macro("excerpt-include")).select("doc_id", "path", page.alias("page"), clean(F.col("params")["name"]).alias("name"), "params").filter("page is not null"))


def excerpts(nodes: DataFrame) -> DataFrame:
    """doc_id, ord, name, root_path: the subtree under root_path is the excerpt."""
    found = nodes.filter(is_macro("excerpt") & (F.col("type") == "bodiedExtension"))
    return numbered(found.select("doc_id", "path", clean(F.col("params")["name"]).alias("name"), F.col("path").alias("root_path")))


def lossiness(nodes: DataFrame, policy: str = "PLACEHOLDER") -> DataFrame:
    """doc_id, code, severity, message."""
    counts = nodes.groupBy("doc_id").agg(F.count_if(~F.col("known")).alias("n"), F.sum("unknown_marks").alias("m"))
    ends = {
        "PLACEHOLDER": ("UNKNOWN_NODE_PLACEHOLDER", "WARNING", " unsupported node(s) rendered as placeholders; original content not represented."),
        "SKIP": ("UNKNOWN_NODE_SKIPPED", "WARNING", " unsupported node(s) dropped from the output."), "PRESERVE_RAW": ("UNKNOWN_NODE_PRESERVED", "INFO", " unsupported node(s) preserved as raw JSON."),
    }
    note = lambda count, code, severity, end: F.when(F.col(count) > 0, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.concat(F.col(count).cast("string"), F.lit(end)).alias("message")))
    notes = [note("n", *ends[policy])] if policy in ends else []
    notes.append(note("m", "UNKNOWN_MARK_DROPPED", "WARNING", " unsupported mark(s) dropped from the output."))
    return counts.select("doc_id", F.explode(F.array_compact(F.array(*notes))).alias("d")).select("doc_id", "d.*")


def node_census(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


# ---- the corpus


def link_graph(nodes: DataFrame) -> DataFrame:
    """src, dst: documents that link to pages, each pair once."""
    return page_refs(nodes).select(F.col("doc_id").alias("src"), F.col("page_node_id").alias("dst")).distinct()


def degrees(graph: DataFrame) -> DataFrame:
    """page, n_in, n_out."""
    into = graph.groupBy(F.col("dst").alias("page")).agg(F.count("*").alias("n_in"))
    out = graph.groupBy(F.col("src").cast("string").alias("page")).agg(F.count("*").alias("n_out"))
    return into.join(out, "page", "full").select("page", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def broken_links(nodes: DataFrame, page_map: DataFrame) -> DataFrame:
    """Page references that the map doesn't know."""
    known = page_map.filter(clean(F.col("url")).isNotNull()).select("page_node_id").distinct()
    return page_refs(nodes).join(known, "page_node_id", "left_anti")


def fetch_plan(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """page_node_id and how many documents ask for it, of pages that aren't among docs."""
    wanted = page_refs(nodes).groupBy("page_node_id").agg(F.countDistinct("doc_id").alias("n"))
    return wanted.join(docs.select(F.col("doc_id").cast("string").alias("page_node_id")).distinct(), "page_node_id", "left_anti")
