"""Documents to Markdown results, with lookups joined in from tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import text as t
from docspark.operators import analyze, parse
from docspark.plans import render

FILE = "struct<file_id:string,title:string,media_type:string,download_url:string>"
TREE = "struct<macro:string,root:string,entries:array<struct<depth:int,title:string,page_node_id:string>>>"
EXCERPT = "struct<page:string,name:string,markdown:string>"
RESULT = (
    "body string, diagnostics array<struct<code:string,severity:string,message:string>>, lossy boolean, "
    "unresolved struct<page_ids:array<string>,page_trees:array<struct<macro:string,root:string>>,excerpts:array<struct<page:string,name:string>>>, error string"
)
RESULT_SCHEMA = pa.schema(
    [
        ("body", pa.string()), ("diagnostics", pa.list_(pa.struct([("code", pa.string()), ("severity", pa.string()), ("message", pa.string())]))), ("lossy", pa.bool_()),
        ("unresolved", pa.struct([("page_ids", pa.list_(pa.string())), ("page_trees", pa.list_(pa.struct([("macro", pa.string()), ("root", pa.string())]))), ("excerpts", pa.list_(pa.struct([("page", pa.string()), ("name", pa.string())])))])),
        ("error", pa.string()),
    ]
)
#: Optional input columns that carry a document's own lookups.
COLUMNS = {
    "document_title": "string", "attachments": f"array<{FILE}>", "page_urls": "map<string,string>", "media_urls": "map<string,string>",
    "attachment_urls": "map<string,string>", "page_trees": f"array<{TREE}>", "excerpts": f"array<{EXCERPT}>",
}


@dataclass(frozen=True)
class Hooks:
    """Functions and templates that hold for all documents; a column's entry comes first, then the function, then the template.

    Templates hold {id}, {page} and the like; templates of extensions are
    (type or None, key, template) and the first that fits wins.
    """

    media: Callable[[dict], str | None] | None = None
    attachment: Callable[[dict], str | None] | None = None
    page: Callable[[str], str | None] | None = None
    page_tree: Callable[[dict], list[dict] | None] | None = None
    excerpt: Callable[[dict], str | None] | None = None
    extensions: tuple[Callable[[dict], str | None], ...] = ()
    media_template: str | None = None
    attachment_template: str | None = None
    page_template: str | None = None
    extension_templates: tuple[tuple[str | None, str, str], ...] = field(default_factory=tuple)


def _chain(table: dict | None, key: Callable, function: Callable | None, template: str | None, values: Callable):
    """A resolver from a map, a function and a URL template; None when none of them is given."""
    if table is None and function is None and template is None:
        return None

    def resolve(asked):
        found = (table or {}).get(key(asked))
        if t.blank(found) and function is not None:
            found = function(asked)
        if t.blank(found) and template is not None and (named := values(asked)):
            found = t.expand_template(template, named)
        return found

    return resolve


def lookups(row: dict, hooks: Hooks) -> render.Lookups:
    trees = row.get("page_trees")
    texts = row.get("excerpts")
    tree_of = {(x["macro"], x["root"]): x["entries"] for x in trees or ()}
    text_of = {(x["page"], x["name"]): x["markdown"] for x in texts or ()}
    by_tree = (lambda a: tree_of.get((a["macro"], a["root"]), hooks.page_tree(a) if hooks.page_tree and (a["macro"], a["root"]) not in tree_of else None)) if trees is not None or hooks.page_tree else None
    by_text = (lambda a: text_of[(a["page"], a["name"])] if (a["page"], a["name"]) in text_of else hooks.excerpt(a) if hooks.excerpt else None) if texts is not None or hooks.excerpt else None
    own = [_template_extension(x) for x in hooks.extension_templates]
    return render.Lookups(
        attachments=row.get("attachments"),
        media=_chain(row.get("media_urls"), lambda m: m["id"], hooks.media, hooks.media_template, lambda m: None if t.blank(m["id"]) else {"id": m["id"], "collection": m["collection"] or ""}),
        attachment=_chain(row.get("attachment_urls"), lambda a: a["file_id"], hooks.attachment, hooks.attachment_template, lambda a: {"id": a["file_id"], "fileId": a["file_id"], "title": a.get("title") or ""}),
        page=_chain(row.get("page_urls"), lambda p: p, hooks.page, hooks.page_template, lambda p: {"id": p}),
        page_tree=by_tree, excerpt=by_text, extensions=[*hooks.extensions, *own],
    )


def _template_extension(entry: tuple[str | None, str, str]):
    kind, key, template = entry

    def run(asked: dict) -> str | None:
        if asked["key"] != key or kind is not None and asked["type"] != kind:
            return None
        return t.expand_template(template, {"key": key, "type": asked["type"] or "", "text": asked["text"] or "", **asked["params"]})

    return run


def convert(docs: DataFrame, options: render.Options = render.Options(), hooks: Hooks = Hooks(), keep: tuple[str, ...] = ("doc_id",), raise_errors: bool = False) -> DataFrame:
    """docs' columns ``keep`` and the result of each ``adf``: body, diagnostics, lossy, unresolved, error.

    Narrow and stateless, so the same call serves batches and streams.  Columns
    of COLUMNS, where present, are a document's own lookups: null is "not
    supplied", an empty list is an answer.
    """
    given = [c for c in COLUMNS if c in docs.columns]

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            results = []
            for row in rows:
                for c in ("page_urls", "media_urls", "attachment_urls"):
                    if row.get(c) is not None:
                        row[c] = dict(row[c])
                results.append(render.convert(row["adf"], options, lookups(row, hooks), row.get("document_title")))
                if raise_errors and results[-1]["error"]:
                    raise render.UnsupportedNode(results[-1]["error"])
            made = pa.RecordBatch.from_pylist(results, RESULT_SCHEMA)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *made.columns], names=[*keep, *RESULT_SCHEMA.names])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "adf", *given])).mapInArrow(run, f"{kinds}, {RESULT}")


# ---- lookups from tables


@dataclass(frozen=True)
class Tables:
    """Lookup tables; each is optional.

    attachments(doc_id, ord, file_id, title, media_type, download_url),
    media(file_id, url), attachment_urls(file_id, url), pages(page_node_id, url),
    page_trees(macro, root, ord, depth, title, page_node_id), excerpts(page, name, markdown).
    """

    attachments: DataFrame | None = None
    media: DataFrame | None = None
    attachment_urls: DataFrame | None = None
    pages: DataFrame | None = None
    page_trees: DataFrame | None = None
    excerpts: DataFrame | None = None


def _url_map(refs: DataFrame, key: str, table: DataFrame, name: str) -> DataFrame:
    """doc_id and a map of the keys it refers to: only what is asked for travels.

    Of several URLs of one key the last in the column ord wins, or else the greatest.
    """
    order = F.struct("ord", "url") if "ord" in table.columns else F.col("url")
    hits = refs.select("doc_id", key).distinct().join(table.groupBy(key).agg(F.max_by("url", order).alias("url")), key)
    return hits.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(key, "url"))).alias(name))


def with_lookups(docs: DataFrame, nodes: DataFrame, tables: Tables) -> DataFrame:
    """docs with the lookup columns that its references need, by equi-joins on what the nodes refer to.

    Tables of a row or more for each document grow with the corpus, and Spark
    takes them for much smaller than they are; so they are never broadcast.
    """
    out = docs
    empty = {c: F.from_json(F.lit("{}" if k.startswith("map") else "[]"), k) for c, k in COLUMNS.items() if k != "string"}

    def add(found: DataFrame, name: str) -> None:
        nonlocal out
        out = out.join(found.hint("merge"), "doc_id", "left").withColumn(name, F.coalesce(name, empty[name]))

    if tables.attachments is not None:
        rows = tables.attachments.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "file_id", "title", "media_type", "download_url"))).alias("a"))
        out = out.join(rows.hint("merge"), "doc_id", "left").withColumn("attachments", F.transform("a", lambda x: F.struct(x["file_id"].alias("file_id"), x["title"].alias("title"), x["media_type"].alias("media_type"), x["download_url"].alias("download_url")))).drop("a")
        if "attachments_supplied" in out.columns:
            out = out.withColumn("attachments", F.when(F.col("attachments_supplied"), F.coalesce("attachments", empty["attachments"])))
    if tables.pages is not None:
        asked = analyze.page_refs(nodes).select("doc_id", "page_node_id")
        if tables.page_trees is not None:
            listed = analyze.page_tree_refs(nodes).join(tables.page_trees.drop("depth", "ord"), ["macro", "root"]).select("doc_id", "page_node_id")
            asked = asked.unionByName(listed.filter("page_node_id is not null"))
        add(_url_map(asked, "page_node_id", tables.pages, "page_urls"), "page_urls")
    files = nodes.filter("file is not null").select("doc_id", F.col("file.id").alias("file_id"))
    if tables.media is not None:
        add(_url_map(files, "file_id", tables.media, "media_urls"), "media_urls")
    if tables.attachment_urls is not None:
        asked = analyze.viewed(nodes, tables.attachments).select("doc_id", "file_id")
        if tables.attachments is not None:
            asked = asked.unionByName(tables.attachments.select("doc_id", "file_id"))
        add(_url_map(asked, "file_id", tables.attachment_urls, "attachment_urls"), "attachment_urls")
    if tables.page_trees is not None:
        entries = tables.page_trees.groupBy("macro", "root").agg(F.sort_array(F.collect_list(F.struct("ord", "depth", "title", "page_node_id"))).alias("e"))
        entries = entries.withColumn("entries", F.transform("e", lambda x: F.struct(x["depth"].cast("int").alias("depth"), x["title"].alias("title"), x["page_node_id"].alias("page_node_id")))).drop("e")
        asked = analyze.page_tree_refs(nodes).select("doc_id", "macro", "root").distinct()
        hits = asked.join(entries, (asked["macro"] == entries["macro"]) & asked["root"].eqNullSafe(entries["root"])).select("doc_id", F.struct(asked["macro"], asked["root"], "entries").alias("t"))
        add(hits.groupBy("doc_id").agg(F.collect_list("t").alias("page_trees")), "page_trees")
    if tables.excerpts is not None:
        asked = analyze.excerpt_refs(nodes).select("doc_id", "page", "name").distinct()
        texts = tables.excerpts.select("page", "name", "markdown")
        hits = asked.join(texts, (asked["page"] == texts["page"]) & asked["name"].eqNullSafe(texts["name"])).select("doc_id", F.struct(asked["page"], asked["name"], "markdown").alias("t"))
        add(hits.groupBy("doc_id").agg(F.collect_list("t").alias("excerpts")), "excerpts")
    return out


def excerpt_bodies(docs: DataFrame, keep: str = "doc_id", options: render.Options = render.Options()) -> DataFrame:
    """``keep``, ord, name and markdown of each excerpt that a document defines, its body rendered alone."""
    from docspark.plans import tree

    def run(batches):
        for batch in batches:
            found: list[list] = [[], [], [], []]
            for key, adf in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks, _ = tree.parse(adf)
                shown = (n for _, n in tree.walk(blocks or []) if n.known and n.type == "bodiedExtension" and tree.string(n.attrs.get("extensionType")) == tree.MACRO and tree.string(n.attrs.get("extensionKey")) == "excerpt")
                for order, n in enumerate(shown):
                    for column, value in zip(found, (key, order, t.clean(tree.macro_params(n).get("name")), render.Fold(n.children, options, render.Lookups()).body()), strict=True):
                        column.append(value)
            kinds = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(found, kinds, strict=True)], names=[keep, "ord", "name", "markdown"])

    return docs.filter("adf like '%excerpt%'").select(keep, "adf").mapInArrow(run, f"{keep} {docs.schema[keep].dataType.simpleString()}, ord int, name string, markdown string")


def corpus_excerpts(docs: DataFrame, title: str = "document_title", options: render.Options = render.Options()) -> DataFrame:
    """page, name, markdown: the excerpts that documents define, rendered; of one name the document's last wins.

    Definitions are rendered in a first pass and joined into the second, so a
    corpus resolves its own includes.  Where documents of one title define the
    same name, that of the largest doc_id (if there is one), then of the
    greatest text, wins in every run.
    """
    order = [F.col("doc_id")] if "doc_id" in docs.columns else []
    own = docs.select(F.struct(F.col(title).alias("page"), *order).alias("of"), "adf")
    found = excerpt_bodies(own, "of", options)
    return found.groupBy(F.col("of.page").alias("page"), "name").agg(F.max_by("markdown", F.struct(*[F.col("of.doc_id")] * bool(order), "ord", "markdown")).alias("markdown"))


# ---- results


def gate(results: DataFrame, fail_on: str) -> DataFrame:
    """Results that pass: fail_on lossy, warning (of any severity from warning on) or error."""
    if fail_on == "lossy":
        return results.filter(~F.col("lossy") & F.col("error").isNull())
    levels = {"warning": ("WARNING", "ERROR"), "error": ("ERROR",)}[fail_on]
    return results.filter(~F.exists("diagnostics", lambda d: d["severity"].isin(*levels)) & F.col("error").isNull())


def exit_code(results: DataFrame, fail_on: str | None = None) -> int:
    """0, 4 when a gate fails, 70 when a document broke off."""
    if not results.filter("error is not null").isEmpty():
        return 70
    if fail_on and not results.join(gate(results, fail_on).select("doc_id"), "doc_id", "left_anti").isEmpty():
        return 4
    return 0


def to_json(results: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id and the whole result as JSON: body, wasLossy, diagnostics, metadata, unresolved.

    known: metadata()'s rows of the same documents; without them metadata is empty.
    """
    plain = {"ignoreNullFields": "false"}
    unresolved = F.struct(
        F.col("unresolved.page_ids").alias("pageIds"),
        F.transform("unresolved.page_trees", lambda x: F.struct(x["macro"].alias("macro"), x["root"].alias("root"))).alias("pageTreeRefs"),
        F.transform("unresolved.excerpts", lambda x: F.struct(x["page"].alias("page"), x["name"].alias("excerptName"))).alias("excerptRefs"),
    )
    both = results.join(known.select("doc_id", F.col("json").alias("_metadata")).hint("merge"), "doc_id", "left") if known is not None else results.withColumn("_metadata", F.lit(None).cast("string"))
    ends = F.to_json(F.struct("diagnostics"), plain), F.to_json(F.struct(unresolved.alias("unresolved")), plain)
    inner = lambda c: F.substr(c, F.lit(2), F.length(c) - 2)
    whole = F.concat(
        F.lit('{"body":'), json_value("body"), F.lit(',"wasLossy":'), F.col("lossy").cast("string"), F.lit(","), inner(ends[0]), F.lit(',"metadata":'), F.coalesce("_metadata", F.lit("{}")), F.lit(","), inner(ends[1]), F.lit("}")
    )
    return both.select("doc_id", whole.alias("json"))


def json_value(c) -> Column:
    """A string column as JSON, null included."""
    value = F.col(c) if isinstance(c, str) else c
    return F.when(value.isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.struct(value.cast("string").alias("x"))), r"(?s)^.{5}(.*).$", 1))


#: Sections of the metadata JSON in order, and of the text report (fixed values).
SECTIONS = ("pageRefs", "externalRefs", "mentionRefs", "attachmentRefs", "referencedFileIds", "pageTreeRefs", "excerptRefs", "excerpts", "outline")
REPORT = ("outline", *SECTIONS[:-1])


def _section_rows(nodes: DataFrame, docs: DataFrame, sections: tuple[str, ...], inventory: DataFrame | None, options: render.Options, field: str, dealt: bool) -> DataFrame:
    """doc_id, section (its place in SECTIONS), ord and ``field`` (json or line) of every entry of the sections asked for."""
    unknown = set(sections) - set(SECTIONS)
    if unknown:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    member = lambda **fields: F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]), F.lit("}"))
    parameters = F.coalesce(F.to_json("params"), F.lit("{}"))
    brackets = lambda a, b: F.concat(said(a), F.lit(" ["), said(b), F.lit("]"))
    depth = F.when(F.col("depth").isNotNull(), F.concat(F.lit('"depth":'), F.col("depth").cast("string")))
    tree_json = F.concat(F.lit("{"), F.concat_ws(",", F.concat(F.lit('"macro":'), json_value("macro")), F.concat(F.lit('"root":'), json_value("root")), depth, F.concat(F.lit('"all":'), F.col("all_levels").cast("string")), F.concat(F.lit('"parameters":'), parameters)), F.lit("}"))
    strip = lambda c: F.regexp_replace(F.col(c), r"^\s+|\s+$", "")
    make = {
        "pageRefs": (lambda: analyze.page_refs(nodes, dealt), json_value("page_node_id"), said("page_node_id")),
        "externalRefs": (lambda: analyze.external_refs(nodes, dealt), json_value("url"), said("url")),
        "mentionRefs": (lambda: analyze.mention_refs(nodes, dealt), member(id=json_value("mention_id"), text=json_value("text")), brackets("text", "mention_id")),
        "attachmentRefs": (lambda: analyze.attachment_refs(nodes, inventory, dealt), member(fileId=json_value("file_id"), title=json_value("title"), mediaType=json_value("media_type")), brackets("title", "file_id")),
        "referencedFileIds": (lambda: analyze.referenced_file_ids(nodes, inventory, dealt), json_value("file_id"), said("file_id")),
        "pageTreeRefs": (lambda: analyze.page_tree_refs(nodes), tree_json, F.concat("macro", F.lit(" root="), said("root"))),
        "excerptRefs": (lambda: analyze.excerpt_refs(nodes), member(page=json_value("page"), excerptName=json_value("name"), parameters=parameters), F.concat_ws("/", "page", "name")),
        "excerpts": (lambda: excerpt_bodies(docs, "doc_id", options), member(name=json_value("name"), markdown=json_value("markdown")), F.concat(F.coalesce("name", F.lit("(unnamed)")), F.lit(": "), strip("markdown"))),
        "outline": (
            lambda: analyze.outline(nodes), member(level=F.col("level").cast("string"), text=json_value("text"), anchor=json_value("anchor")),
            F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("H"), F.col("level"), F.lit(" "), said("text"), F.lit(" (#"), said("anchor"), F.lit(")")),
        ),
    }
    rows = None
    for name in (s for s in SECTIONS if s in sections):
        df, said_as = make[name][0](), make[name][1 if field == "json" else 2]
        one = df.select("doc_id", F.lit(SECTIONS.index(name)).alias("section"), F.col("ord").cast("int").alias("ord"), said_as.alias(field))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _by_section(nodes, docs, sections, inventory, options, field, dealt) -> tuple[DataFrame, Callable]:
    """docs' ids with their entries of all sections in one list, and the texts of a section's entries in order; one deal and one group for all sections."""
    rows = analyze.by_document(_section_rows(nodes, docs, sections, inventory, options, field, dealt))
    lists = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("section", "ord", field))).alias("entries"))
    entry = lambda name: F.coalesce(F.transform(F.filter("entries", lambda x: x["section"] == SECTIONS.index(name)), lambda x: x[field]), F.array().cast("array<string>"))
    return docs.select("doc_id").join(lists.hint("merge"), "doc_id", "left"), entry


def metadata(nodes: DataFrame, docs: DataFrame, sections: tuple[str, ...] = SECTIONS, inventory: DataFrame | None = None, options: render.Options = render.Options(), dealt: bool = False) -> DataFrame:
    """doc_id and the metadata as JSON; sections that aren't asked for aren't computed, the others are grouped in one shuffle.

    Each section reads the nodes, so persist or write them where several are
    asked for, dealt by document (``dealt``): then no section shuffles them again.
    """
    joined, entry = _by_section(nodes, docs, sections, inventory, options, "json", dealt)
    parts = [F.concat(F.lit(f'"{s}":['), F.array_join(entry(s), ","), F.lit("]")) for s in SECTIONS if s in sections]
    return joined.select("doc_id", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("json"))


def metadata_report(nodes: DataFrame, docs: DataFrame, sections: tuple[str, ...] = SECTIONS, inventory: DataFrame | None = None, options: render.Options = render.Options(), dealt: bool = False) -> DataFrame:
    """doc_id and the metadata as text: the outline's headings, then each list with its length."""
    joined, entry = _by_section(nodes, docs, sections, inventory, options, "line", dealt)
    parts = []
    for s in (s for s in REPORT if s in sections):
        shown = F.array_join(F.transform(entry(s), lambda x: F.concat(F.lit("  "), x, F.lit("\n"))), "")
        n = F.size(entry(s))
        head = F.lit("outline:\n") if s == "outline" else F.concat(F.lit(f"{s} ("), n.cast("string"), F.when(n == 0, F.lit("): none\n")).otherwise(F.lit("):\n")))
        parts.append(F.concat(head, shown))
    return joined.select("doc_id", F.concat(*parts).alias("report"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id and the validation report: valid, then each issue's severity, code and message."""
    from docspark.plans import tree

    checked = parse.validate(docs)
    message = F.create_map(*[F.lit(x) for kv in tree.ISSUES.items() for x in kv])
    line = lambda c: F.concat(F.lit("["), F.when(c == "UNSUPPORTED_VERSION", "WARNING").otherwise("ERROR"), F.lit("] "), c, F.lit(": "), message[c])
    return checked.select("doc_id", F.array_join(F.concat(F.array(F.concat(F.lit("valid: "), F.col("valid").cast("string"))), F.transform("codes", line)), "\n").alias("report"))
