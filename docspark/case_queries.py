"""Queries of single rendering rules: each row of ``part`` becomes one document of a given shape.

A case is a document and the Markdown that it must give, both with marks for
the row's key (§k) and size (§s), so the SQL states the whole expected text.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators import analyze, convert, parse
from docspark.plans import render, tree
from docspark.plans.session import spread
from docspark.sources import lookups

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NBSP = " "


def node(kind, *content, **attrs):
    return {"type": kind, **({"attrs": attrs} if attrs else {}), **({"content": list(content)} if content else {})}


def text(s, *marks):
    return {"type": "text", "text": s, **({"marks": [{"type": m} if isinstance(m, str) else m for m in marks]} if marks else {})}


def p(*content):
    return node("paragraph", *[text(c) if isinstance(c, str) else c for c in content])


def macro(key, block="extension", ext=tree.MACRO, body=(), **params):
    return node(block, *body, extensionType=ext, extensionKey=key, parameters={"macroParams": {k: {"value": v} for k, v in params.items()}})


def sql_text(s: str) -> str:
    """A SQL expression of a text with marks."""
    s = "'" + s.replace("'", "''") + "'"
    return f"replace(replace({s}, '§k', p_partkey::varchar), '§s', p_size::varchar)"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey")


def documents(spark: SparkSession, sf_dir: str, content: list, version=1) -> DataFrame:
    """doc_id and adf of each part; a mark that is a whole JSON string "§k!" becomes a number."""
    source = json.dumps({"type": "doc", "version": version, "content": content}, ensure_ascii=False, separators=(",", ":"))
    adf = F.lit(source)
    for mark, column in (('"§k!"', "p_partkey"), ('"§s!"', "p_size"), ("§k", "p_partkey"), ("§s", "p_size")):
        adf = F.replace(adf, F.lit(mark), F.col(column).cast("string"))
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), "p_size", adf.alias("adf"))


def case(name: str, content: list, want: str, options: render.Options = render.Options(), title: str | None = None, **hooks) -> None:
    def run(spark, sf_dir):
        docs = documents(spark, sf_dir, content)
        if title is not None:
            docs = docs.withColumn("document_title", F.concat(F.lit(title), F.col("doc_id")))
        return convert.convert(docs, options, convert.Hooks(**hooks)).select("doc_id", "body")

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = f"select p_partkey as doc_id, {sql_text(want)} as body from part"


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def link(href, **more):
    return {"type": "link", "attrs": {"href": href, **more}}


LEVEL = "greatest(1, least(6, p_size))"


@query(f"""select p_partkey as doc_id, '# T \\_' || p_partkey || '\n\n' || repeat('#', {LEVEL}) || ' Item ' || p_partkey || ' B' || '\n\n<a id="x ' || p_partkey || '"></a>\n## a' as body from part""")
def render_headings(spark, sf_dir):
    own = macro("anchor", "inlineExtension", **{"": "x §k"})
    content = [node("heading", node("hardBreak"), text("Item §k"), node("hardBreak"), text("B"), level="§s!"), node("heading", own, text("a"), level=2), node("heading", text(" "), level=3)]
    docs = documents(spark, sf_dir, content).withColumn("document_title", F.concat(F.lit(" T\n_"), F.col("doc_id")))
    return convert.convert(docs).select("doc_id", "body")


case("render_breaks", [p(text("a§k"), node("hardBreak"), text("- b")), p(text("x", "strong", "em"), text("§s", "em", "strong")), p(node("emoji", shortName=":e_§k:"), node("emoji", text="😀", shortName=":x:")), p("1. §k\n# §s")],
     "a§k  \n\\- b\n\n***x§s***\n\n:e_§k:😀\n\n1\\. §k\n\\# §s")
case("render_collapsed_breaks", [p(text("a§k"), node("hardBreak"), text("b (§s)"))], "a§k\nb \\(§s\\)", render.Options(collapse_breaks=True, escape_parentheses=True))
case(
    "render_indent_align", [{**p("a§k"), "marks": [{"type": "indentation", "attrs": {"level": 2}}]}, {**p("b"), "marks": [{"type": "alignment", "attrs": {"align": "end"}}]}, {**p("c§s"), "marks": [{"type": "alignment", "attrs": {"align": "center"}}]}],
    f'{NBSP * 8}a§k\n\n<div align="right">\n\nb\n\n</div>\n\n<div align="center">\n\nc§s\n\n</div>', render.Options(visual_marks=True),
)
case(
    "render_visual_marks", [p(text("a§k", {"type": "textColor", "attrs": {"color": 'r"§s'}}, {"type": "border", "attrs": {"size": 2, "color": "#f"}})), p(text("  a §k ", "strong"), text("c"), text("  ", "em"), text("d", "underline", "strike"))],
    '<span style="color:r&quot;§s; border:2px solid #f">a§k</span>\n\n  **a §k** c  <u>~~d~~</u>', render.Options(visual_marks=True),
)
case("render_sub_sup", [p(text("2", "underline", "strong", {"type": "subsup", "attrs": {"type": "SUP"}}), text("§k", {"type": "subsup", "attrs": {"type": "odd"}}))], "<u><sup>**2**</sup></u>§k")
case("render_links", [p(text("a§k", link("http://x.y/§s", title='q"r'))), p(text("c", "code", link("http://x.y/§k"))), p(text(" ", link("http://x_y/§k")))], '[a§k](http://x.y/§s "q\\"r")\n\n[`c`](http://x.y/§k)\n\n[http://x_y/§k](http://x_y/§k)')

ODD = [node("zap", p("x§k"), n="§s!"), p({"type": "zip", "attrs": {"q": "§k"}}, "y")]
case("render_unknown_placeholder", ODD, "\\[Unsupported: zap\\]\n\n\\[Unsupported inline: zip\\]y")
case("render_unknown_skip", ODD, "y", render.Options(unknown_nodes="SKIP"))
case(
    "render_unknown_raw", ODD, '```json\n{"type":"zap","attrs":{"n":§s},"content":[{"type":"paragraph","content":[{"type":"text","text":"x§k"}]}]}\n```\n\n`{"type":"zip","attrs":{"q":"§k"}}`y',
    render.Options(unknown_nodes="PRESERVE_RAW"),
)


@query("select p_partkey as doc_id, null::varchar as body, case when p_partkey % 2 = 0 then 'Unsupported ADF block node type: zap' || p_size else 'Unsupported ADF inline node type: zip' end as error from part")
def render_unknown_fail(spark, sf_dir):
    options = render.Options(unknown_nodes="FAIL")
    block, inline = documents(spark, sf_dir, [node("zap§s", p("x"))]), documents(spark, sf_dir, [p({"type": "zip"}, "y")])
    both = block.filter("doc_id % 2 = 0").unionByName(inline.filter("doc_id % 2 = 1"))
    return convert.convert(both, options).select("doc_id", "body", "error")


def li(*content):
    return node("listItem", *content)


case("render_nested_lists", [node("bulletList", li(p("a§k"), node("bulletList", li(p("b"), p("c§s")))), li(node("codeBlock", text("d§k"))), li(p(text("e"), node("hardBreak"), text("f§k"))))], "- a§k\n  - b\n\n    c§s\n-\n  ```\n  d§k\n  ```\n- e  \n  f§k")
case("render_ordered_nesting", [node("orderedList", li(p("a§k"), node("orderedList", li(p("b")))), li(p("c§s")), order=10), node("bulletList", li(p("a"), node("orderedList", li(p("b§k")), order=3)))], "10. a§k\n    1. b\n11. c§s\n\n- a\n\n  3. b§k")
case(
    "render_block_tasks", [node("taskList", node("taskItem", text("a§k"), state="done"), node("taskList", node("taskItem", state="TODO")), node("blockTaskItem", p("b§s"), p("c"), state="TODO"), node("blockTaskItem", node("rule"), state="DONE"))],
    "- [x] a§k\n  - [ ]\n- [ ] b§s\n\n  c\n- [x]\n  ---",
)


def cell(*content, kind="tableCell", **attrs):
    return node(kind, *content, **attrs)


def row(*cells):
    return node("tableRow", *cells)


ONE = [node("table", row(cell(p("x§k")), cell(p("yyy"))), row(cell(p("z"))))]
WIDE = "greatest(3, length('x' || p_partkey))"


def _grid(*rows: tuple[str, str]) -> str:
    line = lambda a, b: f"'| ' || rpad({a}, {WIDE}::int, ' ') || ' | ' || rpad({b}, 3, ' ') || ' |'"
    drawn = [line(a, b) for a, b in rows]
    drawn.insert(1, f"'| ' || repeat('-', {WIDE}::int) || ' | --- |'")
    return " || chr(10) || ".join(drawn)


@query(f"select p_partkey as doc_id, {_grid(("'x' || p_partkey", "'yyy'"), ("'z'", "''"))} as promoted, {_grid(("''", "''"), ("'x' || p_partkey", "'yyy'"), ("'z'", "''"))} as empty_header, '<table><tr><td>x' || p_partkey || '</td><td>yyy</td></tr><tr><td>z</td></tr></table>' as html from part")
def table_fallbacks(spark, sf_dir):
    """Each conversion keeps the document and the bodies before it, so nothing is joined."""
    made, kept = documents(spark, sf_dir, ONE), ("doc_id", "adf")
    for name, fallback in (("promoted", "GFM_PROMOTE_FIRST_ROW"), ("empty_header", "GFM_EMPTY_HEADER"), ("html", "HTML")):
        made, kept = convert.convert(made, render.Options(table_fallback=fallback), keep=kept).select(*kept, F.col("body").alias(name)), (*kept, name)
    return made.drop("adf")


HEAD = row(cell(p("h|"), kind="tableHeader"), cell(p("key"), kind="tableHeader"))


@query("""with p as (select *, greatest(3, length(p_partkey::varchar) + 1)::int a, greatest(3, length('b<br>- c' || p_size))::int b from part)
select p_partkey as doc_id, '| ' || rpad('h\\|', a, ' ') || ' | ' || rpad('key', b, ' ') || ' |' || chr(10) || '| ' || repeat('-', a) || ' | ' || repeat('-', b) || ' |' || chr(10)
 || '| ' || rpad('a' || p_partkey, a, ' ') || ' | ' || rpad('b<br>- c' || p_size, b, ' ') || ' |' || chr(10) || chr(10) || '| s' || p_partkey || ' | t |' as body from p""")
def render_table_cells(spark, sf_dir):
    table = node("table", HEAD, row(cell(p("a§k")), cell(p(text("b"), node("hardBreak"), text("- c§s")))))
    return convert.convert(documents(spark, sf_dir, [table, row(cell(p("s§k")), cell(p("t")))])).select("doc_id", "body")


RICH = row(cell(p(text("a§k", "strong"), node("hardBreak"), text("b_c", link("http://x/?a=§s&b=2"))), node("bulletList", li(p("i§k")), li(p("j"))), colspan=2))
case(
    "render_html_cells", [node("table", HEAD, RICH, isNumberColumnEnabled=True), node("table", row(cell(node("codeBlock", text("x<§k")))))],
    '<table><tr><th></th><th>h|</th><th>key</th></tr><tr><td>1</td><td colspan="2"><strong>a§k</strong><br><a href="http://x/?a=§s&amp;b=2">b_c</a><br><ul><li>i§k</li><li>j</li></ul></td></tr></table>\n\n<table><tr><td><pre><code>x&lt;§k\n</code></pre></td></tr></table>',
)
case(
    "render_media_groups",
    [node("mediaSingle", node("media", type="file", id="§k", collection="c", __fileName="a§s.PNG"), node("caption", text("# cap §k"))), node("mediaGroup", node("media", id="2", __fileMimeType="application/pdf", name="r§k.pdf"), node("media", url="http://x/y§s.pdf?z=1")),
     node("mediaSingle", node("media", type="file", id="9", __fileMimeType="image/png", alt="o [§k]!"))],
    "![a§s.PNG](media:c/§k)\n\n\\# cap §k\n\n[r§k.pdf](media:2)\n[y§s.pdf](http://x/y§s.pdf?z=1)\n\n![o \\[§k\\]!](media:9)",
)
case("render_inline_cards", [node("embedCard", data={"url": "http://c/§k", "name": "N_"}), p(node("inlineCard", url="/rel§s"), node("embedCard")), p(node("inlineCard", url="http://a.b/§k"), node("inlineCard"))],
     "[N\\_](http://c/§k)\n\n[/rel§s](/rel§s)\\[Inline card\\]\n\n<http://a.b/§k>\\[Inline card\\]")
case(
    "render_bodied_macros", [macro("m", "multiBodiedExtension", ext="t", body=[node("extensionFrame", p("a§k"))]), macro("w", "bodiedExtension", ext="t", body=[p("b§s")]), macro("excerpt", "bodiedExtension", body=[p("c§k")])],
    "\\[Extension: t/m\\]\n\na§k\n\n\\[Extension: t/w\\]\n\nb§s\n\nc§k",
)
case("render_charts", [macro("chart:default", title="T§k"), macro("chart:default"), macro("x", ext=tree.CHART), macro("chart", "bodiedExtension", body=[p("a§s")], title="T\nU§k")], "\\[Chart: T§k\\]\n\n\\[Chart\\]\n\n*Chart*\n\n*Chart: T U§k*\n\na§s")
case("render_embeds", [macro("iframe", src="http://x/§k"), macro("iframe"), p(macro("anchor", "inlineExtension", **{"": 'n"§s'}), "t"), macro("excerpt-include", **{"": "P§k", "name": "n"})], '[Embedded content](http://x/§k)\n\n\\[Embedded content\\]\n\n<a id="n&quot;§s"></a>t\n\n\\[Excerpt include: P§k / n\\]')


def _broken(asked):
    raise RuntimeError("a caller's own failure")


def _own(asked):
    return f"own {asked['params']['a']}!" if asked["key"] == "toc" and "a" in asked["params"] else None


case(
    "extension_order", [macro("toc", a="§k"), macro("k", ext="t", q="§s é"), macro("k", ext="u", q="§s"), macro("iframe", src="http://x/§k"), macro("zz", "bodiedExtension", ext="t", body=[p("in§k")])],
    "own §k!\n\n<http://e/§s%20%C3%A9/k>\n\n\\[Extension: u/k\\]\n\n[Embedded content](http://x/§k)\n\nzz§{no}\n\nin§k",
    extensions=(_broken, _own), extension_templates=(("t", "k", "<http://e/{q}/{key}>"), (None, "zz", "zz§{no}")),
)


def _page(page_id):
    return f"http://fn/{page_id}" if int(page_id) % 2 else " "


case(
    "url_templates", [p(text("x", link("/wiki/spaces/S/pages/§k/T")), text("y", link("http://z/"))), node("blockCard", url="/pages/§k"), node("mediaSingle", node("media", id="m §s", __fileName="a.png")), macro("viewpdf", name="n.pdf", fileId="f§k")],
    "[x](http://w/§k)[y](http://z/)\n\n[/pages/§k](http://w/§k)\n\n![a.png](http://m/m%20§s)\n\n[PDF: n.pdf](http://a/f§k)",
    page_template="http://w/{id}", media_template="http://m/{id}", attachment_template="http://a/{fileId}",
)


@query("""select p_partkey as doc_id, '[x](' || case when p_partkey % 2 = 1 then 'http://fn/' || p_partkey else '/pages/' || p_partkey end || ')' as body, case when p_partkey % 2 = 0 then p_partkey::varchar else '' end as unresolved from part""")
def page_function(spark, sf_dir):
    made = convert.convert(documents(spark, sf_dir, [p(text("x", link("/pages/§k")))]), hooks=convert.Hooks(page=_page))
    return made.select("doc_id", "body", F.array_join("unresolved.page_ids", ",").alias("unresolved"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's files: one with a link, one of the same title in other case, one without, and one without an id."""
    part = parts(spark, sf_dir)
    key = F.col("p_partkey").cast("string")
    entry = lambda i, file, title, kind, url: F.struct(F.lit(i).alias("ord"), file.alias("file_id"), title.alias("title"), F.lit(kind).cast("string").alias("media_type"), url.alias("download_url"))
    none = F.lit(None).cast("string")
    files = F.array(entry(0, F.concat(F.lit("A"), key), F.lit(" Doc.PDF "), None, F.concat(F.lit("http://d/"), key)), entry(1, F.lit("2"), F.lit("doc.pdf"), None, none), entry(2, F.concat(F.lit("b"), key), F.lit("pic.png"), "image/png", none), entry(3, F.lit(" "), F.lit("no id"), None, none))
    return part.select(F.col("p_partkey").alias("doc_id"), F.explode(files).alias("f")).select("doc_id", "f.*")


@query("""select p_partkey as doc_id, '- [ Doc.PDF ](http://d/' || p_partkey || ')' || chr(10) || '- [pic.png](attachment:b' || p_partkey || ')' || chr(10) || chr(10) || '[PDF: DOC.pdf](http://d/' || p_partkey || ')' || chr(10) || chr(10)
 || '![pic.png](media:b' || p_partkey || ')' || chr(10) || chr(10) || '[ Doc.PDF ](http://d/' || p_partkey || ')' as body from part""")
def render_attachments(spark, sf_dir):
    docs = documents(spark, sf_dir, [macro("attachments"), macro("viewpdf", name="DOC.pdf"), node("mediaSingle", node("media", id="b§k")), node("mediaSingle", node("media", id="a§k"))])
    return convert.convert(convert.with_lookups(docs, parse.nodes(docs, analyze.FIELDS), convert.Tables(attachments=inventory(spark, sf_dir)))).select("doc_id", "body")


FILES = [macro("attachments"), node("mediaSingle", node("media", id="m§s", __fileName="a.png")), macro("viewpdf", name="doc.pdf"), p({"type": "inlineExtension", "attrs": {"extensionType": tree.MACRO, "extensionKey": "inline-media-image", "parameters": {"macroParams": {}}}})]


@query("""with f as (select p_partkey doc_id, unnest(['A' || p_partkey, 'b' || p_partkey, 'm' || p_size]) file_id, unnest([0, 1, 2]) as ord, unnest(['Doc.PDF', 'pic.png', 'a.png']) title from part)
select doc_id, ord::int as ord, file_id, title from f""")
def attachment_expansion(spark, sf_dir):
    nodes = parse.nodes(documents(spark, sf_dir, FILES), *analyze.FILES)
    return analyze.attachment_refs(nodes, inventory(spark, sf_dir)).select("doc_id", "ord", "file_id", "title")


@query("""select p_partkey as doc_id, 'A' || p_partkey || ',b' || p_partkey || ',m' || p_size as ids from part""")
def referenced_file_ids(spark, sf_dir):
    found = analyze.referenced_file_ids(parse.nodes(documents(spark, sf_dir, FILES), *analyze.FILES), inventory(spark, sf_dir))
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "file_id"))).alias("a")).select("doc_id", F.array_join(F.col("a.file_id"), ",").alias("ids"))


RICH_DOCUMENT = [
    node("heading", text("Part  §k"), level=1), node("heading", text("a"), node("hardBreak"), text("B!"), level=2),
    node("heading", macro("anchor", "inlineExtension", legacyAnchorId="own§k"), text("c", "strong"), text(" d"), level=2),
    p(text("x", link("/wiki/spaces/S/pages/§k/T")), text("y", link("http://e/§s")), text("z", {"type": "link", "attrs": {"href": "http://in/", "__confluenceMetadata": {"contentId": "c77"}}})),
    p(node("mention", id="u§s", text="@U")), node("mediaSingle", node("media", id="m§s", __fileName="a.png")), node("mediaSingle", node("media", type="external", url="http://img/§k.png")),
    macro("pagetree", root="R§k"), macro("children", depth="2", all="true"), macro("excerpt-include", **{"": "P§s", "name": "n"}),
    macro("excerpt", "bodiedExtension", body=[p(text("E§k", "strong"))], name="e"),
]


@query("""select p_partkey as doc_id, 'Part  ' || p_partkey || '|1|part--' || p_partkey || ';a B!|2|a-b;c d|2|own' || p_partkey as heads from part""")
def heading_texts(spark, sf_dir):
    heads = analyze.outline(parse.nodes(documents(spark, sf_dir, RICH_DOCUMENT), *analyze.HEADINGS))
    line = F.concat_ws("|", "text", F.col("level").cast("string"), "anchor")
    return heads.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))).alias("a")).select("doc_id", F.array_join(F.col("a.line"), ";").alias("heads"))


@query("""select p_partkey as doc_id, unnest(['pagetree', 'children']) as macro, unnest(['R' || p_partkey, null]) as root, unnest([0, 2])::int as depth, unnest([false, true]) as all_levels from part""")
def page_tree_refs(spark, sf_dir):
    return analyze.page_tree_refs(parse.nodes(documents(spark, sf_dir, RICH_DOCUMENT), *analyze.PAGE_TREES)).select("doc_id", "macro", "root", F.coalesce("depth", F.lit(0)).alias("depth"), "all_levels")


@query("""select p_partkey as doc_id, p_partkey::varchar || ',c77' as pages, 'http://e/' || p_size || ',http://img/' || p_partkey || '.png' as urls from part""")
def page_and_external_refs(spark, sf_dir):
    """Both lists in one pass; documents without one of them drop out."""
    found = analyze.page_and_external_refs(parse.nodes(documents(spark, sf_dir, RICH_DOCUMENT), *analyze.LINKS))
    listed = lambda c: F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("ord", c)))).alias(c)
    both = found.groupBy("doc_id").agg(listed("page_node_id"), listed("url")).filter((F.size("page_node_id") > 0) & (F.size("url") > 0))
    return both.select("doc_id", F.array_join("page_node_id.page_node_id", ",").alias("pages"), F.array_join("url.url", ",").alias("urls"))


JSON_SECTIONS = sql_text(
    '{"pageRefs":["§k","c77"],"externalRefs":["http://e/§s","http://img/§k.png"],"mentionRefs":[{"id":"u§s","text":"@U"}],"attachmentRefs":[{"fileId":"m§s","title":"a.png","mediaType":"image/png"}],"referencedFileIds":["m§s"],'
    '"pageTreeRefs":[{"macro":"pagetree","root":"R§k","all":false,"parameters":{"root":"R§k"}},{"macro":"children","root":null,"depth":2,"all":true,"parameters":{"depth":"2","all":"true"}}],'
    '"excerptRefs":[{"page":"P§s","excerptName":"n","parameters":{"":"P§s","name":"n"}}],"excerpts":[{"name":"e","markdown":"**E§k**"}],'
    '"outline":[{"level":1,"text":"Part  §k","anchor":"part--§k"},{"level":2,"text":"a B!","anchor":"a-b"},{"level":2,"text":"c d","anchor":"own§k"}]}'
)


@query(f"select p_partkey as doc_id, {JSON_SECTIONS} as json from part")
def metadata_sections(spark, sf_dir):
    docs = documents(spark, sf_dir, RICH_DOCUMENT)
    return convert.metadata(analyze.by_document(parse.nodes(docs, *analyze.METADATA)).persist(), docs, dealt=True)


TEXT_SECTIONS = sql_text(
    "outline:\n  H1 Part  §k (#part--§k)\n    H2 a B! (#a-b)\n    H2 c d (#own§k)\npageRefs (2):\n  §k\n  c77\nexternalRefs (2):\n  http://e/§s\n  http://img/§k.png\nmentionRefs (1):\n  @U [u§s]\n"
    "attachmentRefs (1):\n  a.png [m§s]\nreferencedFileIds (1):\n  m§s\npageTreeRefs (2):\n  pagetree root=R§k\n  children root=null\nexcerptRefs (1):\n  P§s/n\nexcerpts (1):\n  e: **E§k**\n"
)


@query(f"select p_partkey as doc_id, {TEXT_SECTIONS} as report from part union all select -1 - p_partkey, 'pageRefs (0): none\n' from part")
def metadata_report(spark, sf_dir):
    docs, bare = documents(spark, sf_dir, RICH_DOCUMENT), documents(spark, sf_dir, [p("x")])
    empty = convert.metadata_report(parse.nodes(bare, *analyze.LINKS), bare, ("pageRefs",)).select((-1 - F.col("doc_id")).alias("doc_id"), "report")
    return convert.metadata_report(analyze.by_document(parse.nodes(docs, *analyze.METADATA)).persist(), docs, dealt=True).unionByName(empty)


WHOLE = sql_text(
    '{"body":"§k \\"q\\"\\n\\n\\\\[Extension: t/k\\\\]\\n\\n{{children}}\\n\\n\\\\[Excerpt include: P§s\\\\]","wasLossy":true,"diagnostics":[{"code":"UNSUPPORTED_MACRO","severity":"WARNING","message":"1 unsupported macro(s) rendered as placeholders; original content not represented: t/k."}],'
    '"metadata":{"pageRefs":["§k"]},"unresolved":{"pageIds":[],"pageTreeRefs":[{"macro":"children","root":null}],"excerptRefs":[{"page":"P§s","excerptName":null}]}}'
)


@query(f"select p_partkey as doc_id, {WHOLE} as json from part")
def whole_results(spark, sf_dir):
    docs = documents(spark, sf_dir, [p('§k "q"'), macro("k", ext="t"), macro("children"), macro("excerpt-include", **{"": "P§s"})])
    linked = documents(spark, sf_dir, [p(text("l", link("/pages/§k")))])
    return convert.to_json(convert.convert(docs), convert.metadata(parse.nodes(linked, *analyze.LINKS), linked, ("pageRefs",)))


@query("""select p_partkey as doc_id, '{"validAdfRoot":' || case when p_partkey % 2 = 0 then 'true,"issues":[{"code":"UNSUPPORTED_VERSION","severity":"WARNING","message":"ADF version must be 1."}]}' else 'false,"issues":[{"code":"INVALID_CONTENT","severity":"ERROR","message":"ADF root must contain array field ''content''."}]}' end as json from part""")
def parse_results(spark, sf_dir):
    good, bad = documents(spark, sf_dir, [p("x")], 2), documents(spark, sf_dir, [p("x")]).withColumn("adf", F.lit('{"type":"doc","version":1}'))
    return parse.parse_results(good.filter("doc_id % 2 = 0").unionByName(bad.filter("doc_id % 2 = 1")))


@query("""select p_partkey as doc_id, 'UNSUPPORTED_VERSION,UNKNOWN_NODE_PLACEHOLDER,UNKNOWN_MARK_DROPPED,UNSUPPORTED_MACRO' as codes, '2 unsupported macro(s) rendered as placeholders; original content not represented: t/b' || p_partkey || ', t/a.' as last from part""")
def diagnostics_order(spark, sf_dir):
    docs = documents(spark, sf_dir, [node("zap"), p(text("a", "glow")), macro("b§k", ext="t"), macro("a", ext="t"), macro("b§k", ext="t")], 2)
    return convert.convert(docs).select("doc_id", F.array_join(F.col("diagnostics.code"), ",").alias("codes"), F.element_at("diagnostics", -1)["message"].alias("last"))


@query("""select p_partkey as doc_id, case p_partkey % 2 when 0 then 'UNKNOWN_NODE_SKIPPED:WARNING:1 unsupported node(s) dropped from the output.' else 'UNKNOWN_NODE_PRESERVED:INFO:1 unsupported node(s) preserved as raw JSON.' end as note, p_partkey % 2 = 1 as passes from part""")
def policy_diagnostics(spark, sf_dir):
    docs = documents(spark, sf_dir, [node("zap", p("x§k"))])
    made = convert.convert(docs.filter("doc_id % 2 = 0"), render.Options(unknown_nodes="SKIP")).unionByName(convert.convert(docs.filter("doc_id % 2 = 1"), render.Options(unknown_nodes="PRESERVE_RAW")))
    passed = convert.gate(made, "warning").select("doc_id", F.lit(True).alias("passes"))
    first = F.element_at("diagnostics", 1)
    return made.join(passed.hint("merge"), "doc_id", "left").select("doc_id", F.concat_ws(":", first["code"], first["severity"], first["message"]).alias("note"), F.coalesce("passes", F.lit(False)).alias("passes"))


@query("""select p_partkey as doc_id, '{"panelType":"info","r":{"a":"' || p_partkey || '"}}' as attrs, '{"type":"zap","attrs":{"q":' || p_size || '}}' as raw from part""")
def raw_nodes(spark, sf_dir):
    """The attributes of a known node, and an unknown one's own JSON."""
    nodes = parse.nodes(documents(spark, sf_dir, [node("panel", p("x"), panelType="info", r={"a": "§k"}), node("zap", q="§s!")]))
    pick = lambda kind, c: F.max(F.when(F.col("type") == kind, F.col(c))).alias(c)
    return nodes.groupBy("doc_id").agg(pick("panel", "attrs"), pick("zap", "raw"))


# ---- sources


@query("""select p_partkey as doc_id, case p_partkey % 6 when 5 then null else p_partkey::varchar end as page_id, 'T ' || p_partkey as title, p_partkey % 6 < 3 as wiki from part""")
def page_context(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k, key = F.col("p_partkey") % 6, F.col("p_partkey").cast("string")
    put = lambda before, after="": F.concat(F.lit(before), key, F.lit(after))
    url = F.when(k == 0, put("https://a.atlassian.net/wiki/spaces/S/pages/", "/T")).when(k == 1, put("https://a.atlassian.net/wiki/x?pageId=")).when(k == 2, F.lit("https://a.atlassian.net/wiki/x")).otherwise("http://b.c/x")
    head = F.when(k == 2, put('<link href="https://a.atlassian.net/wiki/spaces/S/pages/', '" rel="canonical">')).when(k == 3, put("<meta property='og:url' content='https://a.atlassian.net/wiki/spaces/S/pages/", "/u'>")).when(k == 4, put('<META name="ajs-page-id" content="', '">')).otherwise("")
    title = F.when(k < 2, put("<title> T  ", "\n - Confluence</title>")).otherwise(put('<meta name="ajs-page-title" content="T  ', '"><title>no</title>'))
    html = F.concat(F.lit("<html><head>"), head, title, F.lit("</head></html>"))
    return part.select(F.col("p_partkey").alias("doc_id"), lookups.document_page_id(url, html).alias("page_id"), lookups.document_title(F.lit(None).cast("string"), html).alias("title"), lookups.is_wiki(url).alias("wiki"))


@query("""select p_partkey as doc_id, 'T' || p_partkey as document_title, case p_partkey % 3 when 2 then null else '{"v":' || p_size || '}' end as adf, case p_partkey % 3 when 2 then 'Confluence response did not include body.atlas_doc_format.value' end as error from part""")
def page_dumps(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey") % 3
    inner = F.when(k == 0, F.concat(F.lit('"{\\"v\\":'), F.col("p_size"), F.lit('}"'))).when(k == 1, F.concat(F.lit('{"value":"{\\"v\\":'), F.col("p_size"), F.lit('}"}'))).otherwise(F.lit("null"))
    response = F.concat(F.lit('{"title":" T'), F.col("p_partkey"), F.lit(' - Confluence","body":{"atlas_doc_format":'), inner, F.lit("}}"))
    return lookups.page_bodies(part.select(F.col("p_partkey").alias("doc_id"), response.alias("response")))


def attachment_responses(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey").cast("string")
    answer = F.concat(F.lit('{"results":[{"fileId":" f'), key, F.lit(' ","title":"a","mediaType":"x/y","downloadLink":"/d/'), key, F.lit('"},{"fileId":" ","title":"no"},{"fileId":"g","title":"b","downloadLink":"https://h/'), key, F.lit('"}],"_links":{'), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('"next":"/wiki/api/v2/x?cursor='), key, F.lit('"'))).otherwise(""), F.lit("}}"))
    return part.select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("ord"), answer.alias("response"))


@query("""select p_partkey as doc_id, unnest([0, 2])::int as ord, unnest(['f' || p_partkey, 'g']) as file_id, unnest(['https://s/wiki/d/' || p_partkey, 'https://h/' || p_partkey]) as download_url from part""")
def attachment_dumps(spark, sf_dir):
    return lookups.page_attachments(attachment_responses(spark, sf_dir), "https://s").select("doc_id", F.col("ord").cast("int").alias("ord"), "file_id", "download_url")


@query("""select p_partkey as doc_id, 1::int as ord, 'https://s/wiki/api/v2/x?cursor=' || p_partkey as url from part where p_partkey % 2 = 0""")
def attachment_paging(spark, sf_dir):
    return lookups.next_requests(attachment_responses(spark, sf_dir), "https://s")


@query("""select p_partkey as doc_id, 'https://s/wiki/api/v2/pages/' || p_partkey || '?body-format=atlas_doc_format' as page, 'https://s/wiki/api/v2/pages/' || p_partkey || '/attachments?limit=250' as files from part""")
def rest_requests(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"), lookups.page_request(F.lit("https://s"), key).alias("page"), lookups.attachments_request(F.lit("https://s"), key).alias("files"))


@query("""select p_partkey as doc_id, '- [F](http://d/' || p_partkey || ')' as body from part where p_partkey % 4 = 0""")
def messages(spark, sf_dir):
    """Messages whose sender, payload and context hold, converted with the inventory of their context."""
    docs = documents(spark, sf_dir, [macro("attachments")])
    k = F.col("doc_id") % 4
    context = F.concat(F.lit('{"attachments":[{"fileId":"1","title":"F","downloadUrl":"http://d/'), F.col("doc_id"), F.lit('"},{"title":"no id"}]'), F.when(k == 1, ',"more":1}').otherwise("}"))
    sent = docs.select("doc_id", F.when(k == 2, "other").otherwise("convert").alias("type"), F.when(k == 3, "https://evil.net/wiki/").otherwise("https://a.atlassian.net/wiki/x").alias("sender_url"), F.col("adf").alias("payload"), context.alias("context"))
    fit = lookups.valid_messages(sent)
    own = fit.select("doc_id", F.col("payload").alias("adf"))
    known = convert.with_lookups(own, parse.nodes(own, analyze.FIELDS), convert.Tables(attachments=lookups.context_inventory(fit)))
    return convert.convert(known).select("doc_id", "body")
