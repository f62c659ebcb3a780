"""Queries over the driver's tables, and SQL that DuckDB runs for the same rows.

The tables hold no documents of our format, so each query builds them from
rows by JSON expressions; the SQL states the expected result in closed form.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark import case_queries
from docspark.operators import analyze, convert, parse
from docspark.plans import render, tree
from docspark.plans.session import spread

MACRO = tree.MACRO


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str, **most: int) -> DataFrame:
    """A table of short rows, dealt to enough tasks to make and read a document for each."""
    return spread(table(spark, sf_dir, name), key, **most)


# ---- documents from rows


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def quote(c) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.struct(lit(c).cast("string").alias("x"))), r"(?s)^.{5}(.*).$", 1)


def attrs(**values) -> Column:
    return F.to_json(F.struct(*[lit(v).alias(k) for k, v in values.items()]))


def node(kind, content=None, attributes: Column | None = None) -> Column:
    """A node's JSON; content: columns of JSON, or one array column of JSON."""
    parts = [F.lit('{"type":'), quote(kind)]
    if attributes is not None:
        parts += [F.lit(',"attrs":'), attributes]
    if content is not None:
        parts += [F.lit(',"content":['), F.concat_ws(",", *content) if isinstance(content, (list, tuple)) else F.array_join(content, ","), F.lit("]")]
    return F.concat(*parts, F.lit("}"))


def text(c, *marks: str) -> Column:
    value = lit(c)
    return F.to_json(F.struct(F.lit("text").alias("type"), value.alias("text"), *([F.array(*[F.struct(F.lit(m).alias("type")) for m in marks]).alias("marks")] if marks else [])))


def paragraph(*inlines: Column) -> Column:
    return node("paragraph", list(inlines))


def doc(content, version="1") -> Column:
    inner = F.concat_ws(",", *content) if isinstance(content, (list, tuple)) else F.array_join(content, ",")
    return F.concat(F.lit(f'{{"type":"doc","version":{version},"content":['), inner, F.lit("]}"))


def macro(key, params: dict | None = None, kind: str = MACRO, block: str = "extension") -> Column:
    inner = F.to_json(F.create_map(*[x for k, v in (params or {}).items() for x in (F.lit(k), lit(v))])) if params else F.lit("{}")
    attributes = F.concat(F.lit('{"extensionType":'), quote(kind), F.lit(',"extensionKey":'), quote(key), F.lit(',"parameters":{"macroParams":'), inner, F.lit("}}"))
    return node(block, None, attributes)


def lines_of(c: Column) -> Column:
    """Paragraphs of a text's lines."""
    return F.transform(F.split(c, "\n"), lambda x: paragraph(text(x)))


def bodies(docs: DataFrame, options: render.Options = render.Options(), **hooks) -> DataFrame:
    return convert.convert(docs, options, convert.Hooks(**hooks))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


#: DuckDB's form of the inline escapes; underscores inside words lose their backslash again, in two passes as neighbours overlap.
def sql_escape(x: str) -> str:
    once = rf"regexp_replace({x}, '([\\`*\[\]~<&!_])', '\\\1', 'g')"
    for _ in range(2):
        once = rf"regexp_replace({once}, '([\p{{L}}\p{{Nd}}])\\_([\p{{L}}\p{{Nd}}])', '\1_\2', 'g')"
    return once


# ---- parse


SHAPES = """case doc_id % 8 when 1 then 'blank' when 2 then 'INVALID_JSON' when 3 then 'INVALID_ROOT_TYPE' when 4 then 'INVALID_ROOT_NODE'
 when 5 then 'INVALID_VERSION' when 6 then 'UNSUPPORTED_VERSION' when 7 then 'INVALID_CONTENT' else '' end"""


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = doc([paragraph(text(F.col("text")))])
    k = F.col("doc_id") % 8
    adf = (
        F.when(k == 1, " \n\t").when(k == 2, F.concat(ok, F.lit("}"))).when(k == 3, F.lit("[1]")).when(k == 4, F.replace(ok, F.lit('"type":"doc"'), F.lit('"type":"page"')))
        .when(k == 5, F.replace(ok, F.lit('"version":1,'), F.lit(""))).when(k == 6, F.replace(ok, F.lit('"version":1'), F.lit('"version":"2"'))).when(k == 7, F.lit('{"type":"doc","version":"1"}')).otherwise(ok)
    )
    return table(spark, sf_dir, "documents").select("doc_id", adf.alias("adf"))


@query(f"select doc_id, replace({SHAPES}, 'blank', '') as codes, doc_id % 8 in (0, 6) as valid from documents")
def validate_root(spark, sf_dir):
    return parse.validate(shaped(spark, sf_dir)).select("doc_id", F.array_join("codes", ",").alias("codes"), "valid")


@query(f"""select doc_id, case when doc_id % 8 = 1 then 'valid: false' when doc_id % 8 = 0 then 'valid: true' else
 case when doc_id % 8 = 6 then 'valid: true' || chr(10) || '[WARNING] ' else 'valid: false' || chr(10) || '[ERROR] ' end || {SHAPES} || ': ' ||
 case doc_id % 8 when 2 then 'Failed to parse ADF JSON payload.' when 3 then 'ADF root must be an object.' when 4 then 'ADF root node must have type ''doc''.'
 when 5 then 'ADF root must contain integer version.' when 6 then 'ADF version must be 1.' when 7 then 'ADF root must contain array field ''content''.' end end as report from documents""")
def validate_report(spark, sf_dir):
    return convert.report(shaped(spark, sf_dir))


def plain(spark, sf_dir):
    adf = doc(F.concat(F.array(node("heading", [text(F.col("source"))], attrs(level=2))), lines_of(F.col("text"))))
    return table(spark, sf_dir, "documents").select("doc_id", adf.alias("adf"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) x from documents)
select 'heading' as type, count(*)::bigint as n from documents union all select 'paragraph', count(*)::bigint from l union all select 'text', ((select count(*) from l) + count(*))::bigint from documents""")
def node_census(spark, sf_dir):
    return analyze.node_census(parse.nodes(plain(spark, sf_dir), ("doc_id", "type")))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) i from documents),
n as (select doc_id, 0 i, 'heading' type, 0 depth from documents union all select doc_id, 0, 'text', 1 from documents union all select doc_id, i, 'paragraph', 0 from l union all select doc_id, i, 'text', 1 from l)
select doc_id, depth, (row_number() over (partition by doc_id order by i, depth) - 1)::int as ord, type from n""")
def node_paths(spark, sf_dir):
    return parse.nodes(plain(spark, sf_dir), ("doc_id", "depth", "ord", "type"))


# ---- analysis


@query("""select conv_id as doc_id, (row_number() over (partition by conv_id order by turn) - 1)::int as ord, greatest(1, least(6, case role when 'user' then 0 when 'assistant' then 9 else 3 end))::int as level, trim(role) as text from conversations""")
def outline_levels(spark, sf_dir):
    level = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 9).otherwise(3)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", node("heading", [text(F.col("role"))], attrs(level=level)).alias("h"))
    docs = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "h"))).alias("a")).select("doc_id", doc(F.transform("a", lambda x: x["h"])).alias("adf"))
    return analyze.outline(parse.nodes(docs, analyze.FIELDS)).select("doc_id", "ord", "level", "text")


def brands(spark, sf_dir, extra: list[Column] = []):
    p = table(spark, sf_dir, "part").select(F.expr("cast(regexp_extract(p_brand, '[0-9]+', 0) as bigint)").alias("doc_id"), "p_partkey", node("heading", [text(F.col("p_name"))], attrs(level=F.col("p_size") % 6 + 1)).alias("h"))
    one = p.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "h"))).alias("a"))
    return one.select("doc_id", doc(F.concat(F.array(*extra) if extra else F.array().cast("array<string>"), F.transform("a", lambda x: x["h"]))).alias("adf"))


SLUGS = """p as (select regexp_extract(p_brand, '[0-9]+')::bigint doc_id, p_partkey, p_name, (p_size % 6 + 1)::int as level, regexp_replace(replace(lower(p_name), ' ', '-'), '[^\\p{L}\\p{N}_\\-]', '', 'g') base from part),
s as (select *, row_number() over (partition by doc_id, base order by p_partkey) n, (row_number() over (partition by doc_id order by p_partkey) - 1)::int ord from p),
o as (select doc_id, ord, level, p_name as text, base || case when n = 1 then '' else '-' || (n - 1) end as anchor from s)"""


@query(f"with {SLUGS} select doc_id, ord, level, text, anchor from o")
def heading_slugs(spark, sf_dir):
    return analyze.outline(parse.nodes(brands(spark, sf_dir), analyze.FIELDS)).select("doc_id", "ord", "level", "text", "anchor")


@query(f"""with {SLUGS}, m as (select doc_id, min(level) low from o where level between 2 and 4 group by doc_id)
select doc_id, string_agg(repeat('  ', level - low) || '- [' || {sql_escape("text")} || '](#' || anchor || ')', chr(10) order by ord) as toc from o join m using (doc_id) where level between 2 and 4 group by doc_id""")
def toc_render(spark, sf_dir):
    docs = brands(spark, sf_dir, [macro("toc", {"minLevel": "4", "maxLevel": "2"})])
    return bodies(docs).select("doc_id", F.split("body", "\n\n")[0].alias("toc")).filter("toc like '%- [%'")


def wiki(p: str) -> Column:
    n = F.col(p)
    return (
        F.when(n % 4 == 0, F.concat(F.lit("https://x.example.net/wiki/spaces/S/pages/"), n.cast("string"), F.lit("/Title?x=1")))
        .when(n % 4 == 1, F.concat(F.lit("/wiki/spaces/S/pages/edit-v2/"), (n - 1).cast("string"))).when(n % 4 == 2, F.concat(F.lit(" /pages/"), (n - 2).cast("string"), F.lit("#a "))).otherwise(F.col("url"))
    )


def linked(spark, sf_dir):
    marks = F.array(F.struct(F.lit("link").alias("type"), F.struct(wiki("page_id").alias("href")).alias("attrs")))
    link = lambda: F.to_json(F.struct(F.lit("text").alias("type"), F.lit("go").alias("text"), marks.alias("marks")))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), doc([paragraph(link()), node("blockCard", None, attrs(url=wiki("page_id"))), paragraph(link())]).alias("adf"))


@query("select page_id as doc_id, 0 as ord, (page_id - page_id % 4)::varchar as page_node_id from pages where page_id % 4 < 3")
def page_refs(spark, sf_dir):
    return analyze.page_refs(parse.nodes(linked(spark, sf_dir), analyze.FIELDS))


@query("select page_id as doc_id, 0 as ord, url from pages where page_id % 4 = 3")
def external_refs(spark, sf_dir):
    return analyze.external_refs(parse.nodes(linked(spark, sf_dir), analyze.FIELDS))


@query("select page_id as doc_id, 0 as ord, (page_id - page_id % 4)::varchar as page_node_id from pages where page_id % 4 < 3 and (page_id - page_id % 4) % 3 <> 0")
def unresolved_report(spark, sf_dir):
    known = table(spark, sf_dir, "pages").filter("page_id % 3 = 0").select(F.col("page_id").cast("string").alias("page_node_id"), "url")
    return analyze.broken_links(parse.nodes(linked(spark, sf_dir), analyze.FIELDS), known).select("doc_id", "ord", "page_node_id")


@query("""with e as (select page_id::varchar src, (page_id - page_id % 4)::varchar dst from pages where page_id % 4 < 3)
select coalesce(i.page, o.page) as page, coalesce(n_in, 0)::bigint as n_in, coalesce(n_out, 0)::bigint as n_out from (select dst page, count(*) n_in from e group by 1) i full join (select src page, count(*) n_out from e group by 1) o on i.page = o.page""")
def link_graph_degree(spark, sf_dir):
    return analyze.degrees(analyze.link_graph(parse.nodes(linked(spark, sf_dir), analyze.FIELDS)))


def talks(spark, sf_dir):
    person = node("mention", None, F.when(F.col("turn") % 3 == 0, attrs(id=F.col("role"))).otherwise(attrs(id=F.col("role"), text=F.concat(F.lit(" @"), F.col("role")))))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", paragraph(person).alias("p"))
    return c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "p"))).alias("a")).select("doc_id", doc(F.transform("a", lambda x: x["p"])).alias("adf"))


@query("""with m as (select conv_id doc_id, role mention_id, case when turn % 3 = 0 then '' else '@' || role end as text, min(turn) t from conversations group by 1, 2, 3)
select doc_id, mention_id, text, (row_number() over (partition by doc_id order by t) - 1)::int as ord from m""")
def mention_refs(spark, sf_dir):
    return analyze.mention_refs(parse.nodes(talks(spark, sf_dir), analyze.FIELDS))


@query("""select conv_id as doc_id, string_agg('@' || role, chr(10) || chr(10) order by turn) as body from conversations group by 1""")
def render_mentions(spark, sf_dir):
    return bodies(talks(spark, sf_dir)).select("doc_id", "body")


def orders_media(spark, sf_dir):
    name = F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("f"), F.col("l_linenumber"), F.lit(".pdf")))
    item = node("mediaSingle", [node("media", None, F.to_json(F.struct(F.lit("file").alias("type"), (F.col("l_suppkey") % 7).cast("string").alias("id"), name.alias("__fileName"))))])
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = dealt(spark, sf_dir, "lineitem", "l_orderkey", most=20_000).select("l_orderkey", *order, item.alias("m"))
    return li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct(*order, "m"))).alias("a")).select("doc_id", doc(F.transform("a", lambda x: x["m"])).alias("adf"))


@query("""with m as (select l_orderkey doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) n, (l_suppkey % 7)::varchar file_id,
 case when l_linenumber % 2 = 1 then 'f' || l_linenumber || '.pdf' end title from lineitem)
select doc_id, file_id, arg_max(title, n) filter (title is not null) as title, arg_max(case when title is not null then 'application/pdf' else 'file' end, n) as media_type,
 (row_number() over (partition by doc_id order by min(n)) - 1)::int as ord from m group by doc_id, file_id""")
def attachment_refs_upsert(spark, sf_dir):
    return analyze.attachment_refs(parse.nodes(orders_media(spark, sf_dir), *analyze.FILES))


@query("""select o_orderkey as doc_id, '[PDF: P' || o_custkey || '](' || case when p_partkey is not null then 'http://f/' || p_partkey else 'attachment:x' || o_orderkey end || ')' as body from orders left join part on p_partkey = o_custkey""")
def attachment_join(spark, sf_dir):
    o = dealt(spark, sf_dir, "orders", "o_orderkey")
    key = F.col("o_custkey").cast("bigint")
    docs = o.select(F.col("o_orderkey").alias("doc_id"), key.alias("k"), doc([macro("viewpdf", {"name": F.concat(F.lit("P"), key), "fileId": F.concat(F.lit("x"), F.col("o_orderkey"))})]).alias("adf"))
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit(" p"), F.col("p_partkey"), F.lit(" ")).alias("title"), F.concat(F.lit("http://f/"), F.col("p_partkey")).alias("download_url"))
    inventory = docs.join(files, "k").select("doc_id", F.lit(0).alias("ord"), F.col("k").cast("string").alias("file_id"), "title", F.lit(None).cast("string").alias("media_type"), "download_url")
    return bodies(convert.with_lookups(docs.drop("k"), parse.nodes(docs, analyze.FIELDS), convert.Tables(attachments=inventory))).select("doc_id", "body")


@query("""with e as (select r_regionkey root, n_nationkey ord, 1 depth, n_name title from nation join region on r_regionkey = n_regionkey
 union all select n_regionkey, n_nationkey, 2, s_name from supplier join nation on n_nationkey = s_nationkey)
select root::bigint as doc_id, string_agg(repeat('  ', depth - 1) || '- ' || replace(title, '#', '#'), chr(10) order by ord, depth, title) as body from e group by 1""")
def page_tree_expand(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    top = nation.select(F.col("n_regionkey").alias("root"), F.col("n_nationkey").alias("n"), F.lit(1).alias("depth"), F.col("n_name").alias("title"))
    below = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("root"), F.col("n_nationkey").alias("n"), F.lit(2).alias("depth"), F.col("s_name").alias("title"))
    entries = top.unionByName(below).select(F.lit("pagetree").alias("macro"), F.concat(F.lit("R"), F.col("root")).alias("root"), F.struct("n", "depth", "title").alias("ord"), "depth", "title", F.lit(None).cast("string").alias("page_node_id"))
    docs = nation.select("n_regionkey").distinct().select(F.col("n_regionkey").cast("bigint").alias("doc_id"), doc([macro("pagetree", {"root": F.concat(F.lit(" R"), F.col("n_regionkey"))})]).alias("adf"))
    return bodies(convert.with_lookups(docs, parse.nodes(docs, analyze.FIELDS), convert.Tables(page_trees=entries))).select("doc_id", "body")


@query("""select d.doc_id, case when d.doc_id % 2 = 0 then 'E ' || d.source else '\\[Excerpt include: D' || d.doc_id || ' / x\\]' end as body from (select distinct conv_id from conversations) c join documents d on d.doc_id = c.conv_id""")
def excerpt_resolve(spark, sf_dir):
    """Every even document defines an excerpt; each conversation includes that of the document of its number."""
    d = table(spark, sf_dir, "documents")
    body = node("bodiedExtension", [paragraph(text(F.concat(F.lit("E "), F.col("source"))))], F.concat(F.lit(f'{{"extensionType":"{MACRO}","extensionKey":"excerpt","parameters":{{"macroParams":{{"name":{{"value":"x"}}}}}}}}')))
    sources = d.select("doc_id", F.concat(F.lit("D"), F.col("doc_id")).alias("document_title"), F.when(F.col("doc_id") % 2 == 0, doc([body])).otherwise(doc([paragraph(text("none"))])).alias("adf"))
    asked = table(spark, sf_dir, "conversations").select("conv_id").distinct().join(d.select("doc_id"), F.col("conv_id") == F.col("doc_id"))
    docs = asked.select("doc_id", doc([macro("excerpt-include", {"": F.concat(F.lit("D"), F.col("doc_id")), "name": "x"})]).alias("adf"))
    return bodies(convert.with_lookups(docs, parse.nodes(docs, analyze.FIELDS), convert.Tables(excerpts=convert.corpus_excerpts(sources)))).select("doc_id", "body")


@query("""select doc_id, code, 'WARNING' as severity, k || case code when 'UNKNOWN_NODE_PLACEHOLDER' then ' unsupported node(s) rendered as placeholders; original content not represented.' else ' unsupported mark(s) dropped from the output.' end as message
from (select doc_id, 'UNKNOWN_NODE_PLACEHOLDER' code, doc_id % 3 k from documents where doc_id % 3 > 0 union all select doc_id, 'UNKNOWN_MARK_DROPPED', 1 from documents where doc_id % 5 = 0)""")
def lossiness(spark, sf_dir):
    odd = lambda i: F.when(F.col("doc_id") % 3 > i, node("gadget", [paragraph(text("x"))]))
    marked = F.when(F.col("doc_id") % 5 == 0, paragraph(text(F.col("source"), "strong", "sparkle"))).otherwise(paragraph(text(F.col("source"))))
    docs = table(spark, sf_dir, "documents").select("doc_id", doc([odd(0), marked, odd(1)]).alias("adf"))
    return analyze.lossiness(parse.nodes(docs, analyze.FIELDS)).select("doc_id", "code", "severity", "message")


@query("""with f as (select user_id doc_id, event_type k, min(event_id) e from events group by 1, 2)
select doc_id, count(*) || ' unsupported macro(s) rendered as placeholders; original content not represented: ' || string_agg('acme/' || k, ', ' order by e) || '.' as message from f group by 1""")
def unsupported_macros(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", macro(F.col("event_type"), kind="acme").alias("m"))
    docs = e.groupBy(F.col("user_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("event_id", "m"))).alias("a")).select("doc_id", doc(F.transform("a", lambda x: x["m"])).alias("adf"))
    return bodies(docs).select("doc_id", F.element_at("diagnostics", 1)["message"].alias("message"))


# ---- rendering


def hostile(spark, sf_dir):
    start = F.element_at(F.array(*[F.lit(x) for x in ("# ", "1. ", "12) ", "- ", "> ", "+", "    x", "_a_b_ [x](y) <b> & ! ~ `", " n")]), (F.col("doc_id") % 9 + 1).cast("int"))
    one = F.concat(start, F.regexp_replace("text", "\n+", " "))
    return table(spark, sf_dir, "documents").select("doc_id", doc([paragraph(text(one))]).alias("adf"))


START = "(case doc_id % 9 when 0 then '\\# ' when 1 then '1\\. ' when 2 then '12\\) ' when 3 then '\\- ' when 4 then '\\> ' when 5 then '\\+' when 6 then '&#32;   x' when 7 then '\\_a_b\\_ \\[x\\](y) \\<b> \\& \\! \\~ \\`' else chr(160) || 'n' end)"
#: An underscore at the seam of start and text needs both, so the text's own first sign is never one here.
PARAGRAPH = f"{START} || {sql_escape(chr(34) + 'flat' + chr(34))}"


@query(f"with d as (select doc_id, regexp_replace(text, chr(10) || '+', ' ', 'g') flat from documents) select doc_id, rtrim({PARAGRAPH}, ' ') as body from d")
def render_paragraphs(spark, sf_dir):
    return bodies(hostile(spark, sf_dir)).select("doc_id", "body")


@query("""select p_partkey as doc_id, case p_partkey % 5 when 0 then '**' || p_name || '**' when 1 then '~~***' || p_name || '***~~' when 2 then '<u><sup>' || p_name || '</sup></u>'
 when 3 then '`' || p_name || '`' else '[*' || p_name || '*](http://p/' || p_partkey || ' "' || p_brand || '")' end || ' ' || p_size as body from part""")
def render_marks(spark, sf_dir):
    k = F.col("p_partkey") % 5
    mark = lambda kind, **a: F.struct(F.lit(kind).alias("type"), F.to_json(F.struct(*[lit(v).alias(x) for x, v in a.items()])).alias("attrs") if a else F.lit(None).cast("string").alias("attrs"))
    marks = (
        F.when(k == 0, F.array(mark("strong"))).when(k == 1, F.array(mark("strike"), mark("em"), mark("strong"))).when(k == 2, F.array(mark("underline"), mark("subsup", type="sup")))
        .when(k == 3, F.array(mark("strong"), mark("code"))).otherwise(F.array(mark("link", href=F.concat(F.lit("http://p/"), F.col("p_partkey")), title=F.col("p_brand")), mark("em")))
    )
    shown = F.transform(marks, lambda m: F.concat(F.lit('{"type":"'), m["type"], F.lit('"'), F.coalesce(F.concat(F.lit(',"attrs":'), m["attrs"]), F.lit("")), F.lit("}")))
    inline = F.concat(F.lit('{"type":"text","text":'), quote(F.col("p_name")), F.lit(',"marks":['), F.array_join(shown, ","), F.lit("]}"))
    return bodies(dealt(spark, sf_dir, "part", "p_partkey").select(F.col("p_partkey").alias("doc_id"), doc([paragraph(inline, text(F.concat(F.lit(" "), F.col("p_size"))))]).alias("adf"))).select("doc_id", "body")


def nations(spark, sf_dir, make: Callable[[Column], Column]) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    one = n.groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("a"))
    return one.select(F.col("r_regionkey").cast("bigint").alias("doc_id"), doc([make(F.col("a"))]).alias("adf"))


@query("""with n as (select *, row_number() over (partition by n_regionkey order by n_nationkey) k from nation)
select n_regionkey::bigint as doc_id, '- ' || r_name || chr(10) || chr(10) || string_agg('  ' || (k + 8) || '. ' || n_name, chr(10) order by k) as body from n join region on r_regionkey = n_regionkey group by n_regionkey, r_name""")
def render_lists(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    one = n.groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("a"))
    inner = node("orderedList", F.transform("a", lambda x: node("listItem", [paragraph(text(x["n_name"]))])), attrs(order=9))
    outer = node("bulletList", [node("listItem", [paragraph(text(F.col("r_name"))), inner])])
    return bodies(one.select(F.col("r_regionkey").cast("bigint").alias("doc_id"), doc([outer]).alias("adf"))).select("doc_id", "body")


@query("""select o_orderkey as doc_id, '- [' || case when o_orderstatus = 'F' then 'x' else ' ' end || '] ' || o_orderpriority || chr(10) || '  - [ ] ' || o_custkey as body from orders""")
def render_tasks(spark, sf_dir):
    item = lambda state, t: node("taskItem", [text(t)], attrs(state=state))
    tasks = node("taskList", [item(F.when(F.col("o_orderstatus") == "F", "done").otherwise("TODO"), F.col("o_orderpriority")), node("taskList", [item("TODO", F.col("o_custkey").cast("string"))])])
    return bodies(dealt(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), doc([tasks]).alias("adf"))).select("doc_id", "body")


@query("""select o_orderkey as doc_id, '- \\[decision' || case when o_orderstatus = 'O' then '' else ':' || o_orderstatus end || '\\] ' || o_orderpriority as body from orders""")
def render_decisions(spark, sf_dir):
    item = node("decisionItem", [text(F.col("o_orderpriority"))], F.to_json(F.struct(F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("state"))))
    return bodies(dealt(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), doc([node("decisionList", [item])]).alias("adf"))).select("doc_id", "body")


def cell(t: Column, kind: str = "tableCell") -> Column:
    return node(kind, [paragraph(text(t))])


@query("""with w as (select n_regionkey r, greatest(3, max(length(n_name)), 4)::int a from nation group by 1)
select r::bigint as doc_id, '| ' || rpad('name', a, ' ') || ' | key |' || chr(10) || '| ' || repeat('-', a) || ' | --- |' || chr(10) || string_agg('| ' || rpad(n_name, a, ' ') || ' | ' || rpad(n_nationkey::varchar, 3, ' ') || ' |', chr(10) order by n_nationkey) as body
from nation join w on r = n_regionkey group by r, a""")
def render_gfm_table(spark, sf_dir):
    head = node("tableRow", [cell(F.lit("name"), "tableHeader"), cell(F.lit("key"), "tableHeader")])
    make = lambda a: node("table", F.concat(F.array(head), F.transform(a, lambda x: node("tableRow", [cell(x["n_name"]), cell(x["n_nationkey"].cast("string"))]))))
    return bodies(nations(spark, sf_dir, make)).select("doc_id", "body")


@query("""with n as (select *, row_number() over (partition by n_regionkey order by n_nationkey) k from nation)
select n_regionkey::bigint as doc_id, '<table><tr><th></th><th>name</th></tr>' || string_agg('<tr><td>' || k || '</td><td>' || n_name || '</td></tr>', '' order by k) || '</table>' as body from n group by 1""")
def render_html_table(spark, sf_dir):
    head = node("tableRow", [cell(F.lit("name"), "tableHeader")])
    make = lambda a: node("table", F.concat(F.array(head), F.transform(a, lambda x: node("tableRow", [cell(x["n_name"])]))), attrs(isNumberColumnEnabled=True))
    return bodies(nations(spark, sf_dir, make)).select("doc_id", "body")


@query("""select event_id as doc_id, '> [!' || case event_id % 5 when 0 then 'NOTE' when 1 then 'TIP' when 2 then 'WARNING' when 3 then 'CAUTION' else 'TIP' end || ']' || chr(10) || '> ' || event_type || chr(10) || '>' || chr(10) || '> v' || event_id as body from events""")
def render_panel_quote(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("info", "tip", "WARNING", "error", "success")]), (F.col("event_id") % 5 + 1).cast("int"))
    panel = node("panel", [paragraph(text(F.col("event_type"))), paragraph(text(F.concat(F.lit("v"), F.col("event_id"))))], attrs(panelType=kind))
    return bodies(dealt(spark, sf_dir, "events", "event_id").select(F.col("event_id").alias("doc_id"), doc([panel]).alias("adf"))).select("doc_id", "body")


@query("""with d as (select doc_id, coalesce(text, '') || repeat('`', (doc_id % 6)::int) || ' ' || lang t from documents),
f as (select *, repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda x: length(x))), 0) + 1)::int) ticks from d)
select doc_id, ticks || 'sql' || chr(10) || t || chr(10) || ticks as body from f""")
def render_code(spark, sf_dir):
    """Whole texts as code, with runs of ticks that the fence must exceed."""
    body = F.concat(F.coalesce("text", F.lit("")), F.repeat(F.lit("`"), (F.col("doc_id") % 6).cast("int")), F.lit(" "), F.col("lang"))
    return bodies(table(spark, sf_dir, "documents").select("doc_id", doc([node("codeBlock", [text(body)], attrs(language=" s`ql "))]).alias("adf"))).select("doc_id", "body")


@query("""select page_id as doc_id, case page_id % 3 when 0 then '<' || url || '>' when 1 then '[P' || page_id || '](' || url || ')' else '\\[Card: ' || page_id || '\\]' end as body from pages""")
def render_cards(spark, sf_dir):
    k = F.col("page_id") % 3
    a = F.when(k == 0, attrs(url=F.col("url"))).when(k == 1, F.to_json(F.struct(F.struct(F.col("url"), F.concat(F.lit("P"), F.col("page_id")).alias("name")).alias("data")))).otherwise(attrs(localId=F.col("page_id").cast("string")))
    return bodies(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), doc([node("blockCard", None, a)]).alias("adf"))).select("doc_id", "body")


EXTENSIONS = ("png", "pdf", "JPG", "zip", "svg", "csv")


@query("""with p as (select *, ['png', 'pdf', 'JPG', 'zip', 'svg', 'csv'][(p_partkey % 6)::int + 1] e from part)
select p_partkey as doc_id, case when p_partkey % 6 in (0, 2, 4) then '!' else '' end || '[f' || p_partkey || '.' || e || '](media:c/' || p_partkey || ')' || case when p_partkey % 6 in (0, 2, 4) then '{width=' || p_size || '}' else '' end as body from p""")
def render_media(spark, sf_dir):
    e = F.element_at(F.array(*[F.lit(x) for x in EXTENSIONS]), (F.col("p_partkey") % 6 + 1).cast("int"))
    m = node("media", None, F.to_json(F.struct(F.lit("file").alias("type"), F.col("p_partkey").cast("string").alias("id"), F.lit("c").alias("collection"), F.col("p_size").alias("width"), F.concat(F.lit("f"), F.col("p_partkey"), F.lit("."), e).alias("__fileName"))))
    docs = dealt(spark, sf_dir, "part", "p_partkey").select(F.col("p_partkey").alias("doc_id"), doc([node("mediaSingle", [m])]).alias("adf"))
    return bodies(docs, render.Options(image_sizes=True)).select("doc_id", "body")


@query("""select event_id as doc_id, strftime(ts, '%Y-%m-%d') as body from events""")
def render_dates(spark, sf_dir):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    stamp = F.when(F.col("event_id") % 2 == 0, seconds).otherwise(F.unix_millis(F.col("ts").cast("timestamp"))).cast("string")
    return bodies(dealt(spark, sf_dir, "events", "event_id").select(F.col("event_id").alias("doc_id"), doc([paragraph(node("date", None, attrs(timestamp=stamp)))]).alias("adf"))).select("doc_id", "body")


@query("""select page_id as doc_id, '[go](' || case page_id % 5 when 0 then url when 1 then 'javascript%3Aalert(' || page_id || ')' when 2 then '<' || url || ' x>' when 3 then 'mailto:a@b.c' else url || '%3C' end || ')' as body from pages""")
def url_sanitize(spark, sf_dir):
    k = F.col("page_id") % 5
    url = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("java\tscript:alert("), F.col("page_id"), F.lit(")"))).when(k == 2, F.concat(F.col("url"), F.lit(" x"))).when(k == 3, F.lit("mailto:a@b.c")).otherwise(F.concat(F.col("url"), F.lit("<")))
    link = F.to_json(F.struct(F.lit("text").alias("type"), F.lit("go").alias("text"), F.array(F.struct(F.lit("link").alias("type"), F.struct(url.alias("href")).alias("attrs"))).alias("marks")))
    return bodies(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), doc([paragraph(link)]).alias("adf"))).select("doc_id", "body")


@query("""select p_partkey, ['image/png', 'application/pdf', 'image/jpeg', 'application/zip', 'image/svg+xml', 'text/csv'][(p_partkey % 6)::int + 1] as media_type from part""")
def media_type_infer(spark, sf_dir):
    e = F.element_at(F.array(*[F.lit(x) for x in EXTENSIONS]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", analyze.media_type(F.concat(F.lit("http://x/a.b/"), F.col("p_name"), F.lit("."), e, F.lit("?v=1.2#z"))).alias("media_type"))


@query("""select o_orderkey as doc_id, '\\[' || case when o_orderstatus = 'P' then 'status' else o_orderstatus end || '\\] ' || o_orderpriority || chr(10) || chr(10) || '\\[Sync block: ' || o_custkey || '\\]' as body from orders""")
def sync_status_placeholder(spark, sf_dir):
    status = node("status", None, F.to_json(F.struct(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("text"))))
    p = paragraph(status, text(" "), node("placeholder", None, attrs(text=F.col("o_orderpriority"))))
    return bodies(dealt(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), doc([p, node("syncBlock", None, attrs(resourceId=F.col("o_custkey").cast("string")))]).alias("adf"))).select("doc_id", "body")


@query("""select o_orderkey as doc_id, '<details><summary>' || o_orderpriority || ' &lt;b&gt;</summary>' || chr(10) || chr(10) || 'in' || chr(10) || chr(10) || '</details>' || chr(10) || chr(10) || '---' as body from orders""")
def render_expand(spark, sf_dir):
    e = node("expand", [paragraph(text("in"))], attrs(title=F.concat(F.col("o_orderpriority"), F.lit(" <b>"))))
    return bodies(dealt(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), doc([node("layoutSection", [node("layoutColumn", [e])]), node("rule")]).alias("adf"))).select("doc_id", "body")


@query("""select doc_id, true as ok, doc_id % 8 not in (0, 1) as lossy, (doc_id % 8 = 6)::int as warnings, (doc_id % 8 in (2, 3, 4, 5, 7))::int as errors from documents""")
def bridge_counts(spark, sf_dir):
    from docspark.sources import lookups

    return lookups.bridge(convert.convert(shaped(spark, sf_dir))).select("doc_id", "ok", "lossy", "warnings", "errors")


@query("""select doc_id from documents where doc_id % 8 in (0, 1)""")
def gate_lossy(spark, sf_dir):
    return convert.gate(convert.convert(shaped(spark, sf_dir)), "lossy").select("doc_id")


@query(SQL["render_paragraphs"])
def stream_convert(spark, sf_dir):
    """The same rows as render_paragraphs, through a file stream that ends with its input."""
    from docspark.streaming import convert as stream

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp()
    place = f"{base.rstrip('/')}/docspark-stream-{uuid.uuid4().hex}"
    hostile(spark, sf_dir).write.mode("overwrite").parquet(f"{place}/in")
    stream.write(stream.converted(stream.read(spark, f"{place}/in")), f"{place}/out", f"{place}/state").awaitTermination()
    return spark.read.parquet(f"{place}/out").select("doc_id", "body")


QUERIES |= case_queries.QUERIES
SQL |= case_queries.SQL
