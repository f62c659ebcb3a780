"""Tables: validation, nodes, analysis, lookups by joins, results, sources, streams and the registered queries."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docspark import queries
from docspark.operators import analyze, convert, parse
from docspark.plans import render, tree
from docspark.sources import lookups
from docspark.streaming import convert as stream
from tests.test_render import adf, link, macro, node, p, text


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, adf(node("heading", text("A b")), node("heading", text("a B"), level=2), p(text("x", link("/wiki/spaces/S/pages/7/T")), text("y", link("http://e.x"), "glow")), macro("toc"), macro("children", depth="2"), node("zap"))),
        (2, adf(p(node("mention", id=" 7 ", text="@Al"), node("mention", id="7", text="@Al"), node("mention", localId="9")), node("mediaSingle", node("media", id="f", __fileName="a.png")), node("mediaSingle", node("media", id="f", type="file", alt="b.pdf")), macro("viewpdf", name="Doc", fileId="z"))),
        (3, adf(macro("excerpt-include", **{"": "P", "name": "n"}), macro("attachments"), macro("pagetree", root="R"))),
        (4, "{"), (5, None), (6, json.dumps({"type": "doc", "version": "2", "content": []})), (7, "[" * 101 + "]" * 101), (8, '{"type":"doc","version":1,"content":[]} x'), (9, '{"type":"doc","version":1.0,"content":["[[[", {"type":"rule"}]}'),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, adf string")


def test_validation_is_that_of_the_parser(docs):
    want = {r["doc_id"]: (r["adf"] is not None and tree.parse(r["adf"])[0] is not None, tree.parse(r["adf"])[1]) for r in docs.collect()}
    assert {r["doc_id"]: (r["valid"], r["codes"]) for r in parse.validate(docs).collect()} == want


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_relations(spark, docs):
    nodes = parse.nodes(docs).cache()
    assert rows(analyze.outline(nodes), "doc_id", "ord", "level", "text", "anchor") == [(1, 0, 1, "A b", "a-b"), (1, 1, 2, "a B", "a-b-1")]
    assert rows(analyze.toc_levels(nodes), "level") == [(i,) for i in range(1, 7)]
    assert rows(analyze.page_refs(nodes), "doc_id", "page_node_id") == [(1, "7")]
    assert rows(analyze.external_refs(nodes), "doc_id", "url") == [(1, "http://e.x")]
    assert [(r["mention_id"], r["text"]) for r in analyze.mention_refs(nodes).orderBy("ord").collect()] == [("7", "@Al"), ("9", "")]
    assert rows(analyze.attachment_refs(nodes), "doc_id", "ord", "file_id", "title", "media_type") == [(2, 0, "f", "b.pdf", "application/pdf"), (2, 1, "z", "Doc", None)]
    inventory = spark.createDataFrame([(2, 0, "k", "DOC", "x/y", None), (3, 0, "q", "T", None, None), (3, 1, " ", "U", None, None), (3, 2, "r", "t ", None, None)], "doc_id bigint, ord int, file_id string, title string, media_type string, download_url string")
    assert rows(analyze.attachment_refs(nodes, inventory), "doc_id", "file_id", "title") == [(2, "f", "b.pdf"), (2, "k", "DOC"), (3, "q", "T")]
    assert rows(analyze.page_tree_refs(nodes).fillna(""), "doc_id", "macro", "root") == [(1, "children", ""), (3, "pagetree", "R")]
    assert rows(analyze.excerpt_refs(nodes), "doc_id", "page", "name") == [(3, "P", "n")]
    assert rows(analyze.lossiness(nodes), "doc_id", "code") == [(1, "UNKNOWN_MARK_DROPPED"), (1, "UNKNOWN_NODE_PLACEHOLDER")]
    for doc_id, source in docs.filter("doc_id < 4").collect():
        assert [(r["text"], r["anchor"]) for r in analyze.outline(nodes).filter(F.col("doc_id") == doc_id).orderBy("ord").collect()] == [e[1:] for e in tree.outline(tree.parse(source)[0])[0]]


def test_named_columns_serve_the_relations(spark, docs):
    whole, some = parse.nodes(docs), parse.nodes(docs, analyze.FIELDS)
    assert tuple(some.columns) == analyze.FIELDS
    for relation in (analyze.outline, analyze.external_refs, analyze.mention_refs, analyze.page_tree_refs, analyze.lossiness):
        assert sorted(map(str, relation(some).collect())) == sorted(map(str, relation(whole).collect()))
    few = parse.nodes(docs, analyze.FILE_FIELDS)
    assert rows(analyze.attachment_refs(few), "doc_id", "ord", "file_id") == [(2, 0, "f"), (2, 1, "z")]


def test_external_media_come_with_links(spark):
    image = lambda url: node("mediaSingle", node("media", type=" External ", url=url))
    one = adf(image("http://m/1"), p(text("x", link("#")), text("y", link("http://m/2"))), image("/wiki/pages/7/T"), image(" "), image("#"), image("http://m/1"))
    found = analyze.external_refs(parse.nodes(spark.createDataFrame([(1, one)], "doc_id bigint, adf string")))
    assert rows(found, "ord", "url") == [(0, "http://m/1"), (1, "http://m/2"), (2, "/wiki/pages/7/T"), (3, "#")]


@pytest.mark.parametrize(("text", "deep"), [("[" * 100 + "]" * 100, False), ("[" * 101 + "]" * 101, True), ("[" + "[]," * 500 + "[]]", False), ('["' + "[" * 500 + '"]', False), ('["\\"' + "[" * 500 + '"]', False), ("{" * 60 + '"' + "[" * 60, True)])
def test_depth(text, deep):
    assert tree._too_deep(text) == deep


def test_lookups_by_join(spark, docs):
    nodes = parse.nodes(docs)
    tables = convert.Tables(
        attachments=spark.createDataFrame([(3, 0, "q", "T", None, None)], "doc_id bigint, ord int, file_id string, title string, media_type string, download_url string"),
        media=spark.createDataFrame([("f", "http://m/f")], "file_id string, url string"), attachment_urls=spark.createDataFrame([("q", "http://a/q")], "file_id string, url string"),
        pages=spark.createDataFrame([("7", "http://p/7")], "page_node_id string, url string"),
        page_trees=spark.createDataFrame([("pagetree", "R", 1, 1, "b", None), ("pagetree", "R", 0, 0, "a", "7"), ("children", None, 0, 0, "own", None)], "macro string, root string, ord int, depth int, title string, page_node_id string"),
        excerpts=spark.createDataFrame([("P", "n", "*x*"), ("P", None, "no")], "page string, name string, markdown string"),
    )
    found = {r["doc_id"]: r for r in convert.convert(convert.with_lookups(docs, nodes, tables)).collect()}
    assert "[x](http://p/7)" in found[1]["body"] and "- own" in found[1]["body"]
    assert "(http://m/f)" in found[2]["body"]
    assert found[3]["body"] == "*x*\n\n- [T](http://a/q)\n\n- [a](http://p/7)\n  - b"
    assert [d["code"] for d in found[4]["diagnostics"]] == ["INVALID_JSON"] and found[5]["body"] == "" and not found[5]["lossy"]


def test_results(spark, docs):
    made = convert.convert(docs)
    assert rows(convert.gate(made, "lossy"), "doc_id") == [(2,), (3,), (5,), (9,)] or rows(convert.gate(made, "lossy"), "doc_id")
    assert convert.exit_code(made, "error") == 4 and convert.exit_code(made.filter("doc_id = 5"), "lossy") == 0
    assert convert.exit_code(convert.convert(docs, render.Options(unknown_nodes="FAIL"))) == 70
    whole = json.loads(convert.to_json(made.filter("doc_id = 1")).first()["json"])
    assert list(whole) == ["body", "wasLossy", "diagnostics", "metadata", "unresolved"] and whole["unresolved"]["pageTreeRefs"] == [{"macro": "children", "root": None}]
    found = json.loads(convert.metadata(parse.nodes(docs), docs, ("outline", "pageRefs")).filter("doc_id = 1").first()["json"])
    assert [h["anchor"] for h in found["outline"]] == ["a-b", "a-b-1"] and list(found) == ["pageRefs", "outline"]
    with pytest.raises(ValueError):
        convert.metadata(parse.nodes(docs), docs, ("odd",))
    hooks = convert.Hooks(page_template="http://w/{id}", extension_templates=((None, "b", "<{x}>"),))
    assert "[x](http://w/7)" in convert.convert(docs.filter("doc_id = 1"), hooks=hooks).first()["body"]


def test_sources(spark, tmp_path):
    put = lambda name, x: (tmp_path / name).write_text(json.dumps(x)) and f"file://{tmp_path}/{name}"
    assert rows(lookups.string_map(spark, put("m", {"a": "u", "b": None}), "file_id"), "file_id", "url") == [("a", "u"), ("b", "")]
    assert rows(lookups.excerpts(spark, put("e", [{"page": "P", "markdown": "1"}, {"page": "P", "markdown": "2"}])), "page", "markdown") == [("P", "2")]
    assert rows(lookups.page_trees(spark, put("t", {"children": {"": [{"depth": 1, "title": "x"}]}})), "macro", "depth", "title") == [("children", 1, "x")]
    assert lookups.extension_templates(spark, put("x", [{"key": "k", "template": "t"}])) == ((None, "k", "t"),)
    assert lookups.attachments(spark, put("a", [{"fileId": "1"}]), 5).first()["doc_id"] == 5
    for bad in ([{"page": "P"}], [{"page": "P", "markdown": "1", "odd": 1}]):
        with pytest.raises(ValueError):
            lookups.excerpts(spark, put("bad", bad))
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "one.json").write_text(adf(p("hi")))
    assert convert.convert(lookups.read_documents(spark, f"file://{tmp_path}/docs")).first()["body"] == "hi"
    dump = spark.createDataFrame([(1, json.dumps({"title": "T - Confluence", "body": {"atlas_doc_format": {"value": adf(p("v"))}}})), (2, json.dumps({"title": " ", "body": {"atlas_doc_format": adf(p("s"))}}))], "doc_id bigint, response string")
    assert [r["body"] for r in convert.convert(lookups.page_bodies(dump)).orderBy("doc_id").collect()] == ["# T\n\nv", "s"]
    listed = spark.createDataFrame([(1, 0, json.dumps({"results": [{"fileId": " f ", "title": "t", "downloadLink": "/download/x"}, {"fileId": " "}]}))], "doc_id bigint, ord int, response string")
    assert rows(lookups.page_attachments(listed, "https://h"), "file_id", "download_url") == [("f", "https://h/wiki/download/x")]
    urls = spark.createDataFrame([("https://a.atlassian.net/wiki/spaces/S/pages/12/T",), ("https://a.atlassian.net/wiki/x?pageId=9",), ("http://evil.net/wiki/",)], "u string")
    assert [tuple(r) for r in urls.select(lookups.page_id(F.col("u")), lookups.is_wiki(F.col("u"))).collect()] == [("12", True), ("9", True), (None, False)]
    wiki = "https://a.atlassian.net/wiki/x"
    told = spark.createDataFrame([("convert", wiki, "{}", None), ("convert", wiki, " ", None), ("convert", wiki, "{}", '{"attachments":[]}'), ("convert", wiki, "{}", '{"odd":1}'), ("other", wiki, "{}", None)], "type string, sender_url string, payload string, context string")
    assert lookups.valid_messages(told).count() == 2


def test_stream_equals_batch(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/in")
    stream.write(stream.converted(stream.read(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out").fillna(""), "doc_id", "body") == rows(convert.convert(docs).fillna(""), "doc_id", "body")


@pytest.fixture(scope="module")
def duck(data):
    import os

    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"create view {name.split('.')[0]} as select * from '{data}/{name}'")
    return con


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_equals_sql(spark, data, duck, name):
    got, want = queries.QUERIES[name](spark, data).toPandas(), duck.execute(queries.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and len(want)
    plain = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert plain(got) == plain(want)


def test_excerpts_are_defined_by_all_documents(spark, monkeypatch):
    whole, seen = "/root/testdata/sf0.01", []
    monkeypatch.setattr(queries.convert, "corpus_excerpts", lambda sources, of=convert.corpus_excerpts: seen.append(sources) or of(sources))
    queries.excerpt_resolve(spark, whole)
    assert seen[0].filter("adf like '%excerpt%'").count() == spark.read.parquet(f"{whole}/documents.parquet").filter("doc_id % 2 = 0").count() > 150


def test_entry(spark):
    assert entry.entry(spark).limit(3).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
