"""Plans at size: tables of short rows are dealt to tasks, tables of a row for each document are never broadcast."""

import pytest
from pyspark.sql import functions as F

from docspark import queries
from docspark.functions import text
from docspark.operators import analyze, convert, parse
from docspark.plans.session import spread
from tests.test_relations import docs, rows  # noqa: F401
from tests.test_render import adf, p

WHOLE = "/root/testdata/sf0.1"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


#: Queries whose joins are between tables that grow with the documents.
JOINED = [
    "metadata_report",
    "metadata_sections",
    "whole_results",
    "table_fallbacks",
    "page_and_external_refs",
    "render_attachments",
    "attachment_expansion",
    "referenced_file_ids",
]


@pytest.mark.parametrize("name", JOINED)
def test_rows_of_documents_are_not_broadcast(spark, name):
    assert "BroadcastExchange" not in plan(queries.QUERIES[name](spark, WHOLE))


def test_sections_share_one_deal(spark):
    """Nodes are dealt by document before they are kept, so no section's windows and groups shuffle them again; what is left is the join with the documents."""
    made = queries.QUERIES["metadata_sections"](spark, "/root/testdata/sf0.001")
    made.collect()
    lines = plan(made).partition("Initial Plan")[0].splitlines()
    spark.catalog.clearCache()
    assert sum("Exchange hashpartitioning(doc_id" in x and "ENSURE_REQUIREMENTS" in x for x in lines) <= 2


def test_sections_of_dealt_nodes(docs):  # noqa: F811
    nodes = parse.nodes(docs)
    for made in (convert.metadata, convert.metadata_report):
        want = sorted(map(str, made(nodes, docs).collect()))
        assert want and sorted(map(str, made(analyze.by_document(nodes), docs, dealt=True).collect())) == want


def test_sections_of_every_row(spark, docs):  # noqa: F811
    """Rows of one doc_id and of none keep a row each."""
    more = docs.unionByName(spark.createDataFrame([(1, adf(p("z"))), (None, adf(p("n")))], "doc_id bigint, adf string"))
    found = convert.metadata(parse.nodes(docs), more, ("pageRefs",))
    assert found.filter("doc_id = 1").count() == 2 and found.filter("doc_id is null").first()["json"] == '{"pageRefs":[]}' and found.count() == more.count()


def test_spread(spark):
    df = spark.range(0, 40_000, 1, 1)
    assert [spread(x, "id").rdd.getNumPartitions() for x in (df, df.limit(4_000), df.limit(300))] == [8, 4, 1]
    assert spread(df, "id", most=1_000).rdd.getNumPartitions() == 40
    most = spread(df, "id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 6_000


#: Queries that make documents from rows of a table of short rows, in one task if it isn't dealt.
DEALT = [
    "page_tree_refs",
    "page_and_external_refs",
    "table_fallbacks",
    "render_html_cells",
    "heading_texts",
    "render_charts",
    "render_table_cells",
    "render_inline_cards",
    "render_media_groups",
    "render_attachments",
    "extension_order",
    "render_indent_align",
    "render_nested_lists",
    "referenced_file_ids",
    "attachment_refs_upsert",
    "whole_results",
    "render_unknown_raw",
    "attachment_expansion",
    "url_templates",
    "render_ordered_nesting",
]


@pytest.mark.parametrize("name", DEALT)
def test_documents_are_made_in_many_tasks(spark, name):
    """The walk or conversion stands above a deal by number."""
    walks = plan(queries.QUERIES[name](spark, WHOLE)).split("MapInArrow")[1:]
    assert walks and "REPARTITION_BY_NUM" in walks[-1]


@pytest.mark.parametrize(("relation", "of"), [(analyze.outline, analyze.HEADINGS), (analyze.page_refs, analyze.LINKS), (analyze.external_refs, analyze.LINKS), (analyze.page_tree_refs, analyze.PAGE_TREES), (analyze.attachment_refs, analyze.FILES), (analyze.mention_refs, analyze.METADATA)])
def test_relations_of_the_nodes_they_read(docs, relation, of):  # noqa: F811
    whole, some, all_sections = (parse.nodes(docs, *x) for x in ((), of, analyze.METADATA))
    want = sorted(map(str, relation(whole).collect()))
    assert want and sorted(map(str, relation(some).collect())) == sorted(map(str, relation(all_sections).collect())) == want
    assert some.count() < whole.count()


def test_both_kinds_of_links_in_one_pass(docs):  # noqa: F811
    nodes = parse.nodes(docs)
    both = analyze.page_and_external_refs(nodes)
    assert rows(both.filter("url is null"), "doc_id", "ord", "page_node_id") == rows(analyze.page_refs(nodes), "doc_id", "ord", "page_node_id")
    assert rows(both.filter("page_node_id is null"), "doc_id", "ord", "url") == rows(analyze.external_refs(nodes), "doc_id", "ord", "url")


def test_files_are_read_step_by_step(docs):  # noqa: F811
    """No step of the plan repeats the ones before it in one long expression (8,700 signs then), a method too long for the JVM to compile."""
    assert max(map(len, plan(analyze.attachment_refs(parse.nodes(docs, *analyze.FILES))).splitlines())) < 3_000


def test_white_space_as_the_jvm_strips_it(spark):
    """A next-line sign isn't white space there, so what stands before it stays; types come from the last segment's extension."""
    said = spark.createDataFrame([("  a \x85",), (" \t　",), ("\n x \n",)], "s string").select(analyze.clean(F.col("s"))).collect()
    assert [r[0] for r in said] == [text.clean(s) for s in ("  a \x85", " \t　", "\n x \n")] == ["a \x85", None, "x "]
    names = ["http://x/a.b/c.JPG?d=e.pdf", "a.pdf/b", "none", "a\n/b.Csv ", "png", ".png", "x.pdf#y.png", "a.", "?a.pdf", None]
    found = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", analyze.media_type(F.col("n"))).collect()
    assert [r[1] for r in sorted(found)] == [text.media_type(n) for n in names]
