"""Documents to issues and nodes.

``validate`` is SQL over VARIANT.  ``nodes`` walks each document once in an
Arrow batch function and gives the node table that all analysis reads: one row
per block or inline, in document order by ``path``.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import text as t
from docspark.plans import tree

BLANK = r"^[\t\n\x0B\f\r\x1c-\x1f \u1680\u2000-\u2006\u2008-\u200a\u2028\u2029\u205f\u3000]*$"


def nesting(adf: Column) -> Column:
    """struct<top, closed>: the deepest nesting, and whether the first value ends with the text; brackets inside strings don't count."""
    marks = F.regexp_replace(F.regexp_replace(adf, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"), F.lit(0).alias("ends"))

    def step(s: Column, c: Column) -> Column:
        now = s["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["top"], now).alias("top"), (s["ends"] + F.when((c != "") & (now <= 0), 1).otherwise(0)).alias("ends"))

    closed = lambda s: (s["now"] == 0) & (s["ends"] <= 1) & ((s["ends"] == 0) | F.regexp_replace(adf, r"\s+$", "").rlike(r"[\]}]$"))
    return F.aggregate(F.split(marks, ""), start, step, lambda s: F.struct(s["top"].alias("top"), closed(s).alias("closed")))


def validate(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns ``keep``, codes (what is wrong with the root, in order) and valid (a document can be read).

    Null and blank documents have no codes and aren't valid.
    """
    v = F.try_parse_json("adf")
    read = docs.select(*keep, "adf").withColumn("nested", nesting(F.col("adf"))).withColumn("v", F.when((F.col("nested.top") <= tree.DEPTH) & F.col("nested.closed"), v))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    number = F.expr("try_cast(trim(BOTH FROM try_variant_get(v, '$.version', 'string')) AS double)")
    numeric = kind("$.version").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") | (kind("$.version") == "STRING") & F.expr("try_variant_get(v, '$.version', 'string')").rlike(r"^[\x00-\x20]*[+-]?[0-9]{1,10}[\x00-\x20]*$")
    string_is = lambda path, value: F.coalesce(F.try_variant_get("v", path, "string") == value, F.lit(False))
    checks = F.array_compact(
        F.array(
            F.when(~string_is("$.type", "doc"), "INVALID_ROOT_NODE"),
            F.when(~F.coalesce(numeric, F.lit(False)), "INVALID_VERSION").when(F.floor(number) != 1, "UNSUPPORTED_VERSION"),
            F.when(~F.coalesce(kind("$.content").startswith("ARRAY"), F.lit(False)), "INVALID_CONTENT"),
        )
    )
    blank = F.col("adf").isNull() | F.col("adf").rlike(BLANK)
    codes = (
        F.when(blank, F.array().cast("array<string>")).when(F.col("v").isNull(), F.array(F.lit("INVALID_JSON")))
        .when(~F.schema_of_variant("v").startswith("OBJECT"), F.array(F.lit("INVALID_ROOT_TYPE"))).otherwise(checks)
    )
    fatal = lambda c: F.exists(c, lambda x: x != "UNSUPPORTED_VERSION")
    return read.select(*keep, codes.alias("codes"), blank.alias("blank")).select(*keep, "codes", (~F.col("blank") & ~fatal(F.col("codes"))).alias("valid"))


NODES = pa.schema(
    [
        ("doc_id", pa.int64()), ("path", pa.list_(pa.int32())), ("ord", pa.int32()), ("depth", pa.int32()), ("kind", pa.string()), ("type", pa.string()), ("known", pa.bool_()), ("text", pa.string()), ("level", pa.int32()),
        ("anchor", pa.string()), ("links", pa.list_(pa.struct([("url", pa.string()), ("page", pa.string())]))), ("file", pa.struct([(k, pa.string()) for k in tree.MEDIA])), ("ext_type", pa.string()), ("ext_key", pa.string()),
        ("params", pa.map_(pa.string(), pa.string())), ("person", pa.string()), ("unknown_marks", pa.int32()), ("attrs", pa.string()), ("raw", pa.string()),
    ]
)
_DDL = (
    "doc_id bigint, path array<int>, ord int, depth int, kind string, type string, known boolean, text string, level int, anchor string, links array<struct<url:string,page:string>>, file struct<"
    + ",".join(f"{k}:string" for k in tree.MEDIA)
    + ">, ext_type string, ext_key string, params map<string,string>, person string, unknown_marks int, attrs string, raw string"
)


def _links(n: tree.Node) -> list[dict]:
    """Links of a node's marks, then of a card, each with the page that its metadata names."""
    links = [(tree.string(m.attrs.get("href")), m.attrs) for m in n.marks if m.type == "link"] if n.type in ("text", "media", "mediaInline") else []
    if n.known and n.type in tree.CARDS:
        links.append((tree.card(n)[0], n.attrs))
    metadata = lambda x: x.get("__confluenceMetadata") if isinstance(x.get("__confluenceMetadata"), dict) else {}
    return [{"url": u, "page": t.first_clean(*(tree.string(metadata(x).get(k)) for k in ("pageId", "contentId", "id")))} for u, x in links]


def _macro(n: tree.Node) -> bool:
    return n.known and n.type in tree.EXTENSIONS


def _heading(n: tree.Node) -> bool:
    return n.known and n.type == "heading"


#: A node's columns (of doc_id, place in order, path and node); links and pages as analysis reads them, headings with their text and explicit anchor.
CELLS: dict[str, Callable] = {
    "doc_id": lambda doc_id, order, path, n: doc_id, "path": lambda doc_id, order, path, n: path, "ord": lambda doc_id, order, path, n: order, "depth": lambda doc_id, order, path, n: len(path) - 1,
    "kind": lambda doc_id, order, path, n: "inline" if n.inline else "block", "type": lambda doc_id, order, path, n: n.type, "known": lambda doc_id, order, path, n: n.known,
    "text": lambda doc_id, order, path, n: tree.heading_text(n.children) if _heading(n) else tree.mention_text(n) if n.type == "mention" else n.text or None,
    "level": lambda doc_id, order, path, n: t.clamp_level(tree.integer(n.attrs.get("level"), 1)) if n.type == "heading" else None,
    "anchor": lambda doc_id, order, path, n: tree.anchor_of(n.children) if _heading(n) else None, "links": lambda doc_id, order, path, n: _links(n), "file": lambda doc_id, order, path, n: tree.media(n) if n.known else None,
    "ext_type": lambda doc_id, order, path, n: tree.string(n.attrs.get("extensionType")) if _macro(n) else None, "ext_key": lambda doc_id, order, path, n: tree.string(n.attrs.get("extensionKey")) if _macro(n) else None,
    "params": lambda doc_id, order, path, n: list(tree.macro_params(n).items()) if _macro(n) else None,
    "person": lambda doc_id, order, path, n: t.first_clean(tree.string(n.attrs.get("id")), tree.string(n.attrs.get("localId"))) if n.type == "mention" else None,
    "unknown_marks": lambda doc_id, order, path, n: sum(not m.known for m in n.marks) if n.marks else 0, "attrs": lambda doc_id, order, path, n: tree.dump(n.attrs) if n.attrs else None, "raw": lambda doc_id, order, path, n: n.raw,
}
NODES_DDL = {c.partition(" ")[0]: c for c in _DDL.split(", ")}


def nodes(docs: DataFrame, columns: tuple[str, ...] = tuple(NODES.names), where: Callable[[tree.Node], bool] | None = None) -> DataFrame:
    """The node table of docs (doc_id, adf), or the columns of it that are asked for; documents that can't be read have no nodes.

    Spark can't prune columns or push filters inside an Arrow function, so
    callers that read a few columns, or rows of a few nodes (``where``), name them.
    """
    fields = [NODES.field(c) for c in columns]
    cells = [CELLS[c] for c in columns]

    def run(batches):
        for batch in batches:
            made: list[list] = [[] for _ in columns]
            for doc_id, adf in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks, _ = tree.parse(adf)
                for order, (path, n) in enumerate(tree.walk(blocks or [])):
                    if where is None or where(n):
                        for column, cell in zip(made, cells, strict=True):
                            column.append(cell(doc_id, order, path, n))
                if len(made[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, fields, strict=True)], columns)
                    made = [[] for _ in columns]
            if made[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, fields, strict=True)], columns)

    return docs.select(F.col("doc_id").cast("bigint"), "adf").mapInArrow(run, ", ".join(NODES_DDL[c] for c in columns))


def parse_results(docs: DataFrame) -> DataFrame:
    """doc_id and the issues as JSON: validAdfRoot and issues."""
    checked = validate(docs)
    message = F.create_map(*[F.lit(x) for kv in tree.ISSUES.items() for x in kv])
    issue = lambda c: F.struct(c.alias("code"), F.when(c == "UNSUPPORTED_VERSION", "WARNING").otherwise("ERROR").alias("severity"), message[c].alias("message"))
    return checked.select("doc_id", F.to_json(F.struct(F.col("valid").alias("validAdfRoot"), F.transform("codes", issue).alias("issues"))).alias("json"))
