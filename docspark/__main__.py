"""python -m docspark convert|analyze|validate: one document, or a folder of them, on a local session.

Exit codes: 0 done, 1 a file that can't be read, 2 wrong usage or lookup files,
3 a root that isn't valid, 4 a gate, 70 a document that broke off.
"""

from __future__ import annotations

import argparse
import json
import sys


def arguments(argv: list[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="docspark")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("convert", "analyze", "validate"):
        c = commands.add_parser(name)
        c.add_argument("input", nargs="?", default="-", help="a file, a folder, or - for standard input")
        c.add_argument("--output", help="a folder for Spark's JSON files; without it results are printed")
        c.add_argument("--json", action="store_true")
        if name == "analyze":
            c.add_argument("--select", default="", help="sections, comma-separated")
            c.add_argument("--format", default="json", choices=["json", "text"])
        if name == "convert":
            c.add_argument("--title")
            c.add_argument("--unknown-nodes", default="placeholder", choices=["placeholder", "skip", "preserve-raw", "fail"])
            c.add_argument("--table-fallback", default="gfm-promote-first-row", choices=["gfm-promote-first-row", "gfm-empty-header", "html"])
            for flag in ("image-sizes", "visual-marks", "collapse-breaks", "escape-parentheses", "fail-on-lossy", "fail-on-warning"):
                c.add_argument(f"--{flag}", action="store_true")
            for flag in ("media-map", "attachment-map", "page-map", "page-tree-map", "excerpt-map", "extension-map", "attachments", "media-template", "attachment-template", "page-template"):
                c.add_argument(f"--{flag}")
    return top.parse_args(argv)


def main(argv: list[str]) -> int:
    try:
        a = arguments(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    from pyspark.errors import AnalysisException
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from docspark.operators import analyze, convert, parse
    from docspark.plans import render
    from docspark.plans.session import ship
    from docspark.sources import lookups

    spark = SparkSession.builder.appName("docspark").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    ship(spark)
    try:
        docs = spark.createDataFrame([(0, sys.stdin.read())], "doc_id bigint, adf string") if a.input == "-" else lookups.read_documents(spark, a.input)
    except (AnalysisException, OSError) as e:
        print(f"can't read {a.input}: {e}", file=sys.stderr)
        return 1
    code = 0
    if a.command == "validate":
        found = convert.report(docs)
        code = 0 if parse.validate(docs).filter(~F.col("valid")).isEmpty() else 3
    elif a.command == "analyze":
        try:
            sections = tuple(s for s in a.select.split(",") if s) or convert.SECTIONS
            make = convert.metadata if a.format == "json" else convert.metadata_report
            found = make(parse.nodes(docs, analyze.FIELDS).persist(), docs, sections)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
    else:
        constant = lambda name: name.upper().replace("-", "_")
        options = render.Options(constant(a.unknown_nodes), constant(a.table_fallback), a.image_sizes, a.visual_marks, a.collapse_breaks, a.escape_parentheses)
        if a.title is not None:
            docs = docs.withColumn("document_title", F.lit(a.title))
        try:
            files = docs.select("doc_id").take(1)
            tables = convert.Tables(
                attachments=a.attachments and lookups.attachments(spark, a.attachments, files[0]["doc_id"]), media=a.media_map and lookups.string_map(spark, a.media_map, "file_id"),
                attachment_urls=a.attachment_map and lookups.string_map(spark, a.attachment_map, "file_id"), pages=a.page_map and lookups.string_map(spark, a.page_map, "page_node_id"),
                page_trees=a.page_tree_map and lookups.page_trees(spark, a.page_tree_map), excerpts=a.excerpt_map and lookups.excerpts(spark, a.excerpt_map),
            )
            templates = lookups.extension_templates(spark, a.extension_map) if a.extension_map else ()
        except AnalysisException as e:
            print(e, file=sys.stderr)
            return 1
        except (ValueError, KeyError, AttributeError) as e:
            print(f"a lookup file: {e}", file=sys.stderr)
            return 2
        hooks = convert.Hooks(media_template=a.media_template, attachment_template=a.attachment_template, page_template=a.page_template, extension_templates=templates)
        found = convert.convert(convert.with_lookups(docs, parse.nodes(docs, analyze.FIELDS), tables), options, hooks)
        code = convert.exit_code(found, "lossy" if a.fail_on_lossy else "warning" if a.fail_on_warning else None)
    if a.output:
        lookups.write_results(found, a.output)
        return code
    if a.command == "convert" and a.json:
        broken = found.filter("error is not null").select("error")
        for row in broken.toLocalIterator():
            print(row["error"], file=sys.stderr)
        found = convert.to_json(found.filter("error is null"), convert.metadata(parse.nodes(docs, analyze.FIELDS), docs, options=options))
    elif a.command == "validate" and a.json:
        found = parse.parse_results(docs)
    for row in found.toLocalIterator():
        if "json" in row:
            print(json.dumps(json.loads(row["json"]), ensure_ascii=False, indent=2))
        elif "report" in row:
            print(row["report"], end="" if row["report"].endswith("\n") else "\n")
        else:
            print(row["body"] if row["error"] is None else row["error"])
    return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
