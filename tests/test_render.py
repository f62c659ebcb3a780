"""Rendering rules, case by case; inputs and results are derived from the rules."""

import json

import pytest

from docspark.functions import text as t
from docspark.plans import render, tree

MACRO = tree.MACRO


def text(s, *marks):
    made = [{"type": m} if isinstance(m, str) else m for m in marks]
    return {"type": "text", "text": s, **({"marks": made} if made else {})}


def node(kind, *content, **attrs):
    return {"type": kind, **({"attrs": attrs} if attrs else {}), **({"content": list(content)} if content else {})}


def p(*content):
    return node("paragraph", *[text(c) if isinstance(c, str) else c for c in content])


def li(*content):
    return node("listItem", *content)


def link(href, **more):
    return {"type": "link", "attrs": {"href": href, **more}}


def macro(key, kind="extension", ext=MACRO, body=(), text=None, **params):
    attrs = {"extensionType": ext, "extensionKey": key, "parameters": {"macroParams": {k: {"value": v} for k, v in params.items()}}}
    return {"type": kind, "attrs": attrs | ({"text": text} if text else {}), **({"content": list(body)} if body else {})}


def adf(*content, **more):
    return json.dumps({"type": "doc", "version": 1, "content": list(content)} | more)


def body(*content, known=None, title=None, **options):
    return render.convert(adf(*content), render.Options(**options), known, title)["body"]


def codes(*content, **options):
    return [d["code"] for d in render.convert(adf(*content), render.Options(**options))["diagnostics"]]


CASES = {
    "paragraphs": ([p("a"), p(), p("b")], "a\n\nb"),
    "escapes": ([p("*a* [b](c) _d_ e_f <g> & h! ~ `")], "\\*a\\* \\[b\\](c) \\_d\\_ e_f \\<g> \\& h\\! \\~ \\`"),
    "leading markers": ([p("# a"), p("> b"), p("- c"), p("+d"), p("1. e"), p("12) f"), p("    g"), p("\th")], "\\# a\n\n\\> b\n\n\\- c\n\n\\+d\n\n1\\. e\n\n12\\) f\n\n&#32;   g\n\n&#32;h"),
    "marker after a break": ([p("a\n# b")], "a\n\\# b"),
    "marks in order": ([p(text("lots", "strike", "em", "strong"))], "~~***lots***~~"),
    "sub and sup": ([p(text("2", "underline", "strong", {"type": "subsup", "attrs": {"type": "SUP"}}), text("x", {"type": "subsup", "attrs": {"type": "odd"}}))], "<u><sup>**2**</sup></u>x"),
    "marks hug words": ([p(text("  a b ", "strong"), text("c"))], "  **a b** c"),
    "blank marked": ([p("a", text("  ", "strong"), text("b"))], "a  b"),
    "same marks join": ([p(text("a", "strong", "em"), text("b", "em", "strong"))], "***ab***"),
    "code": ([p(text("a*b", "code", "strong"))], "`a*b`"),
    "code with ticks": ([p(text("`a", "code"))], "`` `a ``"),
    "link": ([p(text("a", link("http://x.y/z", title='q"r')))], '[a](http://x.y/z "q\\"r")'),
    "code link": ([p(text("a", "code", link("http://x.y")))], "[`a`](http://x.y)"),
    "link spaces": ([p(text("a", link("http://x y")))], "[a](<http://x y>)"),
    "link parens": ([p(text("a", link("http://x/(y")), text("b", link("http://x/(y)")))], "[a](<http://x/(y>)[b](http://x/(y))"),
    "unsafe link": ([p(text("a", link("java\nscript:alert(1)")), text("b", link("DATA:x")))], "[a](javascript%3Aalert(1))[b](DATA%3Ax)"),
    "blank link": ([p(text(" ", link("http://x_y")))], "[http://x_y](http://x_y)"),
    "indent": ([{**p("a"), "marks": [{"type": "indentation", "attrs": {"level": 2}}]}], "\u00a0" * 8 + "a"),
    "headings": ([node("heading", text("A b"), level=0), node("heading", text("c"), level=9), node("heading", text(" "))], "# A b\n\n###### c"),
    "heading break": ([node("heading", node("hardBreak"), text("a"), node("hardBreak"), text("b"), node("hardBreak"), level=2)], "## a b"),
    "heading anchor": ([node("heading", macro("anchor", "inlineExtension", **{"": "x y"}), text("a"), level=2)], '<a id="x y"></a>\n## a'),
    "quote": ([node("blockquote", p("a"), p("b"))], "> a\n>\n> b"),
    "panels": ([node("panel", p("a"), panelType="error"), node("panel", p("b"), panelType="Success"), node("panel")], "> [!CAUTION]\n> a\n\n> [!TIP]\n> b\n\n> [!NOTE]"),
    "code block": ([node("codeBlock", text("a```b"), language="py`th")], "````pyth\na```b\n````"),
    "rule": ([node("rule")], "---"),
    "expand": ([node("expand", p("a"), title=" <t> ")], "<details><summary>&lt;t&gt;</summary>\n\na\n\n</details>"),
    "layout": ([node("layoutSection", node("layoutColumn", p("a")), node("layoutColumn", p("b")))], "a\n\nb"),
    "hard break": ([p(text("a"), node("hardBreak"), text("- b"))], "a  \n\\- b"),
    "lists": ([node("bulletList", li(p("a"), node("bulletList", li(p("b"), p("c")))), li(node("codeBlock", text("d"))))], "- a\n  - b\n\n    c\n-\n  ```\n  d\n  ```"),
    "ordered": ([node("orderedList", li(p("a"), node("orderedList", li(p("b")))), li(p("c")), order=10)], "10. a\n    1. b\n11. c"),
    "ordered from elsewhere": ([node("bulletList", li(p("a"), node("orderedList", li(p("b")), order=3)))], "- a\n\n  3. b"),
    "tasks": ([node("taskList", node("taskItem", text("a"), state="done"), node("taskList", node("taskItem", state="TODO")), node("blockTaskItem", p("b"), p("c"), state="TODO"))], "- [x] a\n  - [ ]\n- [ ] b\n\n  c"),
    "decisions": ([node("decisionList", node("decisionItem", text("a"), state="DECIDED"), node("decisionItem"))], "- \\[decision:DECIDED\\] a\n- \\[decision\\]"),
    "inlines": ([p(node("emoji", shortName=":x_:"), node("mention", id="7"), node("mention", text=" @Me "), node("mention"), node("date", timestamp="0"), node("status", text="go"), node("status"), node("placeholder", text="-"))], ":x\\_:@7@Me@unknown1970-01-01\\[go\\]\\[status\\]-"),
    "cards": ([node("blockCard", url="http://a.b"), node("blockCard", localId="7"), node("blockCard"), node("embedCard", data={"url": "http://c", "name": "N_"}), p(node("inlineCard", url="/rel"), node("embedCard"))], "<http://a.b>\n\n\\[Card: 7\\]\n\n\\[Card\\]\n\n[N\\_](http://c)\n\n[/rel](/rel)\\[Inline card\\]"),
    "media": ([node("mediaSingle", node("media", type="file", id="1", collection="c", __fileName="a.PNG"), node("caption", text("# cap"))), node("mediaGroup", node("media", id="2", __fileMimeType="application/pdf", name="r.pdf"), node("media", url="http://x/y.pdf?z=1"))], "![a.PNG](media:c/1)\n\n\\# cap\n\n[r.pdf](media:2)\n[y.pdf](http://x/y.pdf?z=1)"),
    "unknown": ([node("zap", p("x")), p({"type": "zip"}, "y")], "\\[Unsupported: zap\\]\n\n\\[Unsupported inline: zip\\]y"),
    "sync": ([node("syncBlock", resourceId="r"), node("bodiedSyncBlock", p("a"))], "\\[Sync block: r\\]\n\n\\[Sync block\\]\n\na"),
    "toc": ([macro("toc", minLevel="3", maxLevel="2"), node("heading", text("A"), level=1), node("heading", text("B!"), level=2), node("heading", text("B"), level=3)], '- [B\\!](#b)\n  - [B](#b-1)\n\n# A\n\n<a id="b"></a>\n## B\\!\n\n<a id="b-1"></a>\n### B'),
    "iframe": ([macro("iframe", src="http://x"), macro("iframe")], "[Embedded content](http://x)\n\n\\[Embedded content\\]"),
    "trees": ([macro("children"), macro("children", depth="2"), macro("children", depth="2", all="", allChildren="TRUE"), macro("pagetree", root="a {b}\n c"), macro("pagetree", root="@self")], "{{children}}\n\n{{children:2}}\n\n{{children}}\n\n{{pagetree:a b c}}\n\n{{pagetree}}"),
    "charts": ([macro("chart:default", title="T"), macro("chart:default"), macro("x", ext=tree.CHART), macro("chart", "bodiedExtension", body=[p("a")], title="T\nU")], "\\[Chart: T\\]\n\n\\[Chart\\]\n\n*Chart*\n\n*Chart: T U*\n\na"),
    "excerpt": ([macro("excerpt", "bodiedExtension", body=[p("a")]), macro("excerpt-include", **{"": "P", "name": "n"}), macro("excerpt-include")], f"a\n\n\\[Excerpt include: P / n\\]\n\n\\[Extension: {MACRO}/excerpt-include\\]"),
    "fallback": ([macro("k", ext="t", text="- z"), macro("k", ext="t"), macro("m", "multiBodiedExtension", ext="t", body=[node("extensionFrame", p("a"))])], "\\- z\n\n\\[Extension: t/k\\]\n\n\\[Extension: t/m\\]\n\na"),
    "pdf": ([macro("viewpdf", name="n.pdf", fileId="9"), macro("viewpdf", name="n"), macro("viewpdf")], "[PDF: n.pdf](attachment:9)\n\n\\[PDF: n\\]\n\n\\[PDF\\]"),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    content, want = CASES[name]
    assert body(*content) == want


def cell(*content, kind="tableCell", **attrs):
    return node(kind, *content, **attrs)


def row(*cells):
    return node("tableRow", *cells)


HEAD = row(cell(p("h|"), kind="tableHeader"), cell(p("k"), kind="tableHeader"))


def test_tables():
    plain = row(cell(p("😀a")), cell(p(text("b"), node("hardBreak"), text("- c"))))
    assert body(node("table", HEAD, plain)) == "| h\\| | k        |\n| --- | -------- |\n| 😀a | b<br>- c |"
    assert body(node("table", plain, row(cell(p("x"))))) == "| 😀a | b<br>- c |\n| --- | -------- |\n| x   |          |"
    assert body(node("table", row(cell(p("x")))), table_fallback="GFM_EMPTY_HEADER") == "|     |\n| --- |\n| x   |"
    assert body(node("table", row(cell(p("x")))), table_fallback="HTML") == "<table><tr><td>x</td></tr></table>"


def test_html_tables():
    rich = row(cell(p(text("a", "strong"), node("hardBreak"), text("b_c", link("http://x/?a=1&b=2"))), node("bulletList", li(p("i")), li(p("j"))), colspan=2))
    assert body(node("table", HEAD, rich, isNumberColumnEnabled=True)) == (
        '<table><tr><th></th><th>h|</th><th>k</th></tr><tr><td>1</td><td colspan="2"><strong>a</strong><br><a href="http://x/?a=1&amp;b=2">b_c</a><br><ul><li>i</li><li>j</li></ul></td></tr></table>'
    )
    assert body(node("table", row(cell(node("codeBlock", text("x<y")))))) == "<table><tr><td><pre><code>x&lt;y\n</code></pre></td></tr></table>"
    assert body(node("table", row(cell(p("a"), kind="tableHeader"), cell(p("b"))))) == "<table><tr><th>a</th><td>b</td></tr></table>"


def test_policies():
    odd = node("zap", p("x"))
    assert body(odd, unknown_nodes="SKIP") == "" and codes(odd, unknown_nodes="SKIP") == ["UNKNOWN_NODE_SKIPPED"]
    assert body(odd, unknown_nodes="PRESERVE_RAW") == '```json\n{"type":"zap","content":[{"type":"paragraph","content":[{"type":"text","text":"x"}]}]}\n```'
    failed = render.convert(adf(odd), render.Options(unknown_nodes="FAIL"))
    assert failed["body"] is None and "zap" in failed["error"]
    with pytest.raises(ValueError):
        render.Options(unknown_nodes="maybe")


def test_options():
    assert body(p("a (b)"), escape_parentheses=True) == "a \\(b\\)"
    assert body(p(text("a"), node("hardBreak"), text("b")), collapse_breaks=True) == "a\nb"
    assert body(p(text("a", {"type": "textColor", "attrs": {"color": 'r"'}}, {"type": "border", "attrs": {"size": 2, "color": "#f"}})), visual_marks=True) == '<span style="color:r&quot;; border:2px solid #f">a</span>'
    assert body({**p("a"), "marks": [{"type": "alignment", "attrs": {"align": "end"}}]}, visual_marks=True) == '<div align="right">\n\na\n\n</div>'
    assert body(node("mediaSingle", node("media", url="http://x/a.png", width=20.4, height="0")), image_sizes=True) == "![media](http://x/a.png){width=20}"
    assert body(p("a"), title=" T\n_x ") == "# T \\_x\n\na"
    assert render.convert("", title="T")["body"] == "# T"


def test_resolvers():
    files = [{"file_id": "A1", "title": " Doc.PDF ", "media_type": None, "download_url": "http://d/1"}, {"file_id": "2", "title": "doc.pdf", "media_type": None, "download_url": None}, {"file_id": "3", "title": "pic.png", "media_type": "image/png", "download_url": None}]
    known = render.Lookups(attachments=files)
    assert body(macro("attachments"), known=known) == "- [ Doc.PDF ](http://d/1)\n- [pic.png](attachment:3)"
    assert body(macro("attachments"), known=render.Lookups(attachments=[])) == ""
    assert body(macro("viewpdf", name="DOC.pdf"), known=known) == "[PDF: DOC.pdf](http://d/1)"
    assert body(node("mediaSingle", node("media", id="3")), known=known) == "![pic.png](media:3)"
    assert body(node("mediaSingle", node("media", id="a1")), known=known) == "[ Doc.PDF ](http://d/1)"

    def broken(_):
        raise RuntimeError

    page = render.Lookups(page={"7": "http://p/7", "8": " "}.get, page_tree=lambda a: [{"depth": 1, "title": "A  b", "page_node_id": "7"}, {"depth": 2, "title": "c", "page_node_id": None}], excerpt=lambda a: "" if a["name"] else None, media=broken)
    found = render.convert(adf(p(text("x", link("/wiki/spaces/S/pages/7/T")), text("y", link("/pages/8"))), macro("pagetree"), macro("excerpt-include", **{"": "P", "name": "n"}), macro("excerpt-include", **{"": "P"}), node("blockCard", url="/pages/7"), node("mediaSingle", node("media", id="1"))), render.Options(), page)
    assert found["body"] == "[x](http://p/7)[y](/pages/8)\n\n- [A b](http://p/7)\n  - c\n\n\\[Excerpt include: P\\]\n\n[/pages/7](http://p/7)\n\n[file](media:1)"
    assert found["unresolved"] == {"page_ids": ["8"], "page_trees": [], "excerpts": [{"page": "P", "name": None}]}
    assert body(macro("k", ext="t"), known=render.Lookups(extensions=[broken, lambda a: None, lambda a: a["key"] + "!"])) == "k!"


def test_diagnostics_in_order():
    found = render.convert(adf(node("zap"), p(text("a", "glow")), macro("b", ext="t"), macro("a", ext="t"), macro("b", ext="t"), version=2))
    assert [d["code"] for d in found["diagnostics"]] == ["UNSUPPORTED_VERSION", "UNKNOWN_NODE_PLACEHOLDER", "UNKNOWN_MARK_DROPPED", "UNSUPPORTED_MACRO"]
    assert found["diagnostics"][3]["message"] == "2 unsupported macro(s) rendered as placeholders; original content not represented: t/b, t/a."
    assert found["lossy"]


def test_malformed():
    for bad, want in (("", []), (" ", []), ("{", ["INVALID_JSON"]), ("NaN", ["INVALID_JSON"]), ("null", ["INVALID_ROOT_TYPE"]), ("[]", ["INVALID_ROOT_TYPE"]), ("{}", ["INVALID_ROOT_NODE", "INVALID_VERSION", "INVALID_CONTENT"]), ("[" * 1400, ["INVALID_JSON"]), ('{"type":"doc","version":" 1 ","content":[]}', [])):
        assert tree.parse(bad)[1] == want, bad
    assert body(p(None or "a"), {"type": "bulletList", "content": [None, p("stray"), li(p("b"))]}, "x", 3) == "a\n\n- b"
    assert t.iso_date(str(-(2**63))).startswith("-") and t.iso_date("'1") == "'1" and t.iso_date("253402300800000") == "+10000-01-01"


def test_slugs_and_anchors():
    heads = [node("heading", text(x)) for x in ("Notes — Draft", "a", "A", "!?", "a")]
    entries, _, _ = tree.outline(tree.parse(adf(*heads, node("heading", text("a"), macro("anchor", "inlineExtension", legacyAnchorId="own"))))[0])
    assert [e[2] for e in entries] == ["notes--draft", "a", "a-1", "section", "a-2", "own"]


def test_text_rules():
    assert t.strip("\u00a0a ") == "\u00a0a" and t.blank(" \u2003\n") and not t.blank("\u00a0")
    assert t.lines("a\r\nb\x0bc\u2028") == ["a", "b", "c", ""]
    assert t.fence(None) == "```\n\n```" and t.code_span("") == "``"
    assert t.destination("http://a/<b> (c)\n") == "http://a/%3Cb%3E%20%28c%29%0A"
    assert t.expand_template("http://x/{id}?t={title}{no}", {"id": "a b/~*", "title": "é"}) == "http://x/a%20b%2F~%2A?t=%C3%A9{no}"
    assert [t.positive_integer(x) for x in ("20.5", "0.4", "-1", "1f", "x", None)] == [21, None, None, 1, None, None]
    assert t.media_type("http://x/a.b/c.JPG?d=e.pdf") == "image/jpeg" and t.media_type("none") is None
    assert tree.java_double(1e20) == "1.0E20" and tree.java_double(1.5) == "1.5" and tree.java_double(0.00012) == "1.2E-4"
