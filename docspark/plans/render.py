"""Rendering: one document's tree to GitHub-flavoured Markdown.

Elements are rendered by methods found by their type; what the caller knows
(URLs of pages and files, trees, excerpts) comes as ``Lookups``.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from docspark.functions import text as t
from docspark.plans import cell_html, tree
from docspark.plans.tree import Mark, Node, string

POLICIES = ("PLACEHOLDER", "SKIP", "PRESERVE_RAW", "FAIL")
FALLBACKS = ("GFM_PROMOTE_FIRST_ROW", "GFM_EMPTY_HEADER", "HTML")
LIST_INDENT = "  "
NBSP_INDENT = "\u00a0" * 4
#: Alerts by panel type (fixed values).
ALERTS = {"warning": "WARNING", "error": "CAUTION", "tip": "TIP", "success": "TIP"}
#: Marks that format text, innermost first (fixed order).
MARK_ORDER = {k: i for i, k in enumerate("strong em strike subsup underline fontSize textColor backgroundColor border".split())}
DELIMITERS = {"strong": ("**", "**"), "em": ("*", "*"), "strike": ("~~", "~~"), "underline": ("<u>", "</u>")}


class UnsupportedNode(ValueError):
    """The FAIL policy met an unknown node."""


@dataclass(frozen=True)
class Options:
    unknown_nodes: str = "PLACEHOLDER"
    table_fallback: str = "GFM_PROMOTE_FIRST_ROW"
    image_sizes: bool = False
    visual_marks: bool = False
    collapse_breaks: bool = False
    escape_parentheses: bool = False

    def __post_init__(self):
        if self.unknown_nodes not in POLICIES or self.table_fallback not in FALLBACKS:
            raise ValueError(f"unknown policy {self.unknown_nodes} or fallback {self.table_fallback}")


@dataclass
class Lookups:
    """What is known beside the document.  None: never asked for; a missing key: declined.

    Functions may stand for the maps; one that raises declines.
    """

    attachments: list[dict] | None = None
    media: Callable[[dict], str | None] | None = None
    attachment: Callable[[dict], str | None] | None = None
    page: Callable[[str], str | None] | None = None
    page_tree: Callable[[dict], list[dict] | None] | None = None
    excerpt: Callable[[dict], str | None] | None = None
    extensions: list[Callable[[dict], str | None]] = field(default_factory=list)


_failed: set[tuple[str, str]] = set()


def _ask(function: Callable | None, argument, blank_declines: bool = True):
    if function is None:
        return None
    try:
        found = function(argument)
    except Exception as e:  # a caller's function that fails has no answer
        kind = (getattr(function, "__qualname__", repr(type(function))), type(e).__name__)
        if kind not in _failed:  # once in a worker, not for every document
            _failed.add(kind)
            logging.getLogger(__name__).warning("resolver %s failed and counts as declined: %s", kind[0], e)
        return None
    return None if blank_declines and isinstance(found, str) and t.blank(found) else found


def inventory(attachments: list[dict] | None) -> list[dict]:
    """Valid entries, the first of each title (white space and case aside)."""
    out: dict[str, dict] = {}
    for x in attachments or ():
        title = (t.clean(x.get("title")) or "").lower()
        if title and not t.blank(x.get("file_id")):
            out.setdefault(title, x)
    return list(out.values())


@dataclass(frozen=True)
class Place:
    depth: int = 0
    cell: str = ""  # "", gfm or html
    heading: bool = False


class Fold:
    def __init__(self, blocks: list[Node], options: Options, known: Lookups):
        self.o, self.known = options, known
        self.headings, self.heading_of, self.toc_levels = tree.outline(blocks)
        self.blocks = blocks
        self.inventory = inventory(known.attachments)
        self.by_title = {t.clean(x["title"]).lower(): x for x in self.inventory}
        self.by_file: dict[str, dict] = {}
        for x in self.inventory:
            self.by_file.setdefault((t.clean(x["file_id"]) or "").lower(), x)
        self.unsupported: dict[str, None] = {}
        self.no_page: dict[str, None] = {}
        self.no_tree: list[dict] = []
        self.no_excerpt: list[dict] = []

    # -- small helpers

    def esc(self, s: str | None, at_start: bool = False) -> str:
        return t.escape(s, at_start, self.o.escape_parentheses)

    def token(self, s: str | None) -> str:
        return t.token(s, self.o.escape_parentheses)

    def link(self, label: str | None, url: str | None) -> str:
        return t.link(label, url, self.o.escape_parentheses)

    # -- the document

    def body(self) -> str:
        return t.join_blocks(self.many(self.blocks, Place()))

    def many(self, blocks: list[Node], at: Place) -> list[str]:
        return [s for b in blocks for s in self.block(b, at)]

    def block(self, n: Node, at: Place) -> list[str]:
        if not n.known:
            return self.unknown_block(n)
        found = getattr(self, f"on_{n.type}")(n, at)
        return found if isinstance(found, list) else [found]

    def children(self, n: Node, at: Place) -> list[str]:
        return self.many(n.children, at)

    on_listItem = on_layoutColumn = on_extensionFrame = children

    def unknown_block(self, n: Node) -> list[str]:
        policy, named = self.o.unknown_nodes, not t.blank(n.type)
        if policy == "FAIL":
            raise UnsupportedNode(f"Unsupported ADF block node type: {n.type if named else '<empty>'}")
        if policy == "PRESERVE_RAW":
            return [t.fence(n.raw, "json")]
        return [self.token(f"Unsupported: {n.type}")] if policy == "PLACEHOLDER" and named else []

    # -- inlines

    def inlines(self, nodes: list[Node], at: Place, start: bool) -> str:
        out = []
        for n in merged(nodes):
            s = self.inline(n, at, start)
            out.append(s)
            start = n.type == "hardBreak" and n.known or start and not s
        return "".join(out)

    def inline(self, n: Node, at: Place, start: bool) -> str:
        if not n.known:
            return self.unknown_inline(n)
        a = n.attrs
        match n.type:
            case "text":
                if any(m.type == "code" for m in n.marks):
                    return self.marked(n.text, n.marks)
                return self.marked(self.esc(n.text, start and at.cell != "gfm"), n.marks)
            case "hardBreak":
                return " " if at.heading else "\n" if at.cell or self.o.collapse_breaks else "  \n"
            case "inlineCard":
                return self.card(n) or self.token("Inline card")
            case "mediaInline":
                return self.marked(self.file(tree.media(n)), n.marks)
            case "date":
                return self.esc(t.iso_date(string(a.get("timestamp"))), start)
            case "emoji":
                return self.esc(t.first(string(a.get("text")), string(a.get("shortName"))), start)
            case "mention":
                name = tree.mention_text(n)
                return self.esc(name or f"@{t.first(string(a.get('id')), string(a.get('localId'))) or 'unknown'}", start)
            case "placeholder":
                return self.esc(string(a.get("text")), start)
            case "status":
                return self.token(t.first(string(a.get("text"))) or "status")
            case _:
                return self.macro(n)

    def unknown_inline(self, n: Node) -> str:
        policy, named = self.o.unknown_nodes, not t.blank(n.type)
        if policy == "FAIL":
            raise UnsupportedNode(f"Unsupported ADF inline node type: {n.type if named else '<empty>'}")
        if policy == "PRESERVE_RAW":
            return t.code_span(n.raw)
        return self.token(f"Unsupported inline: {n.type}") if policy == "PLACEHOLDER" and named else ""

    # -- marks

    def marked(self, s: str, marks: list[Mark]) -> str:
        known = [m for m in marks if m.known]
        if any(m.type == "code" for m in known):
            s = t.code_span(s)
        else:
            formats = sorted((m for m in known if m.type in MARK_ORDER), key=lambda m: MARK_ORDER[m.type])
            for m in formats:
                s = hug(s, *delimiters(m))
            style = "; ".join(filter(None, map(declaration, formats))) if self.o.visual_marks else ""
            s = hug(s, f'<span style="{style}">', "</span>") if style else s
        links = [m for m in known if m.type == "link"]
        href = string(links[-1].attrs.get("href")) if links else None
        if t.blank(href):
            return s
        title = string(links[-1].attrs.get("title"))
        return t.link_to(self.esc(href) if t.blank(s) else s, self.page_url(href, links[-1].attrs), None if t.blank(title) else title)

    def page_url(self, href: str, attrs: dict) -> str:
        return (self.resolve_page(tree.page_id(href, attrs)) if self.known.page else None) or href

    def resolve_page(self, page: str | None) -> str | None:
        if self.known.page is None or t.blank(page):
            return None
        found = _ask(self.known.page, page)
        if found is None:
            self.no_page[page] = None
        return found

    # -- blocks of text

    def on_paragraph(self, n: Node, at: Place) -> str:
        s = self.inlines(n.children, at, True)
        return s if t.blank(s) else self.aligned(self.marked(indentation(n) + s, n.marks), n)

    def on_heading(self, n: Node, at: Place) -> str:
        parts: list[str] = []
        before = None
        for x in merged(tree.heading_content(n.children)):
            s = self.inline(x, replace(at, heading=True), False)
            if not s:
                continue
            image = x.type == "mediaInline" or before is not None and before.type == "mediaInline"
            if image and parts and parts[-1][-1] not in t.JVM_SPACE and s[0] not in t.JVM_SPACE:
                parts.append(" ")
            parts.append(s)
            before = x
        text = t.strip("".join(parts))
        own = tree.anchor_of(n.children)
        if t.blank(text):
            return t.anchor(own)
        level = t.clamp_level(tree.integer(n.attrs.get("level"), 1))
        line = t.trim(f"{'#' * level} {indentation(n)}{text}")
        entry = self.heading_of.get(id(n))
        if entry and not t.blank(entry[2]) and (own or level in self.toc_levels):
            line = f"{t.anchor(entry[2])}\n{line}"
        return self.aligned(line, n)

    def aligned(self, s: str, n: Node) -> str:
        if not self.o.visual_marks or t.blank(s):
            return s
        for m in n.marks:
            side = {"center": "center", "end": "right"}.get(string(m.attrs.get("align")) or "") if m.type == "alignment" else None
            if side:
                return f'<div align="{side}">\n\n{s}\n\n</div>'
        return s

    def on_blockquote(self, n: Node, at: Place) -> str:
        return t.quoted(t.join_blocks(self.children(n, at)))

    def on_panel(self, n: Node, at: Place) -> str:
        head = f"> [!{ALERTS.get((string(n.attrs.get('panelType')) or '').lower(), 'NOTE')}]"
        inner = t.quoted(t.join_blocks(self.children(n, at)))
        return f"{head}\n{inner}" if inner else head

    def on_rule(self, n: Node, at: Place) -> str:
        return "---"

    def on_codeBlock(self, n: Node, at: Place) -> str:
        return t.fence(n.text, string(n.attrs.get("language")))

    def on_layoutSection(self, n: Node, at: Place) -> str:
        return t.join_blocks([s for column in n.children for s in self.children(column, at)])

    def on_expand(self, n: Node, at: Place) -> str:
        summary = f"<summary>{t.html_text(t.trim(string(n.attrs.get('title')) or ''))}</summary>"
        inner = t.join_blocks(self.children(n, at))
        return f"<details>{summary}</details>" if t.blank(inner) else f"<details>{summary}\n\n{inner}\n\n</details>"

    on_nestedExpand = on_expand

    # -- lists: every item is a marker and lines that hang from its content column

    def on_bulletList(self, n: Node, at: Place, margin: str = "") -> str:
        first = tree.integer(n.attrs.get("order"), 1)
        rows = [self.item(x, f"{first + i}." if n.type == "orderedList" else "-", at, margin) for i, x in enumerate(n.children)]
        return "\n".join(x for row in rows for x in row)

    on_orderedList = on_bulletList

    def item(self, n: Node, marker: str, at: Place, margin: str) -> list[str]:
        hang = margin + " " * (len(marker) + 1)
        out: list[str] = []
        for i, b in enumerate(n.children):
            if i == 0 and b.type == "paragraph" and b.known:
                out += hanging(f"{margin}{marker} ", self.inlines(b.children, at, True), hang)
                continue
            if i == 0:
                out.append(f"{margin}{marker}")
            elif not tight(b):
                out.append("")
            out += self.nested(b, at, hang)
        return out or [f"{margin}{marker}"]

    def nested(self, b: Node, at: Place, hang: str) -> list[str]:
        deeper = replace(at, depth=at.depth + 1)
        if b.type in ("bulletList", "orderedList"):
            s = self.on_bulletList(b, deeper, hang)
            return [] if t.blank(s) else t.lines(s)
        flat = b.type in ("taskList", "decisionList")
        return t.indent(t.join_blocks(self.block(b, deeper)) if not flat else self.block(b, replace(at, depth=0))[0], hang)

    def on_taskList(self, n: Node, at: Place) -> str:
        out: list[str] = []
        for x in n.children:
            if x.type == "taskList":
                s = self.on_taskList(x, replace(at, depth=at.depth + 1))
                out += [] if t.blank(s) else [s]
            else:
                out += self.block(x, at)
        return "\n".join(out)

    def checkbox(self, n: Node, at: Place) -> str:
        done = (string(n.attrs.get("state")) or "").upper() == "DONE"
        return f"{LIST_INDENT * at.depth}- [{'x' if done else ' '}] "

    def on_taskItem(self, n: Node, at: Place) -> str:
        s = self.inlines(n.children, at, False)
        box = self.checkbox(n, at)
        return t.rstrip(box) if t.blank(s) else box + s

    def on_blockTaskItem(self, n: Node, at: Place) -> str:
        box, hang = self.checkbox(n, at), LIST_INDENT * (at.depth + 1)
        out: list[str] = []
        for i, b in enumerate(n.children):
            if i == 0 and b.type == "paragraph" and b.known:
                out += hanging(box, self.inlines(b.children, at, False), hang)
                continue
            out.append("" if i else t.rstrip(box))
            out += t.indent(t.join_blocks(self.block(b, replace(at, depth=at.depth + 1))), hang)
        return "\n".join(out) or t.rstrip(box)

    def on_decisionList(self, n: Node, at: Place) -> str:
        return "\n".join(self.on_decisionItem(x, at) for x in n.children)

    def on_decisionItem(self, n: Node, at: Place) -> str:
        state = string(n.attrs.get("state"))
        label = self.token("decision" if t.blank(state) else f"decision:{state}")
        s = self.inlines(n.children, at, False)
        return f"{LIST_INDENT * at.depth}- {label}" + ("" if t.blank(s) else f" {s}")

    # -- tables

    def on_table(self, n: Node, at: Place) -> str:
        rows = [r for r in n.children if r.children]
        if not n.children:
            return ""
        cells = [c for r in rows for c in r.children]
        natural = bool(rows) and header_row(rows[0])
        numbered = tree.flag(n.attrs.get("isNumberColumnEnabled"))
        rich = any(span(c, "colspan") > 1 or span(c, "rowspan") > 1 or any(not b.known or b.type not in ("paragraph", "mediaSingle", "mediaGroup", "media") for b in c.children) for c in cells)
        if numbered or rich or not natural and (any(c.type == "tableHeader" for c in cells) or self.o.table_fallback == "HTML"):
            return cell_html.table(self, rows, at, numbered)
        grid = [[self.cell(c, at) for c in r.children] for r in rows]
        if not grid:
            return ""
        columns = max(map(len, grid))
        grid = [[*r, *[""] * (columns - len(r))] for r in grid]
        if not natural and self.o.table_fallback == "GFM_EMPTY_HEADER":
            grid.insert(0, [""] * columns)
        widths = [max(3, *(t.utf16_length(r[k]) for r in grid)) for k in range(columns)]
        drawn = ["| " + " | ".join(s + " " * (w - t.utf16_length(s)) for s, w in zip(r, widths, strict=True)) + " |" for r in grid]
        drawn.insert(1, "| " + " | ".join("-" * w for w in widths) + " |")
        return "\n".join(drawn)

    def on_tableRow(self, n: Node, at: Place) -> str:
        return f"| {' | '.join(self.cell(c, at) for c in n.children)} |" if n.children else ""

    def cell(self, n: Node, at: Place) -> str:
        s = t.trim(t.join_blocks(self.children(n, replace(at, cell="gfm"))))
        return "" if t.blank(s) else s.replace("|", "\\|").replace("\n", "<br>")

    on_tableCell = on_tableHeader = cell

    # -- media

    def on_mediaSingle(self, n: Node, at: Place) -> str:
        images = [self.on_media(x, at) for x in n.children if x.type == "media" and x.known]
        captions = [self.on_caption(x, at) for x in n.children if x.type == "caption" and x.known]
        shown = [self.marked("\n\n".join(images), n.marks)] if images else []
        return "\n\n".join(shown + [c for c in captions if not t.blank(c)])

    def on_caption(self, n: Node, at: Place) -> str:
        return self.inlines(n.children, at, True)

    def on_mediaGroup(self, n: Node, at: Place) -> str:
        return "\n".join(self.on_media(x, at) for x in n.children if x.type == "media" and x.known)

    def on_media(self, n: Node, at: Place) -> str:
        return self.marked(self.file(tree.media(n)), n.marks)

    def file(self, m: dict) -> str:
        entry = self.by_file.get((t.clean(m["id"]) or "").lower()) or {}
        source = m["url"] if not t.blank(m["url"]) else _ask(self.known.media, m) or t.first(entry.get("download_url"))
        where = source
        if where is None:
            name = f"{m['collection']}/{m['id']}" if not t.blank(m["collection"]) else m["id"]
            where = "media" if t.blank(m["id"]) else f"media:{name}"
        title = t.first(entry.get("title"))
        kind = t.first(m["mime"], m["media_type"], entry.get("media_type"))
        says = t.is_image_type(kind)
        for name in (m["file_name"], m["name"], m["alt"], title, m["url"], source):
            says = t.is_image_type(t.media_type(name)) if says is None else says
        if not says:
            label = t.first(m["name"], m["file_name"], m["alt"], title or t.file_name(source)) or "file"
            return self.link(label, where)
        alt = tree.image_alt(m)
        alt = title if alt == "media" and title else alt
        sizes = [f"{k}={v}" for k in ("width", "height") if (v := t.positive_integer(m[k])) is not None] if self.o.image_sizes else []
        return f"![{t.escape_alt(alt, self.o.escape_parentheses)}]({t.destination(where)})" + (f"{{{' '.join(sizes)}}}" if sizes else "")

    # -- cards

    def on_blockCard(self, n: Node, at: Place) -> str:
        source = n.attrs.get("datasource")
        name = t.first(string(source.get("id")) if isinstance(source, dict) else None, string(n.attrs.get("localId")))
        return self.card(n) or self.token(f"Card: {name}" if name else "Card")

    def on_embedCard(self, n: Node, at: Place) -> str:
        return self.card(n) or self.token("Embed card")

    def card(self, n: Node) -> str | None:
        url, title = tree.card(n)
        if t.blank(url):
            return None if t.blank(title) else self.esc(title)
        target = self.page_url(url, n.attrs)
        if not t.blank(title):
            return self.link(title, target)
        plain = target == url and t.destination(target) == url and absolute(url)
        return f"<{url}>" if plain else self.link(url, target)

    # -- macros

    def on_extension(self, n: Node, at: Place) -> str:
        return self.macro(n)

    def custom(self, n: Node) -> str | None:
        a = n.attrs
        asked = {"type": string(a.get("extensionType")), "key": string(a.get("extensionKey")), "text": string(a.get("text")), "params": tree.macro_params(n), "parameters": a.get("parameters") or {}}
        return next((s for f in self.known.extensions if (s := _ask(f, asked, False)) is not None), None)

    def macro(self, n: Node) -> str:
        kind, key, p = string(n.attrs.get("extensionType")), string(n.attrs.get("extensionKey")), tree.macro_params(n)
        own = self.custom(n)
        if own is not None:
            return own
        image = tree.media(n)
        if image:
            return self.file(image)
        if kind == tree.CHART:
            return self.chart_caption(n)
        found = getattr(self, f"macro_{(key or '').replace('-', '_').replace(':', '_')}", None) if kind == tree.MACRO else None
        s = found(p) if found and (key or "") in BUILT_IN else None
        return self.fallback(n) if s is None else s

    def fallback(self, n: Node) -> str:
        text = string(n.attrs.get("text"))
        if not t.blank(text):
            return self.esc(text, True)
        label = macro_label(string(n.attrs.get("extensionType")), string(n.attrs.get("extensionKey")))
        self.unsupported[label] = None
        return self.token(label if label == "Extension" else f"Extension: {label}")

    def on_bodiedExtension(self, n: Node, at: Place) -> list[str]:
        kind, key = string(n.attrs.get("extensionType")), string(n.attrs.get("extensionKey")) or ""
        inner = lambda: self.children(n, at)
        if kind == tree.MACRO and key == "excerpt":
            return inner()
        own = self.custom(n)
        if own is None:
            chart = kind == tree.CHART or kind == tree.MACRO and (key == "chart" or key.startswith("chart:"))
            own = self.chart_caption(n) if chart else self.fallback(n)
        return [own, *inner()]

    def on_multiBodiedExtension(self, n: Node, at: Place) -> list[str]:
        own = self.custom(n)
        return [self.fallback(n) if own is None else own, *self.children(n, at)]

    def on_syncBlock(self, n: Node, at: Place) -> list[str]:
        name = string(n.attrs.get("resourceId"))
        return [self.token("Sync block" if t.blank(name) else f"Sync block: {name}"), *self.children(n, at)]

    on_bodiedSyncBlock = on_syncBlock

    def chart_caption(self, n: Node) -> str:
        parameters = n.attrs.get("parameters")
        deep = parameters if isinstance(parameters, dict) else {}
        for k in ("chartGroup", "customizeTab", "titlesField"):
            deep = deep.get(k) if isinstance(deep.get(k), dict) else {}
        generic = parameters.get("extensionTitle") if isinstance(parameters, dict) else None
        title = t.first_clean(tree.macro_params(n).get("title"), *(x if isinstance(x, str) else None for x in (deep.get("chartTitle"), generic)))
        return f"*{self.esc('Chart' if title is None else f'Chart: {t.strip(t.one_line(title))}')}*"

    def macro_chart_default(self, p: dict) -> str:
        return self.token("Chart" if t.blank(p.get("title")) else f"Chart: {p['title']}")

    def macro_anchor(self, p: dict) -> str:
        return t.anchor(t.first_clean(p.get(""), p.get("legacyAnchorId")))

    def macro_iframe(self, p: dict) -> str:
        return self.token("Embedded content") if t.blank(p.get("src")) else self.link("Embedded content", p["src"])

    def macro_toc(self, p: dict) -> str:
        low, high = tree.toc_range(p)
        shown = [h for h in self.headings if low <= h[0] <= high]
        top = min((h[0] for h in shown), default=1)
        label = lambda text, name: self.esc(text) if t.blank(name) else self.link(text, f"#{name}")
        return "\n".join(f"{LIST_INDENT * (level - top)}- {label(text, name)}" for level, text, name in shown)

    def macro_pagetree(self, p: dict) -> str:
        found = self.tree({"macro": "pagetree", "root": tree_root(p.get("root")), "params": p})
        root = t.strip(t.squeeze(tree_root(p.get("root")) or "").replace("{", "").replace("}", ""))
        return (f"{{{{pagetree:{root}}}}}" if root else "{{pagetree}}") if found is None else found

    def macro_children(self, p: dict) -> str:
        found = self.tree({"macro": "children", "root": tree_root(p.get("page")), "params": p})
        depth = t.integer(t.clean(p.get("depth")))
        all_levels = (t.first_clean(p.get("all"), p.get("allChildren")) or "").lower() == "true"
        return (f"{{{{children:{depth}}}}}" if depth and depth > 0 and not all_levels else "{{children}}") if found is None else found

    def tree(self, asked: dict) -> str | None:
        entries = _ask(self.known.page_tree, asked)
        if entries is None:
            self.no_tree.append(asked)
            return None
        top = min((e["depth"] for e in entries), default=0)
        out = []
        for e in entries:
            label = t.strip(t.squeeze(e.get("title") or ""))
            url = self.resolve_page(e.get("page_node_id"))
            if url or label:
                out.append(f"{LIST_INDENT * (e['depth'] - top)}- {self.link(label or url, url) if url else self.esc(label)}")
        return "\n".join(out)

    def macro_excerpt_include(self, p: dict) -> str | None:
        page, name = t.clean(p.get("")), t.clean(p.get("name"))
        if page is None:
            return None
        asked = {"page": page, "name": name, "params": p}
        found = _ask(self.known.excerpt, asked, False)
        if found is None:
            self.no_excerpt.append(asked)
            return self.token(f"Excerpt include: {page}" + (f" / {name}" if name else ""))
        return found

    def file_url(self, entry: dict) -> str:
        return _ask(self.known.attachment, entry) or t.first(entry.get("download_url")) or f"attachment:{entry['file_id']}"

    def macro_attachments(self, p: dict) -> str | None:
        if self.known.attachments is None:
            return None
        return "\n".join(f"- {self.link(x['title'], self.file_url(x))}" for x in self.inventory)

    def macro_viewpdf(self, p: dict) -> str:
        name = p.get("name")
        label = "PDF" if t.blank(name) else f"PDF: {name}"
        entry = viewed_file(p, self.by_title)
        return self.token(label) if entry is None else self.link(label, self.file_url(entry))


#: Macros of the core type with a form of their own (fixed value).
BUILT_IN = frozenset("children pagetree toc anchor iframe viewpdf chart:default excerpt-include attachments".split())


def viewed_file(p: dict, by_title: dict[str, dict]) -> dict | None:
    """The file that a viewpdf macro shows: by title in the inventory, else by the ids it carries."""
    found = by_title.get((t.clean(p.get("name")) or "").lower())
    if found:
        return found
    file_id = t.first(p.get("fileId"), p.get("id"), p.get("attachmentId"))
    return file_id and {"file_id": file_id, "title": p.get("name"), "media_type": t.media_type(p.get("name")), "download_url": None}


def macro_label(kind: str | None, key: str | None) -> str:
    if t.blank(key):
        return "Extension" if t.blank(kind) else kind
    return key if t.blank(kind) else f"{kind}/{key}"


def tree_root(value: str | None) -> str | None:
    found = t.clean(value)
    return None if found is None or found.startswith("@") else found


def merged(nodes: list[Node]) -> list[Node]:
    """Neighbouring texts with the same marks, in whatever order, as one."""
    out: list[Node] = []
    for n in nodes:
        last = out[-1] if out else None
        if last is not None and n.known and n.type == last.type == "text" and same_marks(n.marks, last.marks):
            out[-1] = replace(last, text=last.text + n.text)
        else:
            out.append(n)
    return out


def same_marks(a: list[Mark], b: list[Mark]) -> bool:
    return len(a) == len(b) and all(x in b for x in a) and all(x in a for x in b)


def delimiters(m: Mark) -> tuple[str, str]:
    if m.type == "subsup":
        tag = (string(m.attrs.get("type")) or "").lower()
        return (f"<{tag}>", f"</{tag}>") if tag in ("sub", "sup") else ("", "")
    return DELIMITERS.get(m.type, ("", ""))


def hug(s: str, before: str, after: str) -> str:
    """Delimiters around the text, white space at its ends left outside."""
    core = t.strip(s)
    if not core or not before:
        return s
    at = s.index(core)
    return s[:at] + before + core + after + s[at + len(core) :]


def declaration(m: Mark) -> str | None:
    """The CSS of a mark that is only seen."""
    value = lambda k: t.first(string(m.attrs.get(k)))
    if m.type == "border":
        return f"border:{t.html_text(value('size'))}px solid {t.html_text(value('color'))}" if value("size") and value("color") else None
    named = {"fontSize": ("font-size", "fontSize"), "textColor": ("color", "color"), "backgroundColor": ("background-color", "color")}.get(m.type)
    return f"{named[0]}:{t.html_text(value(named[1]))}" if named and value(named[1]) else None


def indentation(n: Node) -> str:
    level = next((tree.integer(m.attrs.get("level"), 0) for m in n.marks if m.type == "indentation"), 0)
    return NBSP_INDENT * max(0, min(6, level))


def hanging(prefix: str, s: str, hang: str) -> list[str]:
    if t.blank(s):
        return [t.rstrip(prefix)]
    head, *rest = t.lines(s)
    return [prefix + head, *(hang + x for x in rest)]


def tight(b: Node) -> bool:
    """Whether a block follows its list item's text without a blank line."""
    return b.type in ("bulletList", "taskList", "decisionList") or b.type == "orderedList" and tree.integer(b.attrs.get("order"), 1) == 1


def header_row(r: Node) -> bool:
    return all(c.type == "tableHeader" for c in r.children)


def span(c: Node, name: str) -> int:
    return max(1, tree.integer(c.attrs.get(name), 1))


def absolute(url: str) -> bool:
    scheme, colon, _ = url.partition(":")
    return bool(colon) and len(scheme) >= 2 and scheme[0].isalpha() and all(c.isalnum() or c in "+.-" for c in scheme)


def title_line(title: str | None, parens: bool) -> str | None:
    one = t.strip(t.one_line(title)) if title is not None else ""
    return f"# {t.escape(one, False, parens)}" if one else None


def lossiness(blocks: list[Node], policy: str) -> list[tuple[str, str, str]]:
    """Diagnostics (code, severity, message) of nodes and marks that Markdown can't show."""
    nodes = marks = 0
    for n in tree.each(blocks):
        nodes += not n.known
        for m in n.marks:
            marks += not m.known
    kinds = {
        "PLACEHOLDER": ("UNKNOWN_NODE_PLACEHOLDER", "WARNING", "rendered as placeholders; original content not represented."),
        "SKIP": ("UNKNOWN_NODE_SKIPPED", "WARNING", "dropped from the output."), "PRESERVE_RAW": ("UNKNOWN_NODE_PRESERVED", "INFO", "preserved as raw JSON."),
    }
    out = []
    if nodes and policy in kinds:
        code, severity, end = kinds[policy]
        out.append((code, severity, f"{nodes} unsupported node(s) {end}"))
    if marks:
        out.append(("UNKNOWN_MARK_DROPPED", "WARNING", f"{marks} unsupported mark(s) dropped from the output."))
    return out


def convert(adf: str | None, options: Options = Options(), known: Lookups | None = None, title: str | None = None) -> dict:
    """A document's result: body, diagnostics in the phases' order, lossy, unresolved, error."""
    blocks, codes = tree.parse(adf)
    notes = [(c, "WARNING" if c == "UNSUPPORTED_VERSION" else "ERROR", tree.ISSUES[c]) for c in codes]
    fold = Fold(blocks or [], options, known or Lookups())
    body, error = "", None
    try:
        body = fold.body()
    except UnsupportedNode as e:
        error = str(e)
    if blocks is not None:
        notes += lossiness(blocks, options.unknown_nodes)
    if fold.unsupported:
        notes.append(("UNSUPPORTED_MACRO", "WARNING", f"{len(fold.unsupported)} unsupported macro(s) rendered as placeholders; original content not represented: {', '.join(fold.unsupported)}."))
    head = title_line(title, options.escape_parentheses)
    return {
        "body": None if error else "\n\n".join(filter(None, [head, body])),
        "diagnostics": [{"code": c, "severity": s, "message": m} for c, s, m in notes],
        "lossy": any(s in ("WARNING", "ERROR") for _, s, _ in notes),
        "unresolved": {
            "page_ids": list(fold.no_page), "page_trees": [{"macro": x["macro"], "root": x["root"]} for x in fold.no_tree], "excerpts": [{"page": x["page"], "name": x["name"]} for x in fold.no_excerpt],
        },
        "error": error,
    }
