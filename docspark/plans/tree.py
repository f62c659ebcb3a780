"""The document tree: parsing of ADF JSON, and the walk over it.

What may stand below an element, and what is read from it, is data
(``BLOCKS``, ``INLINES``, ``MARKS``); parsing is one generic descent.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

from docspark.functions import text as t

#: Block elements and their children: block, inline, none, or the types allowed (fixed values).
BLOCKS: dict[str, str | frozenset[str]] = {
    "paragraph": "inline", "heading": "inline", "blockquote": "block", "codeBlock": "none", "panel": "block", "rule": "none",
    "bulletList": frozenset(["listItem"]), "orderedList": frozenset(["listItem"]), "listItem": "block",
    "taskList": frozenset(["taskItem", "blockTaskItem", "taskList"]), "taskItem": "inline", "blockTaskItem": "block",
    "decisionList": frozenset(["decisionItem"]), "decisionItem": "inline", "table": frozenset(["tableRow"]),
    "tableRow": frozenset(["tableCell", "tableHeader"]), "tableCell": "block", "tableHeader": "block", "mediaSingle": "block",
    "mediaGroup": "block", "media": "none", "caption": "inline", "expand": "block", "nestedExpand": "block",
    "layoutSection": frozenset(["layoutColumn"]), "layoutColumn": "block", "extension": "none", "bodiedExtension": "block",
    "multiBodiedExtension": "block", "extensionFrame": "block", "syncBlock": "none", "bodiedSyncBlock": "block", "blockCard": "none", "embedCard": "none",
}
#: Inline elements (fixed value); cards of other kinds are inline cards here.
INLINES = frozenset("text hardBreak inlineCard embedCard blockCard mediaInline date emoji mention placeholder status inlineExtension".split())
#: Marks (fixed value).
MARKS = frozenset("strong em code strike underline subsup link textColor backgroundColor alignment indentation fontSize border annotation breakout fragment dataConsumer".split())
MARKED = frozenset("paragraph heading mediaSingle media text mediaInline".split())
EXTENSIONS = frozenset("extension bodiedExtension multiBodiedExtension inlineExtension".split())
CARDS = frozenset("blockCard embedCard inlineCard".split())

#: Nesting of JSON that is read at most.
DEPTH = 100
#: Messages of validation by code (fixed values).
ISSUES = {
    "INVALID_JSON": "Failed to parse ADF JSON payload.", "MISSING_DOCUMENT": "ADF document is null.", "INVALID_ROOT_TYPE": "ADF root must be an object.",
    "INVALID_ROOT_NODE": "ADF root node must have type 'doc'.", "INVALID_VERSION": "ADF root must contain integer version.",
    "UNSUPPORTED_VERSION": "ADF version must be 1.", "INVALID_CONTENT": "ADF root must contain array field 'content'.",
}


@dataclass(slots=True)
class Mark:
    type: str
    attrs: dict
    known: bool


@dataclass(slots=True)
class Node:
    type: str
    inline: bool
    known: bool
    attrs: dict
    children: list[Node] = field(default_factory=list)
    marks: list[Mark] = field(default_factory=list)
    text: str = ""
    raw: str | None = None


_ENCODER = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False)


def dump(value) -> str:
    return _ENCODER.encode(value)


def string(value) -> str | None:
    """A JSON scalar as text; None for anything else."""
    if isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return java_double(value)
    return None


def java_double(x: float) -> str:
    """A double as the JVM writes it: plain from 1e-3 to 1e7, else with a one-digit mantissa."""
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        s = repr(x)
        return s if "e" not in s else f"{x:.17f}".rstrip("0")
    mantissa, _, exponent = f"{x!r}e0".partition("e")
    digits = mantissa.replace("-", "").replace(".", "")
    point = len(mantissa.replace("-", "").partition(".")[0]) + int(exponent.removesuffix("e0") or 0)
    stripped = digits.lstrip("0")
    power = point - 1 - (len(digits) - len(stripped))
    stripped = stripped.rstrip("0") or "0"
    return f"{'-' if x < 0 else ''}{stripped[0]}.{stripped[1:] or '0'}E{power}"


def integer(value, default: int) -> int:
    if isinstance(value, bool):
        return default
    if isinstance(value, (int, float)):
        return int(value) if abs(value) < 2**31 else default
    if isinstance(value, str):
        found = t.integer(value.strip())
        return default if found is None else found
    return default


def flag(value) -> bool:
    return value if isinstance(value, bool) else isinstance(value, str) and value.strip() == "true"


def _items(value, allowed: frozenset[str] | None = None) -> list[dict]:
    return [x for x in value if isinstance(x, dict) and (allowed is None or x.get("type") in allowed)] if isinstance(value, list) else []


def parse_node(x: dict, inline: bool) -> Node:
    kind = string(x.get("type")) or ""
    attrs = x.get("attrs")
    attrs = attrs if isinstance(attrs, dict) else {}
    known = kind in (INLINES if inline else BLOCKS)
    if not known:
        return Node(kind, inline, False, {}, raw=dump(x))
    node = Node("inlineCard" if inline and kind in CARDS else kind, inline, True, attrs)
    if kind in MARKED:
        node.marks = [Mark(string(m.get("type")) or "", m.get("attrs") if isinstance(m.get("attrs"), dict) else {}, m.get("type") in MARKS) for m in _items(x.get("marks"))]
    if kind == "text":
        node.text = string(x.get("text")) or ""
    elif kind == "codeBlock":
        node.text = "".join(string(c.get("text")) or "" for c in _items(x.get("content")))
    below = "none" if inline else BLOCKS[kind]
    if below == "inline":
        node.children = [parse_node(c, True) for c in _items(x.get("content"))]
    elif below == "block":
        node.children = [parse_node(c, False) for c in _items(x.get("content"))]
    elif below != "none":
        node.children = [parse_node(c, False) for c in _items(x.get("content"), below)]
    return node


_NO_BRACKET = re.compile(r'"(?:[^"\\]|\\.)*+"|[^"\[\]{}]+', re.S)
_STEP = bytes({0x5B: 1, 0x7B: 1, 0x5D: 255, 0x7D: 255}.get(c, 0) for c in range(256))


def _too_deep(s: str) -> bool:
    """Whether brackets outside strings nest beyond DEPTH; few brackets can't."""
    if s.count("[") + s.count("{") <= DEPTH:
        return False
    steps = _NO_BRACKET.sub("", s).encode().translate(_STEP)
    return max(accumulate(memoryview(steps).cast("b")), default=0) > DEPTH


def _reject(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_reject)


def load(s: str):
    """JSON without NaN and beyond-limit nesting; ValueError otherwise."""
    if _too_deep(s):
        raise ValueError("nesting")
    return _DECODER.decode(s)


def validate(root) -> list[str]:
    """Codes of what is wrong with a parsed root, in order."""
    if not isinstance(root, dict):
        return ["INVALID_ROOT_TYPE"]
    codes = [] if root.get("type") == "doc" else ["INVALID_ROOT_NODE"]
    version = root.get("version")
    number = None
    if isinstance(version, (int, float)) and not isinstance(version, bool):
        number = int(version)
    elif isinstance(version, str):
        number = t.integer(t.trim(version))
    if number is None:
        codes.append("INVALID_VERSION")
    elif number != 1:
        codes.append("UNSUPPORTED_VERSION")
    return codes if isinstance(root.get("content"), list) else [*codes, "INVALID_CONTENT"]


def parse(adf: str | None) -> tuple[list[Node] | None, list[str]]:
    """The document's blocks, None if there is no document; and codes of issues."""
    if t.blank(adf):
        return None, []
    try:
        root = load(adf)
    except (ValueError, RecursionError):
        return None, ["INVALID_JSON"]
    codes = validate(root)
    if set(codes) - {"UNSUPPORTED_VERSION"}:
        return None, codes
    return [parse_node(x, False) for x in _items(root["content"])], codes


def walk(blocks: list[Node], path: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], Node]]:
    """All nodes in document order with their paths."""
    for i, node in enumerate(blocks):
        own = (*path, i)
        yield own, node
        if node.children:
            yield from walk(node.children, own)


def each(blocks: list[Node]) -> Iterator[Node]:
    """All nodes in document order."""
    stack = blocks[::-1]
    while stack:
        node = stack.pop()
        yield node
        stack += node.children[::-1]


# ---- readings of nodes


def macro_params(node: Node) -> dict[str, str]:
    """The macro's parameters: scalars, or scalars in a value envelope."""
    parameters = node.attrs.get("parameters")
    source = parameters.get("macroParams") if isinstance(parameters, dict) else None
    out = {}
    for key, value in source.items() if isinstance(source, dict) else ():
        found = string(value.get("value") if isinstance(value, dict) else value)
        if found is not None:
            out[key] = found
    return out


def card(node: Node) -> tuple[str | None, str | None]:
    """URL and title."""
    data = node.attrs.get("data")
    data = data if isinstance(data, dict) else {}
    url = string(node.attrs.get("url"))
    return (string(data.get("url")) if t.blank(url) else url), string(data.get("name"))


#: Fields of media by our name and the attribute they come from (fixed values).
MEDIA = {
    "type": "type", "id": "id", "local_id": "localId", "url": "url", "collection": "collection", "alt": "alt", "width": "width", "height": "height",
    "media_type": "mediaType", "mime": "__fileMimeType", "file_name": "__fileName", "name": "name",
}
_FIELD_OF = {a: k for k, a in MEDIA.items()}
_NO_MEDIA = dict.fromkeys(MEDIA)
#: Types of extensions (fixed values).
MIGRATION, MACRO, CHART = "com.atlassian.confluence.migration", "com.atlassian.confluence.macro.core", "com.atlassian.chart"


def media(node: Node) -> dict[str, str | None] | None:
    """Fields of a media node, or of the migration macro that stands for one; None for other nodes."""
    if node.type in ("media", "mediaInline"):
        return _NO_MEDIA | {_FIELD_OF[a]: string(v) for a, v in node.attrs.items() if a in _FIELD_OF}
    if node.type in EXTENSIONS and string(node.attrs.get("extensionType")) == MIGRATION and string(node.attrs.get("extensionKey")) == "inline-media-image":
        p = node.attrs.get("parameters")
        own = {k: t.clean(string(p.get(k))) if not isinstance(p.get(k), bool) else None for k in ("id", "collection", "alt", "width", "height")} if isinstance(p, dict) else {}
        if own.get("id"):
            return dict.fromkeys(MEDIA) | own | {"type": "file", "media_type": "image"}
    return None


#: URLs of pages, the page id in the group (fixed value).
PAGE_URL = re.compile(r"(?:https?://[^/]+)?(?:/wiki)?(?:/spaces/[^/]+)?/pages/(?:edit-v[0-9]+/)?([0-9]+)(?:/[^?#]*)?(?:\?.*)?(?:#.*)?", re.I)


def page_id(url: str | None, attrs: dict) -> str | None:
    """The page a link points at: by its URL, else by its metadata."""
    url = t.clean(url)
    if url is None or url == "#":
        return None
    m = PAGE_URL.fullmatch(url)
    if m:
        return m[1]
    meta = attrs.get("__confluenceMetadata")
    return t.first_clean(*(string(meta.get(k)) for k in ("pageId", "contentId", "id"))) if isinstance(meta, dict) else None


def anchor_of(content: list[Node]) -> str | None:
    """The id of a heading's first anchor macro that has one."""
    for node in content:
        if is_anchor(node):
            p = macro_params(node)
            found = t.first_clean(p.get(""), p.get("legacyAnchorId"))
            if found:
                return found
    return None


def is_anchor(node: Node) -> bool:
    return node.type == "inlineExtension" and string(node.attrs.get("extensionType")) == MACRO and string(node.attrs.get("extensionKey")) == "anchor"


def heading_content(content: list[Node]) -> list[Node]:
    """Without line breaks around it, then without anchor macros."""
    kept = list(content)
    while kept and kept[0].type == "hardBreak" and kept[0].known:
        kept.pop(0)
    while kept and kept[-1].type == "hardBreak" and kept[-1].known:
        kept.pop()
    return [n for n in kept if not is_anchor(n)]


def image_alt(m: dict) -> str:
    return t.first(m["alt"], m["file_name"], m["name"]) or "media"


def mention_text(node: Node) -> str:
    return t.strip(string(node.attrs.get("text")) or "")


def heading_text(content: list[Node]) -> str:
    """A heading's plain text; fragments that would fuse get a space between them."""
    out = ""
    for n in heading_content(content):
        if not n.known:
            continue
        a = n.attrs
        if n.type == "text":
            piece = n.text
        elif n.type == "hardBreak":
            piece = " "
        elif n.type == "emoji":
            piece = t.first(string(a.get("text")), string(a.get("shortName"))) or ""
        elif n.type == "mention":
            piece = mention_text(n)
        elif n.type == "status":
            piece = "" if t.blank(string(a.get("text"))) else f"[{string(a.get('text'))}]"
        elif n.type == "inlineCard":
            url, title = card(n)
            piece = (url if t.blank(title) else title) or ""
        elif n.type == "mediaInline":
            piece = image_alt(media(n))
        elif n.type == "date":
            piece = t.iso_date(string(a.get("timestamp")))
        elif n.type == "placeholder":
            piece = string(a.get("text")) or ""
        else:
            piece = ""
        if piece:
            fuse = out and out[-1] not in t.JVM_SPACE and piece[0] not in t.JVM_SPACE
            out += (" " if fuse else "") + piece
    return t.trim(out)


def toc_range(p: dict[str, str]) -> tuple[int, int]:
    low, high = t.integer(p.get("minLevel")), t.integer(p.get("maxLevel"))
    ends = sorted((1 if low is None else low, 6 if high is None else high))
    return t.clamp_level(ends[0]), t.clamp_level(ends[1])


def outline(blocks: list[Node]) -> tuple[list[tuple[int, str, str]], dict[int, tuple[int, str, str]], set[int]]:
    """Headings (level, text, anchor) in order, the same by node identity, and levels that tables of contents show."""
    entries, by_node, levels = [], {}, set()
    seen: dict[str, int] = {}
    for n in each(blocks):
        if n.type == "heading" and n.known:
            text = heading_text(n.children)
            if t.blank(text):
                continue
            name = anchor_of(n.children)
            if name is None:
                base = t.slug(text)
                count = seen.get(base, 0)
                seen[base] = count + 1
                name = base if not count else f"{base}-{count}"
            entries.append((t.clamp_level(integer(n.attrs.get("level"), 1)), text, name))
            by_node[id(n)] = entries[-1]
        elif n.type in ("extension", "inlineExtension") and n.known and string(n.attrs.get("extensionType")) == MACRO and string(n.attrs.get("extensionKey")) == "toc":
            low, high = toc_range(macro_params(n))
            levels.update(range(low, high + 1))
    return entries, by_node, levels
