"""HTML for tables that pipes can't show, and the small Markdown reader for their cells."""

from __future__ import annotations

import re
from dataclasses import replace

from docspark.functions import text as t

#: Characters that are cleaned before Markdown is read again (fixed values).
CLEAN = str.maketrans({"\u00a0": " ", "\u202f": " ", "\u2003": " ", "\u2028": "\n", "\u200b": None, "\u2060": None, "\u009d": None, "\u00ad": None})


def table(fold, rows: list, at, numbered: bool) -> str:
    from docspark.plans.render import header_row, span

    out, number = [], 0
    for r in rows:
        cells = ""
        if numbered:
            head = header_row(r)
            number += not head
            cells = "<th></th>" if head else f"<td>{number}</td>"
        for c in r.children:
            tag = "th" if c.type == "tableHeader" else "td"
            spans = "".join(f' {k}="{span(c, k)}"' for k in ("colspan", "rowspan") if span(c, k) > 1)
            cells += f"<{tag}{spans}>{content(fold, c.children, replace(at, cell='html'))}</{tag}>"
        out.append(f"<tr>{cells}</tr>")
    return f"<table>{''.join(out)}</table>"


def content(fold, blocks: list, at) -> str:
    parts = (block(fold, b, at) for b in blocks)
    return "<br>".join(p for p in parts if not t.blank(p))


def block(fold, b, at) -> str:
    if b.known and b.type in ("bulletList", "orderedList"):
        deeper = replace(at, depth=at.depth + 1)
        items = [content(fold, x.children, deeper) for x in b.children]
        tag = "ol" if b.type == "orderedList" else "ul"
        inner = "".join(f"<li>{s}</li>" for s in items if s)
        return f"<{tag}>{inner}</{tag}>" if inner else ""
    return fragment(t.trim(t.join_blocks(fold.block(b, at))))


def fragment(markdown: str) -> str:
    """HTML of a cell's Markdown; a single paragraph without its tags, its lines parted by <br>."""
    if t.blank(markdown):
        return ""
    html = t.strip("\n".join(blocks(t.lines(markdown.translate(CLEAN)))))
    if html.startswith("<p>") and html.endswith("</p>"):
        return html[3:-4].replace("\n", "<br>")
    return html


_FENCE = re.compile(r"(`{3,})([^`]*)$")
_ITEM = re.compile(r"( {0,3})(?:([-+*])|([0-9]{1,9})[.)])(?: +|$)")


def blocks(source: list[str]) -> list[str]:
    """Block structure: fences, headings, rules, quotes with alerts, lists, raw HTML and paragraphs."""
    out: list[str] = []
    k = 0
    while k < len(source):
        line = source[k]
        fence = _FENCE.match(line)
        item = _ITEM.match(line)
        if t.blank(line):
            k += 1
        elif fence:
            end = next((i for i in range(k + 1, len(source)) if re.fullmatch(rf"{fence[1]}`*\s*", source[i])), len(source))
            kind = f' class="language-{t.html_text(fence[2].split()[0])}"' if fence[2].strip() else ""
            body = "".join(t.html_text(x) + "\n" for x in source[k + 1 : end])
            out.append(f"<pre><code{kind}>{body}</code></pre>")
            k = end + 1
        elif m := re.match(r"(#{1,6})(?: +(.*?))?(?: +#+)? *$", line):
            level, words = len(m[1]), m[2] or ""
            out.append(f'<h{level} id="{t.slug(re.sub(r"[*_`~]", "", words))}">{inline(words)}</h{level}>')
            k += 1
        elif re.fullmatch(r" {0,3}(?:-{3,}|\*{3,}|_{3,})\s*", line):
            out.append("<hr />")
            k += 1
        elif line.startswith(">"):
            end = next((i for i in range(k, len(source)) if not source[i].startswith(">")), len(source))
            inner = [re.sub("^> ?", "", x) for x in source[k:end]]
            out.append(quote(inner))
            k = end
        elif item:
            made, k = items(source, k)
            out.append(made)
        elif line.startswith("<") and re.match(r"</?(?:details|summary|div|table|tr|td|th|a )", line):
            end = next((i for i in range(k, len(source)) if t.blank(source[i])), len(source))
            out.append("\n".join(source[k:end]))
            k = end
        else:
            end = next((i for i in range(k + 1, len(source)) if t.blank(source[i]) or _FENCE.match(source[i]) or source[i].startswith(">") or re.match(r"#{1,6} ", source[i]) or re.match(r"(?:[-+*]|1[.)]) +\S", source[i])), len(source))
            out.append(f"<p>{inline(chr(10).join(x.lstrip(' ') for x in source[k:end]).rstrip())}</p>")
            k = end
    return out


def quote(inner: list[str]) -> str:
    m = re.fullmatch(r"\[!(NOTE|TIP|IMPORTANT|WARNING|CAUTION)\]\s*", inner[0]) if inner else None
    if m:
        name = m[1].lower()
        body = "\n".join(blocks(inner[1:]))
        return f'<div class="markdown-alert markdown-alert-{name}">\n<p class="markdown-alert-title">{name.capitalize()}</p>\n{body}\n</div>'
    body = "\n".join(blocks(inner))
    return f"<blockquote>\n{body}\n</blockquote>"


def items(source: list[str], k: int) -> tuple[str, int]:
    """A list from line k on, and the line after it."""
    first = _ITEM.match(source[k])
    ordered = first[3] is not None
    entries: list[list[str]] = []
    loose = False
    while k < len(source):
        m = _ITEM.match(source[k])
        if m and (m[3] is not None) == ordered and len(m[1]) <= 3:
            width = m.end()
            entries.append([source[k][width:]])
            k += 1
            while k < len(source) and (t.blank(source[k]) or source[k].startswith(" " * width)):
                entries[-1].append(source[k][width:] if not t.blank(source[k]) else "")
                k += 1
            if entries[-1][-1] == "":
                loose = loose or k < len(source) and bool(_ITEM.match(source[k]))
        elif not m and not t.blank(source[k]) and entries and entries[-1][-1] != "":
            entries[-1].append(source[k])
            k += 1
        else:
            break
    made = []
    for e in entries:
        task = re.match(r"\[([ xX])\] +", e[0])
        box = ""
        if task:
            box = f'<input type="checkbox" disabled=""{"" if task[1] == " " else " checked=" + chr(34) * 2}> '
            e = [e[0][task.end() :], *e[1:]]
        inner = "\n".join(blocks(e))
        if not loose:
            inner = re.sub(r"<p>(.*?)</p>", r"\1", inner, flags=re.S)
        made.append(f"<li>{box}{inner}</li>")
    tag = "ol" if ordered else "ul"
    start = f' start="{first[3]}"' if ordered and first[3] != "1" else ""
    return f"<{tag}{start}>\n" + "\n".join(made) + f"\n</{tag}>", k


_INLINE = re.compile(
    r"(?P<escaped>\\[!-/:-@\[-`{-~])|(?P<hard>(?: {2,}|\\)\n)|(?P<ticks>`+)|(?P<auto><[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*>)|(?P<tag></?[A-Za-z][^<>]*>)"
    r"|(?P<entity>&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)|(?P<image>!\[)|(?P<open>\[)|(?P<run>\*+|~~)"
)


def _target(s: str, at: int) -> tuple[str, str | None, int] | None:
    """Destination, title and end of "(…)" at a place."""
    m = re.compile(r"\((?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+\"((?:[^\"\\]|\\.)*)\")?\s*\)").match(s, at)
    if not m:
        return None
    plain = lambda x: re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", x)
    return plain(m[1] if m[1] is not None else m[2]), None if m[3] is None else plain(m[3]), m.end()


def _close(s: str, at: int) -> int | None:
    """The bracket that closes one opened before ``at``."""
    depth = 1
    for m in re.compile(r"\\.|`[^`]*`|[\[\]]", re.S).finditer(s, at):
        depth += {"[": 1, "]": -1}.get(m[0], 0)
        if not depth:
            return m.start()
    return None


def _safe(url: str) -> str:
    m = re.match(r"\s*([A-Za-z][A-Za-z0-9+.-]*):", url)
    return "" if m and m[1].lower() not in t.SAFE_SCHEMES else url.replace("&", "&amp;").replace('"', "%22").replace(" ", "%20")


def inline(s: str) -> str:
    """Inline structure: escapes, code, links, images, emphasis and raw tags."""
    out: list[str] = []
    runs: list[tuple[str, int]] = []  # delimiters that may open, by their place in out
    at = 0
    while at < len(s):
        m = _INLINE.search(s, at)
        if not m:
            out.append(t.html_text(s[at:]))
            break
        out.append(t.html_text(s[at : m.start()]))
        at = m.end()
        kind = m.lastgroup
        if kind == "escaped":
            out.append(t.html_text(m[0][1]))
        elif kind == "hard":
            out.append("<br />\n")
        elif kind == "ticks":
            end = next((x for x in re.compile("`+").finditer(s, at) if len(x[0]) == len(m[0])), None)
            if end:
                body = s[at : end.start()].replace("\n", " ")
                body = body[1:-1] if len(body) > 2 and body[0] == body[-1] == " " and body.strip() else body
                out.append(f"<code>{t.html_text(body)}</code>")
                at = end.end()
            else:
                out.append(m[0])
        elif kind == "auto":
            out.append(f'<a href="{_safe(m[0][1:-1])}">{t.html_text(m[0][1:-1])}</a>')
        elif kind in ("tag", "entity"):
            out.append(m[0])
        elif kind in ("image", "open"):
            end = _close(s, at)
            target = _target(s, end + 1) if end is not None else None
            if target is None:
                out.append(m[0])
                continue
            url, title, stop = target
            extra = "" if title is None else f' title="{t.html_text(title)}"'
            inner = inline(s[at:end])
            if kind == "image":
                sizes = re.compile(r"\{((?:width|height)=[0-9]+(?: (?:width|height)=[0-9]+)*)\}").match(s, stop)
                size = "".join(f' {k}="{v}"' for k, v in (x.split("=") for x in sizes[1].split())) if sizes else ""
                out.append(f'<img src="{_safe(url)}" alt="{re.sub("<[^>]*>", "", inner)}"{extra}{size} />')
                stop = sizes.end() if sizes else stop
            else:
                out.append(f'<a href="{_safe(url)}"{extra}>{inner}</a>')
            at = stop
        else:
            _delimit(out, runs, m[0], s, m.start(), m.end())
    return "".join(out)


def _delimit(out: list[str], runs: list[tuple[str, int]], run: str, s: str, a: int, b: int) -> None:
    """A run of delimiters closes earlier ones where it can, and else may open."""
    left = s[a - 1] if a else " "
    right = s[b] if b < len(s) else " "
    closes, opens = not left.isspace(), not right.isspace()
    sign, count = run[0], len(run)
    while closes and count and any(r[0] == sign for r, _ in runs):
        k = max(i for i, (r, _) in enumerate(runs) if r[0] == sign)
        mark, place = runs[k]
        size = 2 if len(mark) >= 2 and count >= 2 else 1
        if sign == "~" and size == 1:
            break
        tag = "del" if sign == "~" else "strong" if size == 2 else "em"
        del runs[k:]
        if len(mark) > size:
            runs.append((mark[size:], place))
            out[place] = mark[size:]
            out.insert(place + 1, f"<{tag}>")
        else:
            out[place] = f"<{tag}>"
        out.append(f"</{tag}>")
        count -= size
    if count:
        out.append(sign * count)
        if opens:
            runs.append((sign * count, len(out) - 1))
