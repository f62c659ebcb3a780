"""Text rules of Markdown output, as plain functions for the per-document fold.

White space follows the JVM: ``strip`` and ``blank`` leave no-break spaces
alone, ``trim`` takes everything up to U+0020.
"""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import quote

#: JVM white space (fixed value): separators without the no-break ones, and controls.
JVM_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2008\u2009\u200a\u2028\u2029\u205f\u3000"
TRIM_SPACE = "".join(map(chr, range(33)))
#: Any line break (fixed value).
BREAK = re.compile("\r\n|[\n\x0b\x0c\r\x85\u2028\u2029]")
_SPACE_RUN = re.compile("[ \t\n\x0b\x0c\r]+")


def strip(s: str) -> str:
    return s.strip(JVM_SPACE)


def rstrip(s: str) -> str:
    return s.rstrip(JVM_SPACE)


def trim(s: str) -> str:
    return s.strip(TRIM_SPACE)


def blank(s: str | None) -> bool:
    return not s or not s.strip(JVM_SPACE)


def lines(s: str) -> list[str]:
    return BREAK.split(s)


def one_line(s: str) -> str:
    return BREAK.sub(" ", s)


def squeeze(s: str) -> str:
    return _SPACE_RUN.sub(" ", s)


def clean(s: str | None) -> str | None:
    """Stripped, or None when nothing is left."""
    return (strip(s) or None) if s is not None else None


def first(*values: str | None) -> str | None:
    """The first that isn't blank, as it is."""
    return next((v for v in values if not blank(v)), None)


def first_clean(*values: str | None) -> str | None:
    found = first(*values)
    return None if found is None else strip(found)


def utf16_length(s: str) -> int:
    return len(s) + sum(c > "\uffff" for c in s)


# ---- escapes

_ALWAYS = re.compile(r"[\\`*\[\]~<&!_]")
_WITH_PARENS = re.compile(r"[\\`*\[\]~<&!_()]")
#: What a line may not begin with: indented code, or a block marker after up to three spaces.
_LEADING = re.compile(r"(?P<code>\t| (?= {3}))|(?P<gap> {0,3})(?:(?P<mark>[#>+-])|(?P<digits>[0-9]+)(?P<stop>[.)]))")


def _wordlike(c: str) -> bool:
    """A letter or decimal digit of the basic plane."""
    return c <= "\uffff" and (unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd")


def escape_signs(s: str, parens: bool = False) -> str:
    """A backslash before each sign that inline Markdown may read; underscores inside words stay."""

    def put(m: re.Match) -> str:
        a, b = m.span()
        if m[0] == "_" and 0 < a and b < len(s) and _wordlike(s[a - 1]) and _wordlike(s[b]):
            return "_"
        return "\\" + m[0]

    return (_WITH_PARENS if parens else _ALWAYS).sub(put, s)


def escape_start(line: str) -> str:
    """The line, unable to begin a block."""
    m = _LEADING.match(line)
    if not m:
        return line
    if m["code"]:
        return "&#32;" + line[1:]
    if m["mark"]:
        return f"{m['gap']}\\{line[m.start('mark') :]}"
    return f"{m['gap']}{m['digits']}\\{line[m.start('stop') :]}"


def escape(s: str | None, at_start: bool = False, parens: bool = False) -> str:
    """Literal text as inline Markdown; lines after the first always begin at a line's start."""
    done = escape_signs(s or "", parens)
    if "\n" not in done and "\r" not in done:
        return escape_start(done) if at_start else done
    head, *rest = lines(done)
    return "\n".join([escape_start(head) if at_start else head, *map(escape_start, rest)])


def token(label: str | None, parens: bool = False) -> str:
    return escape(f"[{label or ''}]", False, parens)


def longest_ticks(s: str | None) -> int:
    return max((len(m) for m in re.findall("`+", s or "")), default=0)


def fence(body: str | None, language: str | None = None) -> str:
    ticks = "`" * max(3, longest_ticks(body) + 1)
    info = strip(one_line((language or "").replace("`", "")))
    return rstrip(f"{rstrip(ticks + info)}\n{body or ''}\n{ticks}")


def code_span(s: str | None) -> str:
    s = s or ""
    ticks = "`" * (longest_ticks(s) + 1)
    pad = " " if s[:1] == "`" or s[-1:] == "`" else ""
    return f"{ticks}{pad}{s}{pad}{ticks}"


def escape_alt(s: str | None, parens: bool = False) -> str:
    return re.sub(r"[\[\]()]" if parens else r"[\[\]]", r"\\\g<0>", s or "")


# ---- links

#: Schemes that destinations may have (fixed value).
SAFE_SCHEMES = frozenset("http https mailto tel ftp ftps media attachment".split())
_SCHEME = re.compile(r"[\x00-\x20]*(?P<name>[A-Za-z\t\n\r](?:[A-Za-z0-9+.\-\t\n\r])*)?:")
_DESTINATION = {" ": "%20", "(": "%28", ")": "%29", "<": "%3C", ">": "%3E", "\n": "%0A", "\r": "%0D"}


def _balanced(s: str) -> bool:
    depth = 0
    for c in s:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return False
    return depth == 0


def defuse(url: str) -> str:
    """A URL whose scheme isn't safe loses its controls and its first colon."""
    m = _SCHEME.match(url)
    if not m or (m["name"] or "").lower() in SAFE_SCHEMES:
        return url
    return re.sub(r"[\x00-\x1f\x7f]", "", url).replace(":", "%3A", 1)


def destination(url: str | None) -> str | None:
    """A URL for the round brackets of a link."""
    if blank(url):
        return url
    url = defuse(url)
    if re.search(r"[<>\n\r]", url):
        return re.sub(r"[ ()<>\n\r]", lambda m: _DESTINATION[m[0]], url)
    return f"<{url}>" if re.search(r"[\x00-\x20\x7f]", url) or not _balanced(url) else url


def link_to(label: str, url: str | None, title: str | None = None) -> str:
    """A link whose label is Markdown already."""
    extra = "" if title is None else ' "' + one_line(title).replace("\\", "\\\\").replace('"', '\\"') + '"'
    target = destination(url)
    return f"[{label}]({'null' if target is None else target}{extra})"


def link(label: str | None, url: str | None, parens: bool = False) -> str:
    return link_to(escape(label, False, parens), url)


def expand_template(template: str, values: dict[str, str]) -> str:
    """A URL template: {name} becomes the percent-encoded value."""
    return re.sub(r"\{([A-Za-z]+)\}", lambda m: quote(values[m[1]], safe="") if m[1] in values else m[0], template)


# ---- HTML


def html_text(s: str | None) -> str:
    return (s or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def html_attribute(s: str) -> str:
    return s.replace("&", "&amp;").replace('"', "&quot;").replace("\u00a0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")


def anchor(name: str | None) -> str:
    return "" if blank(name) else f'<a id="{html_attribute(name)}"></a>'


# ---- blocks


def join_blocks(blocks: list[str | None]) -> str:
    return "\n\n".join(b for b in (rstrip(b) for b in blocks if b is not None) if b)


def indent(s: str | None, by: str) -> list[str]:
    if blank(s):
        return []
    return [rstrip(by) if blank(x) else by + x for x in lines(s)]


def quoted(s: str) -> str:
    return "" if blank(s) else "\n".join(">" if blank(x) else f"> {x}" for x in lines(s))


# ---- values


def clamp_level(level: int) -> int:
    return max(1, min(6, level))


def iso_date(stamp: str | None) -> str:
    """A date from epoch seconds, or milliseconds from 10^11 on; other text as it is."""
    if stamp is None:
        return ""
    raw = strip(stamp)
    if not re.fullmatch(r"[+-]?[0-9]+", raw) or not -(2**63) <= int(raw) < 2**63:
        return stamp
    n = int(raw)
    days = n // 86_400 if abs(n) < 10**11 else n // 86_400_000
    era, day = divmod(days + 719_468, 146_097)
    year_of = (day - day // 1460 + day // 36_524 - day // 146_096) // 365
    of_year = day - (365 * year_of + year_of // 4 - year_of // 100)
    month = (5 * of_year + 2) // 153
    d, m = of_year - (153 * month + 2) // 5 + 1, month + 3 if month < 10 else month - 9
    y = year_of + era * 400 + (m <= 2)
    if abs(y) > 999_999_999:
        return stamp
    year = f"{y:04d}" if 0 <= y <= 9999 else f"+{y}" if y > 0 else f"-{-y:04d}"
    return f"{year}-{m:02d}-{d:02d}"


def positive_integer(s: str | None) -> int | None:
    """A rounded positive number, or None."""
    if blank(s) or not re.fullmatch(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[fFdD]?", s.strip()):
        return None
    n = int(float(s.strip().rstrip("fFdD")) + 0.5)
    return min(n, 2**31 - 1) if n > 0 else None


def integer(s: str | None) -> int | None:
    return int(s) if s is not None and re.fullmatch(r"[+-]?[0-9]+", s) and -(2**31) <= int(s) < 2**31 else None


#: Media types by extension (fixed values).
MEDIA_TYPES = {
    "bmp": "image/bmp", "csv": "text/csv", "gif": "image/gif", "gz": "application/gzip", "htm": "text/html", "html": "text/html", "jpe": "image/jpeg", "jpeg": "image/jpeg",
    "jpg": "image/jpeg", "mpeg": "video/mpeg", "mpg": "video/mpeg", "tar": "application/x-tar", "tif": "image/tiff", "tiff": "image/tiff", "wav": "audio/x-wav", "json": "application/json", "md": "text/markdown", "pdf": "application/pdf", "png": "image/png",
    "svg": "image/svg+xml", "txt": "text/plain", "webp": "image/webp", "xml": "application/xml", "zip": "application/zip",
}


def file_name(path: str | None) -> str | None:
    """The last path segment, without query and fragment."""
    if path is None:
        return None
    return re.split(r"[?#]", strip(path), maxsplit=1)[0].rpartition("/")[2] or None


def media_type(name: str | None) -> str | None:
    """By the extension of the last path segment; the same table as in SQL, whatever the machine's own."""
    name = file_name(name)
    return MEDIA_TYPES.get(name.rpartition(".")[2].lower()) if name and "." in name else None


def is_image_type(mime: str | None) -> bool | None:
    """Whether a media type is an image's; None when it doesn't say."""
    m = (clean(mime) or "").lower()
    if m == "image" or m.startswith("image/"):
        return True
    return False if "/" in m else None


def slug(heading: str) -> str:
    """The base of a heading's anchor: lower case, spaces as hyphens, word characters kept."""
    found = "".join(re.findall(r"[\w\-]+", heading.lower().replace(" ", "-")))
    return found or "section"
