"""Operator 8: personal data.

Base kinds are patterns with checks.  Beyond them a character-level
bidirectional LSTM with CRF transitions, trained here in numpy on labelled
spans, tags text around digits and at-signs: a span of any kind has one of
these, so text without them can have no tag but O and is never looked at.
Overlapping windows are scored, their scores at a character are blended
(centre-weighted), and one Viterbi pass over the whole stretch reconciles them.
Decoded spans that touch a base span, lack their kind's digits or, as cards,
fail the checksum are dropped.

Null and empty texts have no spans.  Very long texts are searched in stretches
around their digits and at-signs, in whole, and numbers may have any length.
Repeated rows and ties get a row each.  Empty tables give no rows.  Extra
columns don't matter.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

KINDS = ("email", "ip", "card", "phone")

# ---- base kinds; matches begin where a run begins, which is what leftmost matches do

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def small(digits: str) -> bool:
    """Whether a number of any length is at most 255."""
    own = digits.lstrip("0")
    return len(own) <= 3 and int(own or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        start = at
        while start > end and text[start - 1] in LOCAL_SET:
            start -= 1
        if m and start < at:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    found = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(small(p) for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


# ---- the tagger

#: Signs with a class of their own (fixed value); digits, letters of either case, non-ASCII and other signs follow.
SIGNS = " \n@.-+()_/:,\"'%=#|[]"
CLASSES = len(SIGNS) + 6
TAGS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind
LENGTH, STRIDE, MARGIN = 64, 32, 24
_TABLE = np.full(128, len(SIGNS) + 5, np.int64)
_TABLE[[ord(c) for c in SIGNS]] = np.arange(1, len(SIGNS) + 1)
_TABLE[48:58] = len(SIGNS) + 1
_TABLE[97:123] = len(SIGNS) + 2
_TABLE[65:91] = len(SIGNS) + 3


def classes(text: str) -> np.ndarray:
    """A class for each code point; 0 is kept for padding."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(code < 128, _TABLE[np.minimum(code, 127)], len(SIGNS) + 4)


def allowed() -> np.ndarray:
    """Transitions that tags admit: inside follows begin or inside of its kind alone."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _lse(x, axis):
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Embedding, one LSTM a direction, linear scores and CRF transitions."""

    def __init__(self, seed: int = 7, width: int = 10, hidden: int = 16):
        r = np.random.default_rng(seed)
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2] if len(s) > 1 else 1)).astype(np.float32)
        self.hidden = hidden
        self.p = {
            "emb": init(CLASSES + 1, width), "wx": init(2, width, 4 * hidden), "wh": init(2, hidden, 4 * hidden) * 0.7, "b": np.zeros((2, 1, 4 * hidden), np.float32),
            "out": init(2 * hidden, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32),
        }
        self.p["b"][:, :, hidden : 2 * hidden] = 1
        self.block = np.where(allowed(), 0, -1e4).astype(np.float32)
        self.first = np.array([0 if t == 0 or t % 2 else -1e4 for t in range(TAGS)], np.float32)

    def scores(self, ids: np.ndarray, keep: bool = False):
        """Scores (windows, length, tags)."""
        p, n = self.p, self.hidden
        x = p["emb"][ids].transpose(1, 0, 2)  # time first
        both = np.stack([x, x[::-1]], 1)  # time, direction, window, width
        z = both @ p["wx"] + p["b"]
        steps, windows = ids.shape[1], ids.shape[0]
        h = np.zeros((2, windows, n), np.float32)
        c = np.zeros_like(h)
        hs, gates, cells = np.empty((steps, 2, windows, n), np.float32), [], []
        for t in range(steps):
            g = z[t] + h @ p["wh"]
            i, f, o = _sigmoid(g[..., :n]), _sigmoid(g[..., n : 2 * n]), _sigmoid(g[..., 2 * n : 3 * n])
            u = np.tanh(g[..., 3 * n :])
            before = c
            c = f * c + i * u
            tc = np.tanh(c)
            h = o * tc
            hs[t] = h
            if keep:
                gates.append((i, f, o, u, tc))
                cells.append(before)
        joined = np.concatenate([hs[:, 0], hs[::-1, 1]], -1)
        e = (joined @ p["out"] + p["bias"]).transpose(1, 0, 2)
        return (e, (ids, both, hs, gates, cells, joined)) if keep else e

    def loss(self, ids: np.ndarray, tags: np.ndarray):
        """Mean negative log-likelihood and gradients."""
        e, (ids, both, hs, gates, cells, joined) = self.scores(ids, True)
        windows, steps, _ = e.shape
        trans = self.p["trans"] + self.block
        alpha = np.empty_like(e)
        alpha[:, 0] = e[:, 0] + self.first
        for t in range(1, steps):
            alpha[:, t] = e[:, t] + _lse(alpha[:, t - 1, :, None] + trans, 1)
        beta = np.zeros_like(e)
        for t in range(steps - 2, -1, -1):
            beta[:, t] = _lse(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = _lse(alpha[:, -1], 1)
        marginal = np.exp(alpha + beta - z[:, None, None])
        pair = np.exp(alpha[:, :-1, :, None] + trans + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        rows, cols = np.arange(windows)[:, None], np.arange(steps)
        gold = e[rows, cols, tags].sum(1) + trans[tags[:, :-1], tags[:, 1:]].sum(1)
        g = {"trans": pair.sum((0, 1)) / windows}
        np.add.at(g["trans"], (tags[:, :-1], tags[:, 1:]), -1 / windows)
        de = marginal
        de[rows, cols, tags] -= 1
        de = (de / windows).transpose(1, 0, 2)
        g["bias"] = de.sum((0, 1))
        g["out"] = np.einsum("tbh,tbk->hk", joined, de)
        dj = de @ self.p["out"].T
        n = self.hidden
        dhs = np.stack([dj[..., :n], dj[::-1, :, n:]], 1)
        dh = np.zeros_like(hs[0])
        dc = np.zeros_like(dh)
        dz = np.empty((steps, 2, windows, 4 * n), np.float32)
        whT = self.p["wh"].transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            i, f, o, u, tc = gates[t]
            dh = dh + dhs[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz[t] = np.concatenate([dc * u * i * (1 - i), dc * cells[t] * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], -1)
            dc = dc * f
            dh = dz[t] @ whT
        earlier = np.concatenate([np.zeros_like(hs[:1]), hs[:-1]])
        g["wh"] = np.einsum("tdbh,tdbk->dhk", earlier, dz, optimize=True)
        g["wx"] = np.einsum("tdbw,tdbk->dwk", both, dz, optimize=True)
        g["b"] = dz.sum((0, 2))[:, None]
        dx = dz @ self.p["wx"].transpose(0, 2, 1)
        dx = dx[:, 0] + dx[::-1, 1]
        g["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(g["emb"], ids.T, dx)
        return float((z - gold).mean()), g

    def fit(self, ids: np.ndarray, tags: np.ndarray, rounds: int = 8, size: int = 32, rate: float = 0.02, seed: int = 3) -> float:
        """Adam over shuffled batches; the last round's mean loss."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, mean = 0, 0.0
        for turn in range(rounds):
            order, mean = r.permutation(len(ids)), 0.0
            for a in range(0, len(ids), size):
                at = order[a : a + size]
                loss, g = self.loss(ids[at], tags[at])
                mean += loss * len(at) / len(ids)
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                step += 1
                for k in self.p:
                    x = g[k] * min(1.0, 5.0 / norm)
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    pace = rate * (1 - turn / rounds * 0.8)
                    self.p[k] -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return mean

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        trans = self.p["trans"] + self.block
        back = np.empty((len(e), TAGS), np.int64)
        best = e[0] + self.first
        for t in range(1, len(e)):
            x = best[:, None] + trans
            back[t] = x.argmax(0)
            best = x.max(0) + e[t]
        tags = np.empty(len(e), np.int64)
        tags[-1] = best.argmax()
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags


# ---- labelled spans to train on


def samples(number: int = 1600, seed: int = 11) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """Made-up texts of LENGTH characters with their spans (start, kind, end), from forms of personal data and of look-alikes."""
    r = np.random.default_rng(seed)
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    pick = lambda *x: x[r.integers(len(x))]
    letters = "etaoinshrdlucmwfgypbvkéèüöäñó"

    def word() -> str:
        w = "".join(letters[i] for i in np.minimum(r.geometric(0.12, r.integers(1, 10)) - 1, len(letters) - 1))
        return pick(w, w, w, w.capitalize(), w.upper())

    def personal(kind: int) -> str:
        if kind == 0:
            plain = lambda: re.sub("[^A-Za-z]", "x", word())
            name = plain() + pick("", ".", "_", "-") + pick(plain(), digits(2), "")
            return name.rstrip("._-") + pick("@", "@", "@", " @ ", "@ ") + plain() + pick("", digits(1)) + "." + pick("com", "org", "net", "example.com", "co.uk")
        if kind == 1:
            return ".".join(str(x) for x in r.integers(1, 256, 4))
        if kind == 2:
            sep = pick("", "", " ", "-", ".")
            groups = [4, 4, 4, 4] if r.random() < 0.8 else [4, 6, 5]
            body = digits(sum(groups) - 1)
            body += next(str(d) for d in range(10) if luhn(body + str(d)))
            return sep.join(body[sum(groups[:i]) : sum(groups[: i + 1])] for i in range(len(groups)))
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"+{digits(pick(1, 2))} ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"0{digits(2)} {digits(3)} {digits(4)}", f"{a}.{b}.{c}", f"00{digits(2)} {a} {b} {c}")

    def other() -> str:
        h = "".join("0123456789abcdef"[i] for i in r.integers(0, 16, pick(8, 16, 32, 40)))
        return pick(
            f'token = "{h}"', h, f"version {digits(1)}.{digits(1)}", f"BY-NC {digits(1)}.0.", f"{pick('19', '20')}{digits(2)}", digits(pick(1, 2, 3, 5, 6)), f"{digits(2)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}",
            f"{pick('19', '20')}{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"${digits(3)}.{digits(2)}", f"{digits(2)}%", f"@{word()}", f"1,{digits(3)},{digits(3)}", f"#{digits(4)}", f"{digits(6)}-{word()}",
            f"{digits(1)}.{digits(2)}.{digits(1)}.{digits(4)}", f"{digits(8)}", f"{digits(5)}-{digits(4)}", f"{digits(pick(20, 24))}",
        )

    texts, spans = [], []
    for _ in range(number):
        text, own = "", []
        mark = pick("", "", "", "!!", "###", "|")
        while len(text) < 2 * LENGTH:
            if r.random() < 0.12:
                kind = int(r.integers(0, 4))
                x = personal(kind)
                own.append((len(text), kind, len(text) + len(x)))
            else:
                x = other() if r.random() < 0.12 else word()
            text += x + pick(mark, mark, ",", ".", "") + pick(" ", " ", " ", " ", "\n", " | ")
        at = int(r.integers(0, len(text) - LENGTH))
        texts.append(text[at : at + LENGTH])
        spans.append([(a - at, k, b - at) for a, k, b in own if b > at and a < at + LENGTH])
    return texts, spans


def tagged(spans: list[tuple[int, int, int]], length: int) -> np.ndarray:
    """Tags of a window; a span that began before it goes on inside only if its begin can be kept on the first character."""
    tags = np.zeros(length, np.int64)
    for a, kind, b in spans:
        lo, hi = max(a, 0), min(b, length)
        tags[lo:hi] = 2 + 2 * kind
        tags[lo] = 1 + 2 * kind
    return tags


_trained: dict[int, Tagger] = {}


def trained(number: int = 1600) -> Tagger:
    """The tagger trained on ``number`` made-up windows; the same in every process."""
    if number not in _trained:
        texts, spans = samples(number)
        tagger = Tagger()
        tagger.fit(np.stack([classes(t) for t in texts]), np.stack([tagged(s, LENGTH) for s in spans]))
        _trained[number] = tagger
    return _trained[number]


# ---- decoding


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Parts of a text within MARGIN of a digit or an at-sign."""
    at = np.flatnonzero((ids == len(SIGNS) + 1) | (ids == SIGNS.index("@") + 1))
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 2 * MARGIN)
    firsts, lasts = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
    return [(max(0, int(a) - MARGIN), min(len(ids), int(b) + MARGIN + 1)) for a, b in zip(firsts, lasts, strict=True)]


_WEIGHT = np.minimum(np.arange(1, LENGTH + 1), np.arange(LENGTH, 0, -1)).astype(np.float32)


def decode(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans (start, kind, end) of each text; windows of all texts are scored together."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    parts, windows = [], []
    for i, text in enumerate(texts):
        ids = classes(text)
        for a, b in stretches(ids):
            begins = list(range(0, max(1, b - a - STRIDE), STRIDE))
            parts.append((i, a, b, len(windows), begins))
            for s in begins:
                w = np.zeros(LENGTH, np.int64)
                piece = ids[a + s : min(b, a + s + LENGTH)]
                w[: len(piece)] = piece
                windows.append(w)
    if not windows:
        return found
    stacked = np.stack(windows)
    lone, place = np.unique(stacked, axis=0, return_inverse=True)
    place = place.reshape(-1)
    e = np.concatenate([tagger.scores(lone[k : k + 512]) for k in range(0, len(lone), 512)])
    for i, a, b, first, begins in parts:
        total = np.zeros((b - a + LENGTH, TAGS), np.float32)
        weight = np.zeros((b - a + LENGTH, 1), np.float32)
        for k, s in enumerate(begins):
            total[s : s + LENGTH] += e[place[first + k]] * _WEIGHT[:, None]
            weight[s : s + LENGTH, 0] += _WEIGHT
        tags = tagger.viterbi((total / np.maximum(weight, 1e-6))[: b - a])
        for start in np.flatnonzero(tags % 2 == 1).tolist():
            kind, end = int(tags[start]) // 2, start + 1
            while end < len(tags) and tags[end] == tags[start] + 1:
                end += 1
            if plausible(kind, texts[i][a + start : a + end]):
                found[i].append((a + start, kind, a + end))
    return found


def plausible(kind: int, text: str) -> bool:
    digits = sum("0" <= c <= "9" for c in text)
    if kind == 0:
        return re.fullmatch(r"[^\s@]+ ?@ ?[^\s@]+\.[A-Za-z]{2,}", text) is not None
    if kind == 1:
        return re.fullmatch(r"(?:[0-9]{1,3}[. :]){3}[0-9]{1,3}", text) is not None and all(map(small, re.findall("[0-9]+", text)))
    if kind == 2:  # a run that fails the checksum is some other number
        return 13 <= digits <= 19 and re.fullmatch(r"[0-9](?:[ .-]?[0-9])+", text) is not None and luhn(re.sub("[^0-9]", "", text))
    return 9 <= digits <= 15 and re.fullmatch(r"[+(0-9][0-9 ().-]*[0-9]", text) is not None and re.search("[ ().+-]", text) is not None


def spans_of(tagger: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    out = []
    for text, more in zip(texts, decode(tagger, texts), strict=True):
        base = base_spans(text)
        extra = [x for x in more if not any(a < x[2] and x[0] < b for a, _, b in base) and not _inside_word(text, x)]
        out.append((base, sorted(base + extra)))
    return out


def _inside_word(text: str, span: tuple[int, int, int]) -> bool:
    """Whether letters or digits go on beyond the span."""
    a, _, b = span
    return (a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum())


SPANS = "array<struct<start:int,kind:int,end:int>>"


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns ``keep``, base and spans: arrays of (start, kind, end) in code points."""
    tagger = docs.sparkSession.sparkContext.broadcast(trained())
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    struct = lambda spans: [{"start": a, "kind": k, "end": b} for a, k, b in spans]

    def run(batches):
        import pyarrow.compute as pc

        for whole in batches:
            for batch in shared.slices(whole, "text", 4 << 20):
                text = pc.fill_null(batch.column(batch.schema.get_field_index("text")), "")
                on = np.flatnonzero(pc.match_substring_regex(text, "[0-9@]").to_numpy(zero_copy_only=False))
                some = dict(zip(on.tolist(), spans_of(tagger.value, text.take(pa.array(on)).to_pylist()), strict=True))
                both = [some.get(i, ((), ())) for i in range(batch.num_rows)]
                columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([struct(b) for b, _ in both], kind), pa.array([struct(s) for _, s in both], kind)], names=[*keep, "base", "spans"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{kinds}, base {SPANS}, spans {SPANS}")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind in brackets."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with personal data in ``text`` replaced; all columns stay, nulls too."""
    tagger = docs.sparkSession.sparkContext.broadcast(trained())
    schema = docs.schema

    def run(batches):
        import pyarrow.compute as pc

        for whole in batches:
            for batch in shared.slices(whole, column, 4 << 20):
                at = batch.schema.get_field_index(column)
                text = batch.column(at)
                on = np.flatnonzero(pc.fill_null(pc.match_substring_regex(text, "[0-9@]"), False).to_numpy(zero_copy_only=False))
                if len(on):
                    old = text.take(pa.array(on)).to_pylist()
                    new = [masked(t, s) for t, (_, s) in zip(old, spans_of(tagger.value, old), strict=True)]
                    hit = np.zeros(batch.num_rows, bool)
                    hit[on] = True
                    text = pc.replace_with_mask(text, pa.array(hit), pa.array(new, text.type))
                yield batch.set_column(at, batch.schema.field(at), text)

    return docs.mapInArrow(run, schema)


def written(spans: str):
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(shared.table(spark, sf_dir, "documents"))

    def number(kind: int):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", *[number(k) for k in range(4)], F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
