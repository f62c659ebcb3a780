"""Operator 9: benchmark decontamination by winnowing.

Of the hashes of all k-grams of words, the least of every w neighbours is the
fingerprint of the window of ``WINDOW`` = w + k - 1 words around them.  Equal windows have equal fingerprints, so joining documents
and benchmark on kept fingerprints finds every shared window.  A hit is
extended to the windows that its fingerprint stands for: those whose hash of
all WINDOW words is a benchmark window's are matches, and overlapping matches
make one hit span.  Windows are compared as values and never place by place,
so a word repeated n times in a document and in an item costs n and not n * n.
Items of fewer words are one window each: for each such length all its k-grams
are looked up.

The benchmark becomes a table of distinct windows (item, words, window,
fingerprint).  Up to ``INDEX_ROWS`` rows, which is checked, each task reads it
from the shared folder and the documents go through one narrow pass; windows of
the same items share one set of them, so a passage that many items hold is
looked up once.  Beyond, the documents' windows that pass bit filters of
bounded size are joined with the table by shuffle; the benchmark's side is
spread over ``SALTS`` copies of each key, so a window that a third of all
documents hold isn't one task's.

Null and empty texts have no words; items without words match nothing.
Repeated items count once by their id, whatever its type; repeated documents
each get a row.  Very long texts are read whole, in time and memory
proportional to their length.  Ties between fingerprints are one value.
Empty tables give no rows, or no hits.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

WINDOW, K = 10, 5
W = WINDOW - K + 1
#: Rows of the benchmark's windows (some 40 bytes each) that a worker may hold.
INDEX_ROWS = 2_000_000
#: Bits of the filters beyond that, and copies of the benchmark's side of a join.
FILTER_BITS, SALTS = 27, 16


def fingerprints(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows within a text, and each one's fingerprint.

    h: word hashes of all texts; begin: the words before each text, and in all.
    """
    grams = shared.windows(h, K)
    n = len(grams) - W + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = grams[:n].copy()
    for i in range(1, W):
        np.minimum(least, grams[i : i + n], out=least)
    starts = np.flatnonzero(inside(begin, WINDOW, n))
    return starts, least[starts]


def inside(begin: np.ndarray, k: int, n: int) -> np.ndarray:
    """Whether the k words from each position on are of one text."""
    ok = np.ones(n, bool)
    for back in range(1, k):
        at = begin[1:-1] - back
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def among(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of x in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, -1)


def looked_up(h: np.ndarray, begin: np.ndarray, sizes: list[int], known, window) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Arrays (start, words, window hash, what ``window`` finds) of all windows that match.

    known(fingerprints): whether the benchmark has them; window(words, hashes):
    a number for each, or -1.
    """
    out = []
    for n in sizes:
        if n == WINDOW:
            starts, prints = fingerprints(h, begin)
            # neighbouring windows mostly have one fingerprint
            new = np.ones(len(prints), bool)
            new[1:] = prints[1:] != prints[:-1]
            starts = starts[known(prints[new])[np.cumsum(new) - 1]] if len(prints) else starts
            grams = shared.windows_at(h, n, starts)
        else:
            grams = shared.windows(h, n)
            starts = np.flatnonzero(inside(begin, n, len(grams)))
            grams = grams[starts]
        found = window(n, grams)
        on = found >= 0
        out.append((starts[on], np.full(int(on.sum()), n), grams[on], found[on]))
    none = np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none.astype(np.uint64), none)


class Index:
    """The benchmark's windows, fingerprints and item sets, from the table of its windows."""

    def __init__(self, folder: str):
        import pyarrow.parquet as pq

        system, path = shared.open_fs(folder)
        table = pq.read_table(path, filesystem=system).combine_chunks()
        names = table["item"].unique().to_pylist()
        self.names = sorted(names)
        code = np.empty(len(names), np.int64)
        code[np.argsort(np.array(names, object))] = np.arange(len(names))
        item = code[table["item"].combine_chunks().dictionary_encode().indices.to_numpy()] if names else code
        words, window, prints = table["words"].to_numpy(), table["window"].to_numpy().view(np.uint64), table["print"].to_numpy().view(np.uint64)
        self.prints = np.unique(prints[words == WINDOW])
        order = np.lexsort((item, window, words))
        self.item, words, window = item[order], words[order], window[order]
        new = np.ones(len(order), bool)
        new[1:] = (words[1:] != words[:-1]) | (window[1:] != window[:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(order)))
        # windows of the same items have one set of them
        sums = np.add.reduceat(shared.mix64(self.item.astype(np.uint64) + np.uint64(1)), begin) if len(begin) else np.empty(0, np.uint64)
        _, first, own = np.unique(shared.mix64(sums ^ shared.mix64(count.astype(np.uint64))), return_index=True, return_inverse=True)
        self.begin, self.count = begin[first], count[first]
        words, window = words[begin], window[begin]
        self.by_words = {n: (window[words == n], own[words == n]) for n in np.unique(words).tolist()}
        self.unions: dict[tuple[int, ...], list[str]] = {}

    def known(self, prints: np.ndarray) -> np.ndarray:
        return among(self.prints, prints) >= 0

    def window(self, n: int, hashes: np.ndarray) -> np.ndarray:
        keys, own = self.by_words[n]
        at = among(keys, hashes)
        return np.where(at >= 0, own[at], -1)

    def items(self, sets: tuple[int, ...]) -> list[str]:
        """The items of some sets, sorted; unions that come again are remembered."""
        if sets not in self.unions:
            if len(self.unions) > 1000:
                self.unions.clear()
            at = np.array(sets)
            self.unions[sets] = [self.names[i] for i in np.unique(self.item[shared.ragged(self.begin[at], self.count[at])])]
        return self.unions[sets]


def benchmark_windows(bench: DataFrame) -> DataFrame:
    """item, words, window, print: the distinct windows of items, with their fingerprints (0 for items that are one window)."""

    def cut(batches):
        for whole in batches:
            for batch in shared.slices(whole, "text", 4 << 20):
                data, offsets = shared.text_bytes(batch.column(1))
                h, _, _, begin = shared.word_hashes(data, offsets, shared.ALPHANUMERIC)
                size = np.diff(begin)
                starts, prints = fingerprints(h, begin)
                parts = [(np.searchsorted(begin, starts, "right") - 1, np.full(len(starts), WINDOW), shared.windows_at(h, WINDOW, starts), prints)]
                for n in range(1, WINDOW):
                    own = np.flatnonzero(size == n)
                    parts.append((own, np.full(len(own), n), shared.windows_at(h, n, begin[own]), np.zeros(len(own), np.uint64)))
                item, words, window, print_ = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(item)), pa.array(words.astype(np.int32)), pa.array(shared.signed(window)), pa.array(shared.signed(print_))],
                    names=["item", "words", "window", "print"],
                )

    rows = bench.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    return rows.mapInArrow(cut, "item string, words int, window bigint, print bigint").distinct()


_loaded: dict[str, Index] = {}


def load_index(folder: str) -> Index:
    """A worker keeps the index it used last."""
    if folder not in _loaded:
        _loaded.clear()
        _loaded[folder] = Index(folder)
    return _loaded[folder]


SPANS = "array<struct<first:int,last:int>>"


def reported(batch: pa.RecordBatch, keep: tuple[str, ...], begin: np.ndarray, starts: np.ndarray, words: np.ndarray, items: list[list[str]]) -> pa.RecordBatch:
    """The rows of a batch from its matching windows, whose words are counted over all its texts."""
    mask = np.zeros(int(begin[-1]) + 1, np.int64)
    np.add.at(mask, starts, 1)
    np.add.at(mask, starts + words, -1)
    hit = np.concatenate([[False], np.cumsum(mask[:-1]) > 0])
    total = np.cumsum(hit)
    # spans: where hit words begin and end, cut where a text begins
    hit = hit[1:]
    head = np.zeros(len(hit) + 1, bool)
    head[begin] = True
    head = head[:-1]
    first = np.flatnonzero(hit & (head | ~np.concatenate([[False], hit[:-1]]))) if len(hit) else np.empty(0, np.int64)
    last = np.flatnonzero(hit & np.concatenate([head[1:] | ~hit[1:], [True]])) + 1 if len(hit) else first
    doc = np.searchsorted(begin, first, "right") - 1
    count = np.bincount(doc, minlength=batch.num_rows)
    spans = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array((first - begin[doc]).astype(np.int32)), pa.array((last - begin[doc]).astype(np.int32))], names=["first", "last"]),
    )
    kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
    return pa.RecordBatch.from_arrays(
        [*kept, pa.array(np.diff(begin)), pa.array(total[begin[1:]] - total[begin[:-1]]), pa.array(items, pa.list_(pa.string())), spans], names=[*keep, "n_words", "n_hit", "items", "hits"]
    )


def contamination(docs: DataFrame, bench: DataFrame, scratch: shared.Scratch, keep: tuple[str, ...] = ("doc_id",), index_rows: int = INDEX_ROWS) -> DataFrame:
    """docs' columns ``keep``, n_words, n_hit, items (distinct, as strings, sorted) and hits (maximal spans of hit words, last excluded)."""
    places = scratch.keep(benchmark_windows(bench), "places")
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kinds}, n_words bigint, n_hit bigint, items array<string>, hits {SPANS}"
    columns = list(dict.fromkeys([*keep, "text"]))
    if places.count() > index_rows:
        return _by_shuffle(docs.select(*columns), places, scratch, keep, schema)
    folder = scratch.path("places")

    def search(batches):
        for whole in batches:
            for batch in shared.slices(whole, "text", 4 << 20):
                data, offsets = shared.text_bytes(batch.column(batch.schema.get_field_index("text")))
                h, _, _, begin = shared.word_hashes(data, offsets, shared.ALPHANUMERIC)
                index = load_index(folder)
                starts, words, _, own = looked_up(h, begin, list(index.by_words), index.known, index.window)
                both = np.unique(np.stack([np.searchsorted(begin, starts, "right") - 1, own], 1), axis=0)
                items: list[list[str]] = [[] for _ in range(batch.num_rows)]
                cuts = np.flatnonzero(np.diff(both[:, 0], prepend=-1, append=-1))
                for a, b in zip(cuts, cuts[1:], strict=False):
                    items[both[a, 0]] = index.items(tuple(both[a:b, 1].tolist()))
                yield reported(batch, keep, begin, starts, words, items)

    return docs.select(*columns).mapInArrow(search, schema)


def bit_filter(df: DataFrame, column: str, scratch: shared.Scratch, name: str) -> str:
    """A file of 2 ** FILTER_BITS bits, set where a value's upper bits point; its size doesn't grow with the table."""
    path, number = scratch.path(f"{name}.bits"), FILTER_BITS
    cells = df.select((F.shiftrightunsigned(column, 64 - number)).alias("cell")).distinct()

    def fill(batches):
        bits = np.zeros(1 << number, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy()] = True
        shared.write_whole(path, [np.packbits(bits).tobytes()])
        yield pa.RecordBatch.from_pydict({"path": [path]})

    # at most 2 ** FILTER_BITS distinct cells of 8 bytes go through one task, as a stream
    scratch.keep(cells.coalesce(1).mapInArrow(fill, "path string"), f"{name}-bits")
    return path


_bits: dict[str, np.ndarray] = {}


def passes(path: str, x: np.ndarray) -> np.ndarray:
    if path not in _bits:
        if len(_bits) > 1:
            _bits.clear()
        system, place = shared.open_fs(path)
        with system.open_input_stream(place) as file:
            _bits[path] = np.frombuffer(file.read(), np.uint8)
    number = (8 * len(_bits[path])).bit_length() - 1
    cell = (x >> np.uint64(64 - number)).astype(np.int64)
    return (_bits[path][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1


def _by_shuffle(docs, places, scratch, keep, schema) -> DataFrame:
    """contamination() where the benchmark is too large for a worker: a text's windows are joined by its digest."""
    named = places.groupBy("words", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    named = scratch.keep(named.withColumn("set", F.sha2(F.to_json("items"), 256)), "named")
    windows, prints = named.select("words", "window", "set"), places.filter(F.col("words") == WINDOW).select("print").distinct()
    sets = scratch.keep(named.groupBy("set").agg(F.any_value("items").alias("items")), "sets")
    sizes = sorted(r["words"] for r in windows.select("words").distinct().collect())  # ten at most
    some_print, some_window = bit_filter(prints, "print", scratch, "prints"), bit_filter(windows, "window", scratch, "windows")

    def offer(batches):
        for whole in batches:
            for batch in shared.slices(whole, "text", 4 << 20):
                data, offsets = shared.text_bytes(batch.column(1))
                h, _, _, begin = shared.word_hashes(data, offsets, shared.ALPHANUMERIC)
                starts, words, grams, _ = looked_up(h, begin, sizes, lambda x: passes(some_print, x), lambda n, x: np.where(passes(some_window, x), 0, -1))
                doc = np.searchsorted(begin, starts, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc)), pa.array((starts - begin[doc]).astype(np.int32)), pa.array(words.astype(np.int32)), pa.array(shared.signed(grams))],
                    names=["digest", "start", "words", "window"],
                )

    digest = F.md5("text")
    offered = docs.filter("text is not null").select(digest.alias("digest"), "text").mapInArrow(offer, "digest string, start int, words int, window bigint").distinct()
    hits = scratch.keep(shared.spread(offered, windows, ["words", "window"], "digest", salts=SALTS).select("digest", "start", "words", "set"), "matches")
    spots = hits.groupBy("digest").agg(F.collect_set(F.struct("start", "words")).alias("places"))
    named = shared.spread(hits.select("digest", "set").distinct(), sets, ["set"], "digest", salts=SALTS).select("digest", F.explode("items").alias("item"))
    named = named.groupBy("digest").agg(F.collect_set("item").alias("own"))
    found = scratch.keep(spots.join(named, "digest"), "found")
    # docs' own columns under names that nothing here uses
    aside = docs.toDF(*[f"_{i}_{c}" for i, c in enumerate(docs.columns)])
    moved = dict(zip(docs.columns, aside.columns, strict=True))
    aside = aside.withColumn("digest", F.md5(moved["text"])).withColumn("row", F.xxhash64(*[F.col(moved[c]) for c in docs.columns if c != "text"]))
    both = shared.spread(aside, found, ["digest"], "row", "left", SALTS)

    def finish(batches):
        for whole in batches:
            for batch in shared.slices(whole, "text", 4 << 20):
                data, offsets = shared.text_bytes(batch.column(batch.schema.get_field_index("text")))
                _, _, _, begin = shared.word_hashes(data, offsets, shared.ALPHANUMERIC)
                own = [(int(begin[i]) + p["start"], p["words"]) for i, x in enumerate(batch.column(batch.num_columns - 2).to_pylist()) for p in x or ()]
                at = np.array(own, np.int64).reshape(-1, 2)
                yield reported(batch, keep, begin, at[:, 0], at[:, 1], [sorted(x or ()) for x in batch.column(batch.num_columns - 1).to_pylist()])

    ordered = both.select(*[F.col(moved[c]).alias(c) for c in docs.columns], F.col("places").alias("_places"), F.col("own").alias("_own"))
    return ordered.mapInArrow(finish, schema)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"), shared.Scratch(spark, "op9"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
