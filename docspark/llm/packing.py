"""Operator 7: best-fit packing by patterns and non-negative least squares.

Documents are cut into pieces of at most ``capacity`` tokens; a cut document's
first piece takes what is over, so all its other pieces fill a sequence each.
What remains is a histogram over at most ``capacity`` lengths, whatever the
number of documents.  Patterns of a few lengths that fit a sequence are
columns of a matrix; non-negative least squares finds how often to repeat each
so that the histogram is used up; the counts are rounded down and the residual
lengths are packed best-fit, largest first, again by repeated patterns.  The
plan is a short list of ranges (length, ranks, sequence, offset), so pieces
find their places by their rank among pieces of their length.

Ranks need no shuffle by length: partitions count their lengths, and a
partition's ranks follow those of the partitions before it.  Nulls and empty
texts are pieces of one token (the end id).  Very long texts are cut as above,
however many pieces they make.  Ties and repeated rows get different ranks.
Empty tables give no pieces.  Extra input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared, tokens

CAPACITY = 2048


# ---- the plan, from the histogram alone


def nnls(columns: np.ndarray, target: np.ndarray, steps: int = 2000, tolerance: float = 1e-5) -> np.ndarray:
    """min |Ax - target| under x >= 0 by accelerated projected gradients, begun anew where they overshoot.

    Ends once the optimality conditions hold up to ``tolerance`` of the target's
    scale: no gradient where x > 0, and none that asks for more where x = 0.

    columns: for each column of A the rows it adds one to, padded with the
    number of rows.
    """
    rows = len(target)
    scale = max(1.0, float(target.max()))
    b = np.append(target / scale, 0)

    def times(x):
        y = np.bincount(columns.ravel(), np.repeat(x, columns.shape[1]), rows + 1)
        y[rows] = 0
        return y

    x = np.zeros(len(columns))
    # the norm of A'A is at most the product of its largest column and row sums
    rate = 1.0 / (columns.shape[1] * max(1.0, float(times(np.ones(len(columns))).max())))
    y, t = x, 1.0
    for _ in range(steps):
        gradient = (times(y) - b)[columns].sum(1)
        new = np.maximum(0, y - rate * gradient)
        if np.abs(new - y).max(initial=0) <= rate * tolerance:
            return new * scale
        if float(gradient @ (new - x)) > 0:
            y, t = x, 1.0
            continue
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x * scale


def patterns(counts: np.ndarray, capacity: int, width: int = 3) -> list[tuple[int, ...]]:
    """Patterns of up to ``width`` lengths, largest first, that fill a sequence well.

    For each present length: itself with the best partner, and with each of
    some spread second lengths and the best third one.
    """
    present = np.flatnonzero(counts)
    if not len(present):
        return []
    # best[c]: the largest present length of at most c, or 0
    best = np.zeros(capacity + 1, np.int64)
    best[present] = present
    best = np.maximum.accumulate(best)
    found: set[tuple[int, ...]] = set()
    spread = present[np.unique(np.linspace(0, len(present) - 1, 24).astype(int))]
    for a in present[::-1].tolist():
        room = capacity - a
        one = int(best[room])
        if not one:
            found.add((a,))
            continue
        found.add(tuple(sorted((a, one, *([int(best[room - one])] if width > 2 and best[room - one] else [])), reverse=True)))
        if width < 3:
            continue
        for b in spread[spread <= room].tolist():
            c = int(best[room - b])
            if c:
                found.add(tuple(sorted((a, b, c), reverse=True)))
    return sorted(found, reverse=True)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats): together they use each length as often as counted."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    candidates = [p for p in patterns(left, capacity) if sum(p) >= capacity - max(1, capacity // 256)]
    if candidates:
        rows = np.flatnonzero(left)
        place = np.full(capacity + 1, -1)
        place[rows] = np.arange(len(rows))
        columns = np.array([[*place[list(p)], *[len(rows)] * (3 - len(p))] for p in candidates])
        for j, x in sorted(enumerate(nnls(columns, left[rows])), key=lambda e: -e[1]):
            need = np.bincount(candidates[j])
            used = np.flatnonzero(need)
            n = int(min(np.floor(x + 1e-6), (left[used] // need[used]).min()))
            if n > 0:
                out.append((candidates[j], n))
                left[used] -= n * need[used]
    # what rounding leaves: best fit on the histogram, largest length first
    while left.any():
        present = np.flatnonzero(left)
        pattern, room, taken = [], capacity, {}
        while True:
            fits = present[: np.searchsorted(present, room, "right")]
            k = len(fits) - 1
            while k >= 0 and left[fits[k]] <= taken.get(int(fits[k]), 0):
                k -= 1
            if k < 0:
                break
            a = int(fits[k])
            pattern.append(a)
            taken[a] = taken.get(a, 0) + 1
            room -= a
        repeats = min(int(left[a] // n) for a, n in taken.items())
        out.append((tuple(pattern), repeats))
        for a, n in taken.items():
            left[a] -= n * repeats
    return out


def ranges(chosen: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, past-last rank, first sequence, offset) by length and rank."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, repeats in chosen:
        offset = 0
        for length in pattern:
            rank = used.get(length, 0)
            out.append((length, rank, rank + repeats, sequence, offset))
            used[length] = rank + repeats
            offset += length
        sequence += repeats
    return np.array(sorted(out), np.int64).reshape(-1, 5)


# ---- pieces


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Encode (doc_id, text) and cut: doc_id, piece, start, length, ids (binary u32), part.

    part numbers the task, for ranks.
    """
    path = vocabulary or tokens.vocabulary_path()

    def cut(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for found, ids, number in tokens.encode_batches(batches, path, end_id):
            n = -(-number // capacity)
            first = number - (n - 1) * capacity
            doc = np.repeat(np.arange(len(number)), n)
            piece = shared.ragged(np.zeros(len(n), np.int64), n)
            length = np.where(piece == 0, first[doc], capacity)
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            nth = seen[length] + pd.Series(length).groupby(length).cumcount().to_numpy()
            seen += np.bincount(length, minlength=capacity + 1)
            data = pa.py_buffer(ids.astype("<u4").tobytes())
            offsets = pa.py_buffer((4 * np.concatenate([[0], np.cumsum(length)])).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    found.cast(pa.int64()).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                    pa.Array.from_buffers(pa.binary(), len(doc), [None, offsets, data]), pa.array(np.full(len(doc), part, np.int32)), pa.array(nth),
                ],
                names=["doc_id", "piece", "start", "length", "ids", "part", "nth"],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids binary, part int, nth bigint")


def locate(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences and offsets of pieces by their length and rank; table: of ranges()."""
    step = int(max(table[:, 2].max(), rank.max())) + 1
    row = np.searchsorted(table[:, 0] * step + table[:, 1], length * step + rank, "right") - 1
    found = table[row]
    return found[:, 3] + rank - found[:, 1], found[:, 4]


#: Rows (task and length) of earlier counts that may be broadcast; beyond, they are joined.
BROADCAST_ROWS = 500_000


def pack(docs: DataFrame, scratch: shared.Scratch, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack (doc_id, text): one row per piece with its ids, sequence_id and offset in the sequence."""
    spark = docs.sparkSession
    cut = scratch.keep(pieces(docs, vocabulary, capacity), "pieces")
    by_part = scratch.keep(
        cut.groupBy("part", "length").agg(F.count("*").alias("n"))
        .select("part", "length", "n", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before")),
        "by_part",
    )
    # at most ``capacity`` rows, however many documents there are
    histogram = by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for row in histogram:
        counts[row["length"]] = row["n"]
    table = ranges(plan(counts, capacity))
    before = by_part.select("part", "length", "before")
    rows = before.count()
    ranked = cut.join(F.broadcast(before) if rows <= BROADCAST_ROWS else before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sequence, offset = locate(table, batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids binary"
    placed = ranked.select("doc_id", "piece", "start", "length", "ids", "rank").mapInArrow(place, schema + ", sequence_id bigint, offset bigint")
    return placed


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(shared.table(spark, sf_dir, "documents"), shared.Scratch(spark, "op7")))
