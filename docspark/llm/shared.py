"""Folders, written tables and small vector helpers that the operators share."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(left: DataFrame, right: DataFrame, keys: list[str], by: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """A join whose left side may hold hot keys: each is dealt over ``salts`` tasks by column ``by``, and the right side's rows go to all of these."""
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(salted, [*keys, "_salt"], how).drop("_salt")


class Scratch:
    """A folder of its own below the cluster's shared folder.

    Executors and driver both see it, so tables written here outlive lost
    executors.  ``spark.checkpoint.dir`` names the place; only where that is
    unset, as in local tests, a folder of this machine is used.
    """

    def __init__(self, spark: SparkSession, label: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file:///tmp/docspark-scratch"
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark = spark
        # a path without a scheme belongs to the cluster's default file system
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        base = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
        self.uri = f"{base.rstrip('/')}/docspark-{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: its lineage ends at the written table."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.uri)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        path.getFileSystem(conf).delete(path, True)


def open_fs(uri: str):
    """A pyarrow file system and the path in it; for workers as for the driver."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, parts) -> int:
    """Write byte strings to a file that appears only when complete.

    Every attempt has a name of its own until the final rename, so a repeated
    or speculative task can't leave half a file behind.
    """
    system, path = open_fs(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    own, size = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with system.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    system.move(own, path)
    return size


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0].., starts[1].., each run as long as its length."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def byte_table(word_bytes: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(word_bytes)] = True
    return table


#: Bytes of words: all but white space; or letters, digits and non-ASCII.
NOT_SPACE = ~byte_table(b" \t\n\r\x0b\x0c")
ALPHANUMERIC = byte_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Hash the words of many texts at once.

    data: UTF-8 bytes of all texts; offsets: where each text begins, and the
    end.  A-Z is lower-cased first.  Returns word hashes, the words' first and
    past-last byte, and the number of words before each text and in all.
    """
    low = _LOWER[data]
    inside = is_word[low]
    # a text's first byte never continues the word that ends the text before it
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = inside[heads]
    start = np.flatnonzero(begins)
    if not len(start):
        return np.empty(0, np.uint64), start, start, np.zeros(len(offsets), np.int64)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    stop[tails] = inside[tails]
    end = np.flatnonzero(stop) + 1
    h = hash_pieces(low, start, end - start)
    return h, start, end, np.searchsorted(start, offsets)


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def hash_pieces(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece of the bytes.

    Goes over all pieces' first eight bytes, then all second eight, to the
    fourth; the rest of longer ones is summed under weights by position.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,))
    h = mix64(length.astype(np.uint64) + _BASE)
    going, at, left = slice(None), start, length
    for step in range(min(4, -(-int(length.max(initial=0)) // 8))):
        if step:
            on = np.flatnonzero(left > 8)
            going = on if step == 1 else going[on]
            at, left = at[on] + 8, left[on] - 8
        h[going] = mix64(h[going] * _BASE + (eight[at] & _MASKS[np.minimum(left, 8)]))
    for k in np.flatnonzero(length > 32):
        total = np.uint64(0)
        stop = int(start[k] + length[k])
        with np.errstate(over="ignore"):
            for at in range(int(start[k]) + 32, stop, 1 << 16):
                part = _BYTES[data[at : min(stop, at + (1 << 16))]]
                weights = mix64(np.arange(at - start[k], at - start[k] + len(part)).astype(np.uint64) * _BASE)
                total += mix64(part ^ weights).sum(dtype=np.uint64)
            h[k] = mix64(h[k : k + 1])[0] + total
    return h


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive word hashes (across texts too)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _BASE + h[i : i + n]
        if i % 4 == 3:
            out = mix64(out)
    return mix64(out + np.uint64(k))


def windows_at(h: np.ndarray, k: int, starts: np.ndarray) -> np.ndarray:
    """windows() at some starts alone."""
    out = np.zeros(len(starts), np.uint64)
    for i in range(k):
        out = out * _BASE + h[starts + i]
        if i % 4 == 3:
            out = mix64(out)
    return mix64(out + np.uint64(k))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; nulls count as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def tidy() -> None:
    """Give back what a worker has freed; workers live on between tasks and stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch, column: str, limit: int = 16 << 20):
    """Cut a record batch so that each piece holds about ``limit`` text bytes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())), 0)
    group = np.cumsum(sizes.to_numpy(zero_copy_only=False)) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(int(a), int(b - a))
    tidy()
