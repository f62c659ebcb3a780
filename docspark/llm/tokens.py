"""Operator 2: token ids, bit-packed.

Texts are encoded by the public tokenizer's own model.  Ids of a shard are
stored in blocks of ``BLOCK`` ids, each id in as few bits as the vocabulary
needs; the footer lists where each block begins, so any range of ids is read
without the rest.

File layout, little-endian::

    8 bytes  magic  b"DSPKIDS2"
    u32      bits per id
    u32      ids per block (a multiple of 64)
    words    u64 words; id i of a block fills bits i*bits .. of its word string
    u64[]    byte offset of every block
    u64      number of ids
    u64      number of blocks
    8 bytes  magic

The offsets come last, so a shard is written as its ids come and no task holds
more than a slice of them.  Nulls and empty texts give the end id alone.  Very
long texts are encoded whole.  Repeated rows are encoded each on its own; rows
of one doc_id are ordered by text.  Empty tables give no shard and no rows.
Extra input columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

MAGIC = b"DSPKIDS2"
BLOCK = 4096
#: Ids after which a task begins another shard (256 MB of 16-bit ids); shards up to which their table is broadcast.
SHARD_IDS, BROADCAST_SHARDS = 1 << 27, 200_000
#: Entries that a worker remembers at most; the memory is emptied when full.
REMEMBERED = 300_000
#: Kinds of bytes: white space 0, letters (all beyond ASCII) 1, digits 2, other signs 3.
KINDS = np.full(256, 3, np.uint8)
KINDS[list(b" \t\n\r\x0b\x0c")] = 0
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
KINDS[0x30:0x3A] = 2
PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]
#: White space and separators outside ASCII's common ones (fixed value, RE2 syntax).
RARE_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pre_token_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of byte-level BPE begin in texts whose non-ASCII characters are all letters.

    The documented split, for whole arrays: runs of letters, digits or other
    signs take one space before them; of other white space the last character
    before a sign stands alone; contractions are cut after an apostrophe that
    begins a pre-token.
    """
    kind = KINDS[data]
    n = len(data)
    new = np.zeros(n + 1, bool)
    new[offsets] = True
    cut = np.flatnonzero(new[:n])
    change = np.ones(n, bool)
    change[1:] = (kind[1:] != kind[:-1]) | new[1:n]
    white = kind == 0
    ends = np.zeros(n, bool)  # the last character of its text
    ends[offsets[1:][offsets[1:] > 0] - 1] = True
    follows = np.zeros(n, bool)  # white space right before a sign of the same text
    follows[:-1] = white[:-1] & ~white[1:] & ~ends[:-1]
    lead = follows & (data == 32)
    start = change.copy()
    start |= follows  # the last of a run of white space leaves it
    start[1:] &= ~lead[:-1]  # a sign after a space begins with the space
    start[cut] = True
    marks = np.flatnonzero(start & (data == 39) & ~ends)
    if len(marks):
        text_end = offsets[np.searchsorted(offsets, marks, "right")]
        second = data[marks + 1]
        third = np.where(marks + 2 < text_end, data[np.minimum(marks + 2, n - 1)], 0)
        size = np.where(np.isin(second, list(b"stmd")), 2, 0)
        for two in (b"re", b"ve", b"ll"):
            size = np.where((second == two[0]) & (third == two[1]), 3, size)
        marks, size = marks[size > 0], size[size > 0]
        start[marks + 1] = False
        after = marks + size
        inside = after < n
        after = after[inside]
        # what follows begins anew, but for a space-led or already begun pre-token
        start[after] |= kind[after] == kind[after - 1]
    return np.flatnonzero(start)


class Encoder:
    """Encode many texts by encoding each distinct pre-token once.

    A byte-level BPE encodes pre-tokens independently of each other.  Those of
    many texts are found and told apart by array operations (by 64-bit hashes);
    the library's model encodes each one that the worker doesn't remember.
    Texts with other non-ASCII signs than letters are split one by one, those
    with rare white space or an added token's string by the library itself.
    """

    #: The documented split of byte-level BPE into pre-tokens (fixed value).
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.model = self.tokenizer.model
        self.split = regex.compile(self.SPLIT).findall
        self.known: dict[int, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.letters = self._byte_letters()
        form = json.loads(self.tokenizer.to_str())
        self.plain = self._has_plain_splits(form)
        #: Texts that only the library encodes.
        self.rare = "|".join([RARE_SPACE, *(re.escape(x["content"]) for x in form.get("added_tokens") or () if x["content"])])

    @staticmethod
    def _byte_letters() -> dict[int, str]:
        """Byte-level BPE writes bytes as letters: printable ones as themselves, the others from U+0100 on."""
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(own)]
        return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}

    @staticmethod
    def _has_plain_splits(form: dict) -> bool:
        """Whether pieces may be encoded alone: byte-level BPE with the documented split and nothing else."""
        pre, model = form.get("pre_tokenizer") or {}, form["model"]
        split = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        return split and form.get("normalizer") is None and model["type"] == "BPE" and not model.get("ignore_merges") and not model.get("dropout")

    def _one(self, text: str) -> bytes:
        """Ids of one text as little-endian bytes."""
        out = []
        for part in self.split(text):
            ids = self.words.get(part)
            if ids is None:
                found = self.model.tokenize(part.encode("utf-8").decode("latin-1").translate(self.letters))
                ids = struct.pack(f"<{len(found)}I", *[x.id for x in found])
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                self.words[part] = ids
            out.append(ids)
        return b"".join(out)

    def _whole(self, text: str, rare: bool) -> bytes:
        """A text with other signs beyond ASCII; a rare one is left to the library."""
        if rare:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self._one(text)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and the number of each text's ids."""
        import pyarrow.compute as pc

        if not self.plain:
            found = [e.ids for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum())), counts
        texts = texts.cast(pa.large_string())
        rare = pc.match_substring_regex(texts, self.rare).to_numpy(zero_copy_only=False)
        odd = rare | pc.match_substring_regex(texts, r"[^\x00-\x1b\x20-\x7f\p{L}]").to_numpy(zero_copy_only=False)
        plain_rows, odd_rows = np.flatnonzero(~odd), np.flatnonzero(odd)
        plain = texts.filter(pa.array(~odd)) if len(odd_rows) else texts
        data, offsets = shared.text_bytes(plain)
        start = pre_token_starts(data, offsets) if len(data) else np.empty(0, np.int64)
        length = np.diff(np.append(start, len(data)))
        number = np.diff(np.searchsorted(start, offsets))
        h = shared.hash_pieces(data, start, length)
        codes, keys = pd.factorize(h)
        first = np.empty(len(keys), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        get, known = self.known.get, self.known
        table = list(map(get, keys.tolist()))
        missing = [i for i, x in enumerate(table) if x is None]
        if len(known) + len(missing) > REMEMBERED:
            known.clear()
        at, size = start[first[missing]].tolist(), length[first[missing]].tolist()
        raw, letters, model = data.tobytes(), self.letters, self.model.tokenize
        for i, key, a, k in zip(missing, keys[missing].tolist(), at, size, strict=True):
            found = model(raw[a : a + k].decode("latin-1").translate(letters))
            table[i] = known[key] = PACK[len(found)](*[x.id for x in found]) if len(found) < 64 else np.array([x.id for x in found], "<u4").tobytes()
        begin_odd = len(table)
        if len(odd_rows):
            table += [self._whole(texts[int(i)].as_py(), bool(rare[i])) for i in odd_rows]
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        pool = np.frombuffer(b"".join(table), "<u4")
        where = np.cumsum(sizes) - sizes
        if len(odd_rows):  # weave them in
            rows = np.ones(len(texts), np.int64)
            rows[plain_rows] = number
            begin = np.cumsum(rows) - rows
            every = np.empty(int(rows.sum()), np.int64)
            every[shared.ragged(begin[plain_rows], number)] = codes
            every[begin[odd_rows]] = begin_odd + np.arange(len(odd_rows))
        else:
            rows, every = number, codes
        counts = sizes[every]
        ids = pool[shared.ragged(where[every], counts)]
        sums = np.concatenate([[0], np.cumsum(counts)])
        ends = np.cumsum(rows)
        return ids, sums[ends] - sums[ends - rows]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for a worker, whatever number of tasks it runs."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int | None, limit: int = 4 << 20):
    """Yields (doc_ids, ids of all documents, number of ids of each), end id included."""
    import pyarrow.compute as pc

    for whole in batches:
        for batch in shared.slices(whole, "text", limit):
            texts = pc.fill_null(batch.column(batch.schema.get_field_index("text")), "")
            ids, counts = encoder(path).encode(texts)
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32)
                counts = counts + 1
            yield batch.column(batch.schema.get_field_index("doc_id")), ids, counts


# ---- the file format


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids, padded to whole words of 64 ids, as a string of ``bits``-bit fields."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    rows = -(-len(ids) // 64)
    lanes = np.zeros(rows * 64, np.uint64)
    lanes[: len(ids)] = ids
    lanes = lanes.reshape(rows, 64)
    words = np.zeros((rows, bits), np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        words[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(data, bits: int, count: int) -> np.ndarray:
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, lane] = x & mask
    return out.reshape(-1)[:count]


class ShardWriter:
    """Write ids as they come; the file appears under its name when closed."""

    def __init__(self, uri: str, bits: int, block: int = BLOCK):
        self.system, self.path = shared.open_fs(uri)
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.system.open_output_stream(self.own)
        self.bits, self.block, self.total, self.written = bits, block, 0, 0
        self.offsets: list[np.ndarray] = []
        self.rest = np.empty(0, np.uint32)
        self._put(struct.pack("<8sII", MAGIC, bits, block))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def add(self, ids: np.ndarray) -> None:
        self.total += len(ids)
        ids = np.concatenate([self.rest, ids]) if len(self.rest) else ids
        whole = len(ids) // self.block
        if whole:
            self.offsets.append(self.written + np.arange(whole) * (self.block // 64 * self.bits * 8))
            self._put(pack(ids[: whole * self.block], self.bits))
        self.rest = ids[whole * self.block :].copy()

    def close(self) -> None:
        if len(self.rest):
            self.offsets.append(np.array([self.written]))
            self._put(pack(self.rest, self.bits))
        offsets = np.concatenate(self.offsets) if self.offsets else np.empty(0, np.int64)
        self._put(offsets.astype("<u8").tobytes() + struct.pack("<QQ8s", self.total, len(offsets), MAGIC))
        self.out.close()
        self.system.move(self.own, self.path)


class Shard:
    """Random access to a written shard."""

    def __init__(self, uri: str):
        system, path = shared.open_fs(uri)
        self.file = system.open_input_file(path)
        magic, self.bits, self.block = struct.unpack("<8sII", self.file.read(16))
        self.file.seek(self.file.size() - 24)
        self.total, blocks, end = struct.unpack("<QQ8s", self.file.read(24))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"{uri} isn't a shard of ids")
        self.end = self.file.size() - 24 - 8 * blocks
        self.file.seek(self.end)
        self.offsets = np.frombuffer(self.file.read(8 * blocks), "<u8")

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop, from the blocks that hold them."""
        stop = min(stop, self.total)
        if start >= stop:
            return np.empty(0, np.uint32)
        a, b = start // self.block, -(-stop // self.block)
        lo = int(self.offsets[a])
        hi = int(self.offsets[b]) if b < len(self.offsets) else self.end
        self.file.seek(lo)
        ids = unpack(self.file.read(hi - lo), self.bits, min(b * self.block, self.total) - a * self.block)
        return ids[start - a * self.block : stop - a * self.block]


def write_ids(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int | None = 0, partitions: int | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into shards in ascending doc_id order.

    Returns (shard, path, doc_id, local, n): where each document's ids are.
    A task writes its ids as they come and begins another shard after about
    ``shard_ids`` of them.  Calls with the same rows write the same files; the
    returned frame is lazy, so keep() it before use.
    """
    path = vocabulary or vocabulary_path()
    docs = docs.select("doc_id", "text")
    ordered = (docs.repartitionByRange(partitions, "doc_id") if partitions else docs.repartitionByRange("doc_id")).sortWithinPartitions("doc_id", "text")

    def write(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        writer = None
        for found, ids, counts in encode_batches(batches, path, end_id):
            if writer is not None and writer.total >= shard_ids:
                writer.close()
                writer, number = None, number + 1
            uri = f"{folder}/shard-{part:06d}-{number:06d}.ids"
            if writer is None:
                writer = ShardWriter(uri, bits_for(encoder(path).vocabulary))
            before = writer.total + np.cumsum(counts) - counts
            writer.add(ids)
            k = len(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, part << 32 | number, np.int64)), pa.array([uri] * k), found.cast(pa.int64()), pa.array(before.astype(np.int64)), pa.array(counts.astype(np.int64))],
                names=["shard", "path", "doc_id", "local", "n"],
            )
        if writer is not None:
            writer.close()

    return ordered.mapInArrow(write, "shard bigint, path string, doc_id bigint, local bigint, n bigint")


def read_ids(index: DataFrame) -> DataFrame:
    """Read documents back from their shards: the index's columns, start, and ids as binary (u32).

    Every shard is one row of a small table, from which the ids before it
    follow: those of earlier tasks, and those of the task's earlier shards.
    """
    from pyspark.sql import Window

    task = F.shiftright("shard", 32)
    shards = index.groupBy("shard").agg(F.sum("n").alias("total")).withColumn("task", task)
    # one row a task goes through the ordered window; shards are summed within their task
    tasks = shards.groupBy("task").agg(F.sum("total").alias("all"))
    tasks = tasks.select("task", (F.sum("all").over(Window.orderBy("task")) - F.col("all")).alias("earlier"))
    own = F.sum("total").over(Window.partitionBy("task").orderBy("shard")) - F.col("total")
    before = shards.withColumn("own", own).join(tasks, "task").select("shard", (F.col("earlier") + F.col("own")).alias("base"))
    some = F.broadcast(before) if index.select("shard").distinct().count() <= BROADCAST_SHARDS else before
    placed = index.join(some, "shard").withColumn("start", F.col("base") + F.col("local")).drop("base")

    def read(batches):
        current, shard = None, None
        for batch in batches:
            d = batch.to_pydict()
            if not d["doc_id"]:
                continue
            n = len(d["doc_id"])
            k = 0
            while k < n:
                e, size = k, 0
                while e < n and d["path"][e] == d["path"][k] and (size < 1 << 22 or e == k) and (e == k or d["local"][e] == d["local"][e - 1] + d["n"][e - 1]):
                    size += d["n"][e]
                    e += 1
                if current != d["path"][k]:
                    current, shard = d["path"][k], Shard(d["path"][k])
                lo = d["local"][k]
                raw = shard.read(lo, d["local"][e - 1] + d["n"][e - 1]).astype("<u4").tobytes()
                ids = [raw[4 * (a - lo) : 4 * (a - lo + m)] for a, m in zip(d["local"][k:e], d["n"][k:e], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(k, e - k) for i in range(batch.num_columns)] + [pa.array(ids, pa.binary())],
                    names=[*batch.schema.names, "ids"],
                )
                k = e

    return placed.mapInArrow(read, "shard bigint, path string, doc_id bigint, local bigint, n bigint, start bigint, ids binary")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = shared.Scratch(spark, "op2")
    index = scratch.keep(write_ids(shared.table(spark, sf_dir, "documents"), scratch.path("ids")), "index")
    return read_ids(index).select("doc_id", "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
