"""Operator 10: MinHash near-duplicates by an inverted join of signature coordinates.

1. Every document becomes the set of its word shingles' 64-bit hashes.  Equal
   sets are one class; only its smallest document goes on.
2. ``COORDINATES`` minima make a signature; each (coordinate, value) is a
   posting key.  Two sets right at the threshold agree on fewer than
   ``MATCHES`` coordinates with a chance of 1e-12 (binomial tail); with
   ``matches=1`` it is 2e-45, below that of equal 64-bit hashes: the exact option.
3. Prefix: keys are ordered by how many documents post them, rarest first.
   Documents that agree on ``matches`` coordinates share one of the first
   COORDINATES - matches + 1 keys, so only these are joined.  Keys that one
   document alone posts use up the prefix; most documents leave here.
4. Skip: members of a key's list are first matched with one leader, and links
   found are contracted to components.  Pairs of a list that are in one
   component already need no look.  A second round takes a leader of its own
   for every key.
5. Documents of lists still apart, short or long, are posted once more under
   keys that split these lists without loss: in the order of their shingles
   from the rarest on, sets of the similarity asked for share a shingle among
   the smaller one's first ninth and the larger one's first fifth, and what
   follows it must suffice for the overlap.  So documents that have much in
   common, but not enough, mostly meet under no key.  A shingle's list is dealt
   in cells of at most LIST times 8 * LIST members; in a cell the collisions are
   counted and only matches come out.
   A match is a collision count of at least ``matches``, whatever the list;
   every match is confirmed on the full sets.
6. Components are found by contracting edges to the smallest id, in tables; a
   bounded number of links is united in one task.

Null and empty texts, and texts of white space, have empty sets and no links.
Texts of fewer words than a shingle are one shingle.  Rows of one doc_id are
one document and get a row each; if their texts differ, the least text (by its
bytes) counts for all of them.  A row with a null doc_id is linked with
nothing and stays.  Very
long texts are read whole.  Ties in similarity at the threshold are links, ties
between leaders go to the smaller id.  Empty tables give no rows.  Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

COORDINATES = 64
MATCHES = 26
PERCENT = 80
#: Ids of matched documents that may be broadcast (8 bytes each); beyond, they are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Links up to which components are found in one task; more are contracted by joins, round by round.
TASK_LINKS = 100_000
#: Smaller members of a shingle's list in one cell; of the larger ones eight times as many.
LIST = 512
_RNG = np.random.default_rng(20240607)
_MULTIPLY = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2)


def shingle_sets(column, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = shared.text_bytes(column)
    h, _, _, begin = shared.word_hashes(data, offsets, shared.NOT_SPACE)
    grams = shared.windows(h, words)
    out = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        n = b - a
        if n >= words:
            x = np.sort(grams[a : b - words + 1])
            if len(x) > 1:
                fresh = np.empty(len(x), bool)
                fresh[0] = True
                np.not_equal(x[1:], x[:-1], out=fresh[1:])
                x = x[fresh]
        else:
            x = shared.windows(h[a:b], n) if n else np.empty(0, np.uint64)
        out.append(x)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Posting keys, a row of COORDINATES for each set; none of the sets may be empty."""
    every = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    keys = np.empty((len(sets), COORDINATES), np.uint64)
    work = np.empty_like(every)
    for j in range(COORDINATES):
        np.bitwise_xor(every, _FLIP[j], out=work)
        np.multiply(work, _MULTIPLY[j], out=work)
        keys[:, j] = np.minimum.reduceat(work, starts)
    return shared.mix64(keys + np.arange(COORDINATES, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (set size), c1 and c2 (128 bits that tell sets apart), keys."""

    def run(batches):
        salt = np.uint64(0x5851F42D4C957F2D)
        for whole in batches:
            for batch in shared.slices(whole, "text", 4 << 20):
                sets = shingle_sets(batch.column(1), words)
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                full = [x for x in sets if len(x)]
                keys = np.zeros((len(sets), COORDINATES), np.uint64)
                c = np.zeros((2, len(sets)), np.uint64)
                if full:
                    every = np.concatenate(full)
                    starts = np.cumsum(n[n > 0]) - n[n > 0]
                    keys[n > 0] = signatures(full)
                    for row, x in enumerate((every, every ^ salt)):
                        c[row, n > 0] = np.add.reduceat(shared.mix64(x), starts)
                offsets = pa.array(np.cumsum([0, *np.where(n > 0, COORDINATES, 0)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(shared.signed(keys[n > 0].reshape(-1))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), pa.array(n), pa.array(shared.signed(c[0])), pa.array(shared.signed(c[1])), lists],
                    names=["doc_id", "n", "c1", "c2", "keys"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, c1 bigint, c2 bigint, keys array<bigint>")


def prefixes(reps: DataFrame, matches: int = MATCHES) -> DataFrame:
    """key, id: the postings that the join needs; keys that no other document posts are left out."""
    posted = reps.select(F.col("doc_id").alias("id"), F.explode("keys").alias("key"))
    shared_keys = posted.groupBy("key").agg(F.count("*").alias("freq")).filter("freq > 1")
    ordered = posted.join(shared_keys, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("freq", "key"))).alias("own"))
    room = F.lit(COORDINATES - matches + 1) - (COORDINATES - F.size("own"))
    return ordered.filter(room > 0).select("id", F.explode(F.slice("own", F.lit(1), room)).alias("p")).select("id", F.col("p.key").alias("key"))


def agreeing(a: Column, b: Column) -> Column:
    """Collisions of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def similar_sizes(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def matched(pairs: DataFrame, signs: DataFrame, matches: int) -> DataFrame:
    """Of pairs (a, b) those whose signatures agree often enough, with that count."""
    left = signs.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sign").alias("sa"))
    right = signs.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sign").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").filter(similar_sizes(F.col("na"), F.col("nb")))
    return both.select("a", "b", agreeing(F.col("sa"), F.col("sb")).alias("count")).filter(F.col("count") >= matches)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of some documents, one row each."""
    some = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.select("doc_id", "text").join(some, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, scratch: shared.Scratch, name: str) -> DataFrame:
    """Of pairs (a, b) those whose full sets are similar: 100 * intersection >= PERCENT * union."""
    ids = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{name}-ids")
    texts = scratch.keep(texts_of(docs, ids), f"{name}-texts")
    left, right = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def run(batches):
        for whole in batches:
            for batch in shared.slices(whole, "ta", 4 << 20):
                yes = np.zeros(batch.num_rows, bool)
                for i, (x, y) in enumerate(zip(shingle_sets(batch.column(2), words), shingle_sets(batch.column(3), words), strict=True)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    yes[i] = both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(yes)) for c in batch.columns[:2]], names=["a", "b"])

    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return scratch.keep(joined.mapInArrow(run, "a bigint, b bigint"), f"{name}-links")


def united(batches):
    """id and the least id of its component, by union and find over all batches of edges."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            top.setdefault(a, a)
            top.setdefault(b, b)
            a, b = root(a), root(b)
            top[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(top), pa.int64()), pa.array([root(x) for x in top], pa.int64())], names=["id", "comp"])


def components(links: DataFrame, scratch: shared.Scratch, name: str) -> DataFrame:
    """id, comp: the smallest id that links reach, for every id in links."""
    edges = scratch.keep(links.select("a", "b").filter("a <> b").distinct(), f"{name}-edges")
    if edges.count() <= TASK_LINKS:
        return scratch.keep(edges.coalesce(1).mapInArrow(united, "id bigint, comp bigint"), f"{name}-label")
    label = None
    turn = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("to"))
        least = scratch.keep(least, f"{name}-least-{turn}")
        # one jump along the pointers: every id's target is never larger than the id
        jump = least.join(least.select(F.col("a").alias("to"), F.col("to").alias("far")), "to").select("a", F.col("far").alias("to"))
        jump = scratch.keep(jump, f"{name}-jump-{turn}")
        if label is None:
            label = jump.select(F.col("a").alias("id"), F.col("to").alias("comp"))
        else:
            label = label.join(jump.withColumnRenamed("a", "comp"), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
        label = scratch.keep(label, f"{name}-label-{turn}")
        to_a, to_b = jump.select("a", F.col("to").alias("x")), jump.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = edges.join(to_a, "a").join(to_b, "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        edges = scratch.keep(edges, f"{name}-edges-{turn}")
        turn += 1
    return label if label is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))


def apart(postings: DataFrame, comps: DataFrame, scratch: shared.Scratch, name: str) -> DataFrame:
    """key, id, comp of the keys whose members are in more than one component."""
    placed = postings.join(comps, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    return scratch.keep(shared.spread(placed, mixed, ["key"], "id"), name)


def to_leaders(postings: DataFrame, order: Column) -> DataFrame:
    """Pairs (a, b) of each key's leader, least by ``order``, with its members in other components."""
    leaders = postings.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("id").alias("a"), F.col("comp").alias("ca"))).alias("l")).select("key", "l.a", "l.ca")
    pairs = shared.spread(postings, leaders, ["key"], "id").filter("comp <> ca")
    return pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()


def links_between(reps: DataFrame, docs: DataFrame, words: int, scratch: shared.Scratch, matches: int) -> DataFrame:
    """id, comp of the representatives that are linked with others."""
    postings = scratch.keep(prefixes(reps, matches), "prefixes")
    low = lambda k: F.transform(k, lambda x: x.bitwiseAND(0x7FFF).cast("smallint"))
    in_use = postings.select(F.col("id").alias("doc_id")).distinct()
    signs = reps.join(in_use, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "n", low(F.col("keys")).alias("sign"))
    signs = scratch.keep(signs.dropDuplicates(["id"]), "signs")
    own = scratch.keep(postings.withColumn("comp", F.col("id")), "own")
    # of the leaders that a document matches the one most like it is enough for a start
    first = matched(to_leaders(own, F.col("id")), signs, matches)
    first = scratch.keep(first.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a")).select("a", "b"), "pairs-1")
    links = confirmed(first, docs, words, scratch, "round-1")
    comps = components(links, scratch, "comps-1")
    left = apart(postings, comps, scratch, "apart-1")
    second = matched(to_leaders(left, F.xxhash64("id", "key")), signs, matches).select("a", "b")
    second = scratch.keep(second.join(first, ["a", "b"], "left_anti"), "pairs-2")
    if not second.isEmpty():
        links = links.unionByName(confirmed(second, docs, words, scratch, "round-2"))
        comps = components(links, scratch, "comps-2")
        left = apart(left.select("key", "id"), comps, scratch, "apart-2")
    members = scratch.keep(left.select("id", "comp").distinct().join(signs, "id"), "members-left")
    if members.isEmpty():
        return comps
    third = between(members, docs, words, scratch, matches)
    third = scratch.keep(third.join(first.unionByName(second), ["a", "b"], "left_anti"), "pairs-3")
    if third.isEmpty():
        return comps
    return components(links.unionByName(confirmed(third, docs, words, scratch, "round-3")), scratch, "comps-3")


def between(members: DataFrame, docs: DataFrame, words: int, scratch: shared.Scratch, matches: int) -> DataFrame:
    """Pairs (a, b) of members (id, comp, n, sign) of different components that match, found by their rarest shingles.

    100 * overlap >= PERCENT * union asks for an overlap of at least
    PERCENT * (na + nb) / (100 + PERCENT).  Of two sets' shingles in one order,
    the first that both hold has at least the whole overlap from it on, in
    either set.
    """

    def cut(batches):
        for whole in batches:
            for batch in shared.slices(whole, "text", 4 << 20):
                sets = shingle_sets(batch.column(1), words)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), pa.array(shared.signed(np.concatenate(sets) if sets else np.empty(0, np.uint64))))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), lists], names=["id", "shingles"])

    ids = scratch.keep(members.select(F.col("id").alias("doc_id")), "ids-left")
    held = texts_of(docs, ids).mapInArrow(cut, "id bigint, shingles array<bigint>").select("id", F.explode("shingles").alias("shingle"))
    held = scratch.keep(held, "shingles-left")
    often = held.groupBy("shingle").agg(F.count("*").alias("freq")).filter("freq > 1")
    ordered = shared.spread(held, often, ["shingle"], "id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("freq", "shingle"))).alias("own"))
    # a set's shingles that no other member holds come first; ``rest``: how many there are from a shingle on
    posted = ordered.join(members.select("id", "n"), "id").select("id", "n", F.size("own").alias("size"), F.posexplode("own"))
    posted = posted.select("id", F.col("col.shingle").alias("shingle"), (F.col("size") - F.col("pos")).alias("rest"), (100 * F.col("size") - 100 * F.col("pos") >= PERCENT * F.col("n")).alias("reaches"), "n").filter("reaches")
    small = F.col("rest") * (100 + PERCENT) >= 2 * PERCENT * F.col("n")
    posted = scratch.keep(posted.select("id", "shingle", "rest", small.alias("small")), "postings-left")
    lists = posted.groupBy("shingle").agg(F.count_if("small").alias("smalls"), F.count("*").alias("larges")).filter("smalls > 0 and larges > 1")
    lists = lists.select("shingle", F.ceil(F.col("smalls") / LIST).cast("int").alias("rows"), F.ceil(F.col("larges") / (8 * LIST)).cast("int").alias("columns"))
    dealt = scratch.keep(shared.spread(posted, lists, ["shingle"], "id").join(members, "id"), "dealt-left")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("id", "comp", "n", "rest", "sign")]
    a = dealt.filter("small").withColumn("row", place("rows")).withColumn("column", every("columns")).select("shingle", "row", "column", *side("a"))
    b = dealt.withColumn("column", place("columns")).withColumn("row", every("rows")).select("shingle", "row", "column", *side("b"))
    pairs = a.join(b, ["shingle", "row", "column"]).filter(
        (F.struct("n_a", "id_a") < F.struct("n_b", "id_b")) & (F.col("comp_a") != F.col("comp_b")) & similar_sizes(F.col("n_a"), F.col("n_b"))
        & (F.least("rest_a", "rest_b") * (100 + PERCENT) >= PERCENT * (F.col("n_a") + F.col("n_b"))) & (agreeing(F.col("sign_a"), F.col("sign_b")) >= matches)
    )
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def one_text(docs: DataFrame, scratch: shared.Scratch) -> DataFrame:
    """doc_id and text; where rows of one doc_id have different texts, all get the least one."""
    docs = docs.select("doc_id", "text")
    mark = F.xxhash64("text")
    mixed = docs.groupBy("doc_id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).filter("lo <> hi and doc_id is not null").select("doc_id")
    mixed = scratch.keep(mixed, "mixed")
    if mixed.isEmpty():
        return docs
    least = scratch.keep(docs.join(mixed, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("least")), "least")
    return docs.join(least, "doc_id", "left").select("doc_id", F.coalesce("least", "text").alias("text"))


def near_duplicates(docs: DataFrame, scratch: shared.Scratch, words: int = 5, matches: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest document with the same set), component_id, kept."""
    docs = one_text(docs, scratch)
    sketched = scratch.keep(sketch(docs, words), "sketch")
    full = sketched.filter("n > 0 and doc_id is not null")
    classes = full.groupBy("c1", "c2").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")).filter("size > 1").drop("size")
    classes = scratch.keep(classes, "classes")
    light = sketched.select("doc_id", "n", "c1", "c2").join(classes, ["c1", "c2"], "left")
    member = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    members = scratch.keep(light.select("doc_id", "n", member.alias("class_id")), "members")
    others = members.filter("doc_id <> class_id").select("doc_id")
    reps = full.select("doc_id", "n", "keys").join(others, "doc_id", "left_anti")
    comps = links_between(reps, docs, words, scratch, matches)
    found = members.join(comps.withColumnRenamed("id", "class_id"), "class_id", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("comp", "class_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(shared.table(spark, sf_dir, "documents"), shared.Scratch(spark, "op10"), 4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")
