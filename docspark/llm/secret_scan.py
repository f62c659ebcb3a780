"""Operator 1: secret scans, with DataFrame functions only.

Base kinds are patterns (assignments, access keys, hex strings).  Beyond them a
battery of randomness tests looks at every long token that mixes digits and
letters: its encoding is inferred from its characters; chi-squared uniformity
over that alphabet, a runs test about the alphabet's middle and the lag-1
serial correlation give three p-values under "drawn uniformly", which Fisher's
method combines.  Natural tokens have p near 0, random ones any p alike.  From
the corpus-wide histogram of p in each stratum of encoding and length follows
how many tokens above a threshold are not random; the lowest threshold that
keeps this false-discovery rate under ``FDR`` holds for the stratum.  Strata of
few tokens share a histogram, under the same rule; tokens of 20 * 2 ** 7.5
characters and more are one stratum of their encoding.

Null and empty texts have no spans.  Very long texts are searched whole.
Repeated rows and ties each give a row of their own; nothing is joined by
doc_id.  A null doc_id stays null.  Empty tables give no rows.  Extra columns
don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Patterns of the base kinds (fixed values), with the prefilters that any match passes.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_ANY = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: A token of this kind has a digit, within its first characters or after them.
TOKEN_ANY = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20}"
KINDS = ("assign", "access", "hex", "random")
#: Encodings by name: what all characters match, and the alphabet in order (fixed values).
ENCODINGS = (
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^(?:[0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "^[0-9A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
FDR = 0.05
#: Strata of fewer tokens than this are judged by the histogram of their encoding's small strata together, and those by that of all small ones.
LEAST = 40
BINS = 50


SPAN = "struct<s:int,e:int,m:string,n:int>"
#: Matches that one fold adds up.
PART = 256


def located(text: Column, pattern: str, least: int | None = None) -> Column:
    """array<struct<s, e, m>>: leftmost non-overlapping matches with their code points.

    The text between matches and the matches themselves alternate, so their
    lengths add up to positions.  least: smallest length of group 2.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least else found
    steps = F.zip_with(
        F.slice(gaps, 1, F.size(found)), F.zip_with(found, value, lambda m, v: F.struct(m.alias("m"), F.length(v).alias("n"))), lambda g, m: F.struct(g.alias("g"), m["m"].alias("m"), m["n"].alias("n"))
    )

    def add(state: Column, x: Column) -> Column:
        begin = state["at"] + x["g"]
        end = begin + F.length(x["m"])
        return F.struct(end.cast("int").alias("at"), F.concat(state["out"], F.array(F.struct(begin.cast("int").alias("s"), end.cast("int").alias("e"), x["m"].alias("m"), x["n"].cast("int").alias("n")))).alias("out"))

    # a fold copies what it has found so far with each match, so it runs over parts of PART matches, and then over the parts' lengths
    def by_part(c: Column) -> Column:
        parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(c["steps"]) / PART).cast("int") - 1, F.lit(0)))
        empty = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.transform(parts, lambda i: F.aggregate(F.slice(c["steps"], i * PART + 1, F.lit(PART)), empty, add))

    def shifted(parts: Column) -> Column:
        begins = F.aggregate(parts, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array((F.element_at(s, -1) + x["at"]).cast("int"))))
        moved = lambda x, by: F.struct((x["s"] + by).cast("int").alias("s"), (x["e"] + by).cast("int").alias("e"), x["m"].alias("m"), x["n"].alias("n"))
        return F.flatten(F.zip_with(parts, F.slice(begins, F.lit(1), F.size(parts)), lambda x, by: F.transform(x["out"], lambda y: moved(y, by))))

    # bound by transforming arrays of one element, so that each step is evaluated once
    spans = F.element_at(F.transform(F.transform(F.array(F.struct(steps.alias("steps"))), by_part), shifted), 1)
    return F.filter(spans, lambda x: x["n"] >= least) if least else spans


def none_of(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by the polynomial approximation of Abramowitz and Stegun, 26.2.17."""
    t = 1 / (1 + F.lit(0.2316419) * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = poly * F.exp(-z * z / 2) / 2.5066282746310002
    return F.greatest(F.when(z >= 0, tail).otherwise(1 - tail), F.lit(1e-30))


def randomness(token: Column) -> Column:
    """struct<enc, p>: the inferred encoding and the combined p-value under uniform draws."""
    enc = F.lit(len(ENCODINGS) - 1)
    for i in range(len(ENCODINGS) - 2, -1, -1):
        enc = F.when(token.rlike(ENCODINGS[i][1]), F.lit(i)).otherwise(enc)

    def of_parts(c: Column) -> Column:
        alphabet = F.element_at(F.array(*[F.lit(a) for _, _, a in ENCODINGS]), c["enc"] + 1)
        size = F.length(alphabet)
        plain = F.when(c["enc"].isin(0, 2), F.lower(c["token"])).otherwise(F.translate(c["token"], "-_", "+/"))
        return F.struct(c["enc"].alias("enc"), size.cast("double").alias("m"), F.filter(F.transform(F.split(plain, ""), lambda x: F.instr(alphabet, x).cast("double") - 1), lambda v: v >= 0).alias("x"))

    def pairs(c: Column) -> Column:
        x = c["x"]
        neighbours = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.struct(c["enc"].alias("enc"), c["m"].alias("m"), x.alias("x"), neighbours.alias("pairs"))

    def tests(c: Column) -> Column:
        m, mean = c["m"], (c["m"] - 1) / 2
        n = F.size(c["x"]).cast("double")
        # sum over symbols of count^2 = n + 2 * pairs of equal symbols; equal ones are neighbours when sorted
        squares = F.aggregate(
            F.array_sort(c["x"]), F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
            lambda s, v: F.struct(v.alias("last"), F.when(v == s["last"], s["run"] + 1).otherwise(1.0).alias("run"), (s["sum"] + 2 * F.when(v == s["last"], s["run"] + 1).otherwise(1.0) - 1).alias("sum")),
            lambda s: s["sum"],
        )
        z1 = (squares * m / n - n - (m - 1)) / F.sqrt(2 * (m - 1) * (1 - 1 / n))
        runs = F.aggregate(c["pairs"], F.lit(0.0), lambda s, p: s + F.when((p["a"] > mean) != (p["b"] > mean), 1.0).otherwise(0.0))
        z2 = F.abs(runs - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        serial = F.aggregate(c["pairs"], F.lit(0.0), lambda s, p: s + (p["a"] - mean) * (p["b"] - mean))
        z3 = F.abs(serial / ((m * m - 1) / 12)) / F.sqrt(n - 1)
        return F.struct(c["enc"].alias("enc"), F.array(z1, z2, z3).alias("z"))

    def fisher(c: Column) -> Column:
        # the chi-squared test has one side, the others have two
        logs = F.transform(c["z"], lambda z, i: F.log(F.least(upper_tail(z) * F.when(i == 0, 1.0).otherwise(2.0), F.lit(1.0))))
        return F.struct(c["enc"].alias("enc"), (-2 * F.aggregate(logs, F.lit(0.0), lambda s, x: s + x)).alias("f"))

    def chance(c: Column) -> Column:
        return F.struct(c["enc"].alias("enc"), (F.exp(-c["f"] / 2) * (1 + c["f"] / 2 + c["f"] * c["f"] / 8)).alias("p"))

    # each step once: bind values by transforming arrays of one element
    step = F.array(F.struct(enc.alias("enc"), token.alias("token")))
    for then in (of_parts, pairs, tests, fisher, chance):
        step = F.transform(step, then)
    return F.element_at(step, 1)


def stratum(enc: Column, length: Column) -> Column:
    """Encoding and length class: powers of sqrt(2) from 20 on, at most 16."""
    return (enc * 16 + F.least(F.lit(15), F.floor(2 * F.log2(length / 20.0)).cast("int"))).cast("int")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base spans by kind, and candidates array<struct<s, e, g, p>> (g: stratum)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("t")).select(
        "doc_id",
        F.when(F.col("t").rlike(ASSIGN_ANY), located(F.col("t"), ASSIGN, 6)).otherwise(none_of(SPAN)).alias("assign"),
        F.when(F.col("t").contains("AKIA"), located(F.col("t"), ACCESS)).otherwise(none_of(SPAN)).alias("access"),
        F.when(F.col("t").rlike(HEX), located(F.col("t"), HEX)).otherwise(none_of(SPAN)).alias("hex"),
        F.when(F.col("t").rlike(TOKEN_ANY), located(F.col("t"), TOKEN)).otherwise(none_of(SPAN)).alias("tokens"),
    )
    mixed = F.filter("tokens", lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]"))
    scored = F.transform(mixed, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), randomness(x["m"]).alias("r")))
    candidates = F.transform(scored, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), stratum(x["r"]["enc"], x["e"] - x["s"]).alias("g"), x["r"]["p"].alias("p")))
    ends = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    return found.select("doc_id", *[ends(k).alias(k) for k in KINDS[:3]], F.when(F.size("tokens") > 0, candidates).otherwise(none_of("struct<s:int,e:int,g:int,p:double>")).alias("candidates"))


def thresholds(scanned: DataFrame) -> dict[int, float]:
    """The least p of each stratum that counts as random; at most 80 strata of BINS bins reach the driver."""
    one = scanned.filter(F.size("candidates") > 0).select(F.explode("candidates").alias("c"))
    bins = one.groupBy(F.col("c.g").alias("g"), F.least(F.floor(F.col("c.p") * BINS), F.lit(BINS - 1)).cast("int").alias("b")).count().collect()
    by: dict[int, list[int]] = {}
    for row in bins:
        by.setdefault(row["g"], [0] * BINS)[row["b"]] += row["count"]
    pooled: dict[int, list[int]] = {}  # an encoding's small strata, or under -1 what is still small then
    home = {g: g for g in by}
    for g, counts in by.items():
        if sum(counts) < LEAST:
            home[g] = -2 - g // 16
            pooled[home[g]] = [a + b for a, b in zip(pooled.get(home[g], [0] * BINS), counts, strict=True)]
    for g in [g for g, counts in pooled.items() if sum(counts) < LEAST]:
        pooled[-1] = [a + b for a, b in zip(pooled.get(-1, [0] * BINS), pooled.pop(g), strict=True)]
    found = {g: least_random(counts) for g, counts in (by | pooled).items()}
    return {g: found[h if h in found else -1] for g, h in home.items()}


def least_random(counts: list[int]) -> float:
    """The least p above which at most a share of FDR of the tokens isn't random, by the upper half of the histogram."""
    total = sum(counts)
    random = min(1.0, sum(counts[BINS // 2 :]) / (0.5 * total))
    above = total
    for b in range(BINS):
        expected = random * total * (1 - b / BINS)
        if above and 1 - expected / above <= FDR:
            return b / BINS
        above -= counts[b]
    return 1.0


def report(scanned: DataFrame, least: dict[int, float]) -> DataFrame:
    """doc_id, spans array<struct<s, k, e>> by start and kind; random ones only outside base spans."""
    def kind(number: int):
        return lambda x: F.struct(x["s"].alias("s"), F.lit(number).alias("k"), x["e"].alias("e"))

    base = F.concat(*[F.transform(k, kind(i)) for i, k in enumerate(KINDS[:3])])
    limit = F.create_map(*[F.lit(v) for g, p in least.items() for v in (g, p)]) if least else F.create_map(F.lit(-1), F.lit(1.0))
    likely = F.filter("candidates", lambda x: x["p"] >= F.coalesce(limit[x["g"]], F.lit(1.0)))

    # candidates are in order; PART of them at a time are held against the base spans between the first and the last
    def by_part(c: Column) -> Column:
        parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(c["all"]) / PART).cast("int") - 1, F.lit(0)))
        return F.transform(parts, lambda i: F.slice(c["all"], i * PART + 1, F.lit(PART)))

    def with_base(part: Column) -> Column:
        first, last = F.get(part, F.lit(0)), F.get(part, F.size(part) - 1)
        return F.struct(part.alias("part"), F.filter("base", lambda b: (b["s"] < last["e"]) & (b["e"] > first["s"])).alias("near"))

    def outside(x: Column) -> Column:
        return F.filter(x["part"], lambda c: ~F.exists(x["near"], lambda b: (b["s"] < c["e"]) & (b["e"] > c["s"])))

    parts = F.element_at(F.transform(F.array(F.struct(likely.alias("all"))), by_part), 1)
    random = F.flatten(F.transform(F.transform(parts, with_base), outside))
    return (
        scanned.withColumn("base", F.sort_array(base))
        .withColumn("random", F.transform(random, kind(3)))
        .withColumn("all", F.sort_array(F.concat("base", "random")))
    )


def written(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_secrets(docs: DataFrame, scratch: shared.Scratch) -> DataFrame:
    scanned = scratch.keep(scan(docs), "scanned")
    return report(scanned, thresholds(scanned))


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(shared.table(spark, sf_dir, "documents"), shared.Scratch(spark, "op1"))
    size = lambda k: F.size(k).cast("long")
    return found.select(
        "doc_id", size("assign").alias("n_assign"), size("access").alias("n_access"), size("hex").alias("n_hex"),
        F.sha2(written("base"), 256).alias("base_sha256"), written("all").alias("spans"), size("random").alias("n_random"),
    )
