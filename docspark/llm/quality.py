"""Operator 4: quality rules and host-level verdicts, with DataFrame functions only.

Rules look at one document each.  A host's failure rate is shrunk towards all
hosts' rates with a beta prior fitted to them by moments, so that hosts with
few documents are judged by the prior; a host whose shrunk rate stays above
``HOST_LIMIT`` by ``HOST_Z`` posterior deviations loses all its documents.

Null and empty texts have no words and fail the base rule.  Documents with a
null host have no host verdict.  Ties and repeated rows are judged each on
their own.  Extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
HOST_LIMIT = 0.5
HOST_Z = 3.0


def repeated_words(grams: Column) -> Column:
    """Words in windows that occur twice or more; grams: array of window hashes by position."""
    by_hash = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(sorted_one: Column) -> Column:
        twice = F.filter(sorted_one, lambda x, k: (x["h"] == F.get(sorted_one, k - 1)["h"]) | (x["h"] == F.get(sorted_one, k + 1)["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        fresh = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), p - F.coalesce(F.get(at, k - 1), p - WINDOW)))
        return F.aggregate(fresh, F.lit(0), lambda s, x: s + x)

    # values that are used again are bound by transforming arrays of one element
    return F.element_at(F.transform(F.transform(F.array(by_hash), places), covered), 1)


def rules(docs: DataFrame) -> DataFrame:
    """doc_id, host and the rules' figures."""
    t, words, hashes, grams = F.col("t"), F.col("words"), F.col("hashes"), F.col("grams")
    space = r"[\x20\x09-\x0D]+"
    split = docs.select("doc_id", F.col("source").alias("host"), F.coalesce("text", F.lit("")).alias("t")).withColumn(
        "words", F.split(F.btrim(t, F.lit(SPACE)), space)
    )
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    none = F.array().cast("array<bigint>")
    hashed = split.select(
        "doc_id", "host",
        F.when(F.element_at(words, 1) == "", F.lit(0)).otherwise(F.size(words)).cast("long").alias("n_words"),
        F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.when(F.instr(t, "\n") > 0, F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0]).otherwise(0).cast("long").alias("n_dup_lines"),
        F.when(F.size(words) > WINDOW, F.transform(words, lambda w: F.xxhash64(w))).otherwise(none).alias("hashes"),
    )
    window = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])
    counted = hashed.withColumn("grams", F.when(F.size(hashes) > WINDOW, F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), window)).otherwise(none))
    twice = F.size(F.array_distinct(grams)) < F.size(grams)
    return counted.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(twice, repeated_words(grams)).otherwise(0).cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def host_verdicts(figures: DataFrame) -> DataFrame:
    """host, n, failed, rate (shrunk), rejected: one row per host."""
    hosts = figures.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    # one row: moments of the hosts' rates, each weighted by its documents
    rate = F.col("failed") / F.col("n")
    one = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.count("*").alias("k"), F.sum(F.col("n") * rate * rate).alias("squares"), F.sum(F.col("n") * F.col("n")).alias("n2")).first()
    a, b = beta_prior(one["n"] or 0, one["failed"] or 0, one["k"] or 0, one["squares"] or 0.0, one["n2"] or 0)
    alpha, beta = F.col("failed") + a, F.col("n") - F.col("failed") + b
    mean = alpha / (alpha + beta)
    deviation = F.sqrt(mean * (1 - mean) / (alpha + beta + 1))
    return hosts.select("host", "n", "failed", mean.alias("rate"), (mean - HOST_Z * deviation > HOST_LIMIT).alias("rejected"))


def beta_prior(n: int, failed: int, hosts: int, squares: float, n2: int) -> tuple[float, float]:
    """The beta prior whose mean and spread match the hosts' rates; binomial noise is taken off the spread."""
    if not n:
        return 1.0, 1.0
    mean = min(max(failed / n, 1e-4), 1 - 1e-4)
    between = squares / n - mean * mean
    effective = n - n2 / n
    variance = (between * n - (hosts - 1) * mean * (1 - mean)) / effective if effective > 0 else 0.0
    strength = min(1000.0, max(2.0, mean * (1 - mean) / variance - 1)) if variance > 0 else 1000.0
    return mean * strength, (1 - mean) * strength


def judge(docs: DataFrame, scratch: shared.Scratch) -> DataFrame:
    """The rules' figures of each document, its host's shrunk rate, and kept."""
    figures = scratch.keep(rules(docs), "figures")
    rejected = host_verdicts(figures).filter("rejected").select("host", F.lit(True).alias("host_rejected"))
    joined = figures.join(rejected, "host", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_rejected").isNull())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = judge(shared.table(spark, sf_dir, "documents"), shared.Scratch(spark, "op4"))
    return figures.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
