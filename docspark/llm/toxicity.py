"""Operator 6: maximum-scoring segments over token log-odds.

Tokens are a word and its prefixes.  Their log-odds between toxic and other
documents come from corpus-wide counts of labelled documents, with an
informative Dirichlet prior (the rates in these labelled documents of either
kind, not in the unlabelled ones), and shrink by their standard deviation.  One
fold of the labelled documents, weighed by what the others tell, calibrates
scores.  Near copies of one label share one document's weight.  Every position
scores the largest absolute of its word's
and prefixes' log-odds, less a drift; a linear-time scan finds all maximal
scoring segments (Ruzzo and Tompa), each candidate linked with the nearest one
to its left that begins at a smaller sum.  A segment's chance of as high a score in
clean text of the same length follows a Gumbel law whose scale and search
constant are fitted to clean labelled documents; the significant ones add up to
a document's evidence, and a logistic curve fitted to the labelled documents
gives its score.

Labels are learned from rows whose crc32(doc_id as text) mod 4 isn't 2; labels,
lang, source and doc_id are no inputs of a score.  Null and empty texts have
no segment and get the score of no evidence.  Without labels of both kinds
every score is the share of toxic labels (0 without labels).  Repeated rows get
a row each; a document with several labels is toxic if one says so.  Very long
texts are scored whole; of segments with equal sums the earlier begins stay.
Empty tables give no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import neardup, shared

#: Labelled documents that the scorer is fitted on at most, of the least hashed ids (about; a documented bound of the classifier).
LABELLED = 200_000
#: Lengths of prefixes beside whole words.
PREFIXES = (3, 4, 5, 6)
#: Prior weight in documents; a token counts from so many toxic documents on.
PRIOR, LEAST_DOCUMENTS = 10.0, 3
#: Deviations by which log-odds are shrunk; per-word drift of the scan; toxic tokens weigh this much at least.
SHRINK, DRIFT, LEAST_WEIGHT = 1.0, 0.15, 1.5
#: Chance per document under which a segment is significant.
SIGNIFICANT = 0.01
LOG_SIGNIFICANT = math.log(SIGNIFICANT)
#: Documents of one label are near copies if so many of their least shingle hashes are the same.
MINIMA = 4
WORD = re.compile(r"[^\W\d_]+")


def token_sets(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return {f"={w}" for w in words} | {w[:k] for w in words for k in PREFIXES if len(w) >= k}


def counted(labelled: DataFrame) -> DataFrame:
    """token and, of documents that hold it: toxic and clean ones, and of either those of the fold for calibration.

    Input: text, toxic, fold, size; of size near copies each counts 1/size.
    """
    names = ["toxic", "clean", "toxic_fold", "clean_fold"]

    def run(batches):
        for batch in batches:
            by: dict[str, list[float]] = {}
            for text, toxic, fold, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for token in token_sets(text or ""):
                    x = by.setdefault(token, [0.0, 0.0, 0.0, 0.0])
                    k = 0 if toxic else 1
                    x[k] += 1 / size
                    x[k + 2] += fold / size
            numbers = np.array(list(by.values()), np.float64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.string()), *(pa.array(numbers[:, k]) for k in range(4))], names=["token", *names])

    parts = labelled.select("text", "toxic", "fold", "size").mapInArrow(run, "token string, toxic double, clean double, toxic_fold double, clean_fold double")
    return parts.groupBy("token").agg(*[F.sum(n).alias(n) for n in names])


def log_odds(counts: DataFrame, toxic: float, clean: float) -> dict[str, float]:
    """Shrunk log-odds of all tokens that tell; LABELLED bounds the texts that they come from. counts: token, toxic, clean."""
    alpha = PRIOR * (F.col("toxic") + F.col("clean") + 0.5) / (toxic + clean + 1) + 0.5
    a, b = F.col("toxic") + alpha, F.col("clean") + alpha
    odds = F.log(a / (toxic + PRIOR + 1 - a)) - F.log(b / (clean + PRIOR + 1 - b))
    weight = F.signum(odds) * F.greatest(F.abs(odds) - SHRINK * F.sqrt(1 / a + 1 / b), F.lit(0.0))
    often = (F.col("toxic") >= LEAST_DOCUMENTS) | (F.col("clean") >= 20 * LEAST_DOCUMENTS)
    told = counts.filter(often).select("token", weight.alias("weight")).filter((F.col("weight") > LEAST_WEIGHT) | (F.col("weight") < -1))
    told = told.toPandas()
    return dict(zip(told["token"], told["weight"], strict=True))


class Scorer:
    """Segments and scores of texts under a model."""

    def __init__(self, weights: dict[str, float], scale: float = 1.0, constant: float = 1.0, curve: tuple[float, float] = (1.0, 0.0)):
        self.weights, self.scale, self.constant, self.curve = weights, scale, constant, curve
        self.memory: dict[str, float] = {}

    def word(self, w: str) -> float:
        get = self.weights.get
        best = get("=" + w, 0.0)
        for k in PREFIXES:
            if len(w) >= k:
                x = get(w[:k], 0.0)
                if abs(x) > abs(best):
                    best = x
        if len(self.memory) > 100_000:
            self.memory.clear()
        self.memory[w] = best - DRIFT
        return best - DRIFT

    def segments(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """All maximal scoring segments (first word, past-last word, score), and the number of words.

        Only words of positive score can begin or end one, so the scan steps
        from one of these to the next with the sums between them.
        """
        words = WORD.findall(text.lower())
        memory = self.memory
        try:
            s = [memory[w] for w in words]
        except KeyError:
            s = [memory[w] if w in memory else self.word(w) for w in words]
        x = np.array(s)
        at = np.flatnonzero(x > 0)
        if not len(at):
            return [], len(words)
        sums = np.concatenate([[0.0], np.cumsum(x)])
        # first, past-last, sum before, sum after, and the last candidate to the left whose sum before is less
        found: list[tuple[int, int, float, float, int]] = []
        for i, before, after in zip(at.tolist(), sums[at].tolist(), sums[at + 1].tolist(), strict=True):
            first = i
            j = len(found) - 1
            while True:
                while j >= 0 and found[j][2] >= before:
                    j = found[j][4]
                if j < 0 or found[j][3] >= after:
                    found.append((first, i + 1, before, after, j))
                    break
                first, _, before, _, left = found[j]
                del found[j:]
                j = left
        return [(a, b, r - l) for a, b, l, r, _ in found], len(words)

    def evidence(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """-log of the least chance, summed over the significant segments; and these."""
        found, n = self.segments(text)
        total, kept = 0.0, []
        for a, b, score in found:
            # P(max > score) = 1 - exp(-K n exp(-scale * score))
            log_expected = math.log(self.constant * max(n, 1)) - self.scale * score
            # for small chances the expected number is the chance, and its logarithm has no bound
            log_chance = log_expected if log_expected < -20 else math.log(-math.expm1(-math.exp(min(log_expected, 700.0))))
            if log_chance < LOG_SIGNIFICANT:
                kept.append((a, b, score))
                total -= log_chance
        return total, kept

    def score(self, evidence: float) -> float:
        a, b = self.curve
        z = a * math.log1p(evidence) + b
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def gumbel(maxima: np.ndarray, number: np.ndarray, words: float) -> tuple[float, float]:
    """Scale and constant of clean documents' largest segments, from a histogram.

    maxima: scores, in any order; number: documents of each; words: of all
    clean documents.  Those whose largest segment is 0 bound the tail from
    below; the scale is that of the excesses over the median of the positive
    ones.
    """
    on = maxima > 0
    order = np.argsort(maxima[on], kind="stable")
    x, n = maxima[on][order], number[on][order].astype(float)
    if n.sum() < 20:
        return 1.0, 0.05
    level = float(x[np.searchsorted(np.cumsum(n), n.sum() / 2)])
    above = x > level
    scale = 1.0 / max(1e-3, float(np.average(x[above] - level, weights=n[above]))) if above.any() else 1.0
    # expected number above the level per word = K exp(-scale * level)
    share = float(n[above].sum()) / max(1.0, words)
    return scale, max(1e-9, share * math.exp(min(500.0, scale * level)))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a little ridge; x may be a histogram with weights."""
    beta = np.array([1.0, -2.0])
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (w * (y - p)) - 1e-3 * beta
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def learned(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2


def sketches(labelled: DataFrame) -> DataFrame:
    """text, toxic, fold and a hash of the MINIMA least hashes of five-word shingles, which near copies mostly share."""

    def run(batches):
        for whole in batches:
            for batch in shared.slices(whole, "text", 4 << 20):
                least = [int.from_bytes(hashlib.blake2b(x[:MINIMA].tobytes(), digest_size=8).digest(), "little", signed=True) for x in neardup.shingle_sets(batch.column(0), 5)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=[*batch.schema.names, "sketch"])

    return labelled.mapInArrow(run, "text string, toxic boolean, fold int, sketch bigint")


def weighed(sketched: DataFrame) -> DataFrame:
    """The rows and size, the number of near copies of the same label."""
    groups = sketched.groupBy("sketch", "toxic").agg(F.count("*").cast("double").alias("copies")).filter("copies > 1")
    return sketched.join(F.broadcast(groups), ["sketch", "toxic"], "left").withColumn("size", F.coalesce("copies", F.lit(1.0)))


def train(docs: DataFrame, labels: DataFrame, scratch: shared.Scratch) -> tuple[Scorer | None, float]:
    """A scorer from the labelled documents that may be learned from, and the share of toxic ones."""
    told = labels.filter(F.col("toxic").isNotNull() & learned("doc_id")).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    told = scratch.keep(told, "told")
    number = told.count()
    if number > LABELLED:
        told = told.filter(F.pmod(F.xxhash64("doc_id"), F.lit(number)) < LABELLED)
    # at most about LABELLED rows of a few bytes, so both broadcasts are bounded and no text is shuffled
    chosen = docs.select("doc_id", "text").join(F.broadcast(told), "doc_id")
    fold = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 3).cast("int")
    sketched = scratch.keep(sketches(chosen.select("text", "toxic", fold.alias("fold"))), "sketched")
    labelled = weighed(sketched)
    kinds = {(r["toxic"], r["fold"]): r["n"] for r in labelled.groupBy("toxic", "fold").agg(F.sum(1 / F.col("size")).alias("n")).collect()}
    number = lambda toxic, *folds: sum(kinds.get((toxic, f), 0) for f in folds)
    toxic, clean = number(True, 0, 1), number(False, 0, 1)
    if not toxic or not clean:
        return None, toxic / (toxic + clean) if toxic + clean else 0.0
    counts = scratch.keep(counted(labelled), "counts")
    scorer = Scorer(log_odds(counts.select("token", "toxic", "clean"), toxic, clean))
    # calibrate on a fold with weights from the others; where a fold lacks a kind, all serve for both
    folds = all(number(k, f) for k in (True, False) for f in (0, 1))
    others = counts.select("token", (F.col("toxic") - F.col("toxic_fold")).alias("toxic"), (F.col("clean") - F.col("clean_fold")).alias("clean"))
    part = log_odds(others, number(True, 0), number(False, 0)) if folds else scorer.weights
    calibration = labelled.filter("fold = 1") if folds else labelled
    shipped = docs.sparkSession.sparkContext.broadcast(part)

    def largest(batches):
        own = Scorer(shipped.value)
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, words = own.segments(text or "")
                rows.append((bool(toxic), words, max((s for *_, s in found), default=0.0)))
            yield pa.RecordBatch.from_pydict({"toxic": [r[0] for r in rows], "words": [r[1] for r in rows], "top": [r[2] for r in rows]})

    tops = calibration.select("text", "toxic").mapInArrow(largest, "toxic boolean, words bigint, top double").withColumn("bin", F.round(F.col("top"), 1))
    # a histogram: bins of 0.1 of scores that the weights bound
    tops = tops.filter("not toxic").groupBy("bin").agg(F.count("*").alias("n"), F.sum("words").alias("words")).toPandas()
    scorer.scale, scorer.constant = gumbel(tops["bin"].to_numpy(float), tops["n"].to_numpy(float), float(tops["words"].sum()))
    form = (scorer.scale, scorer.constant)

    def weigh(batches):
        own = Scorer(shipped.value, *form)
        for batch in batches:
            e = [own.evidence(t or "")[0] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.round(np.log1p(e), 2))], names=["toxic", "x"])

    bins = calibration.select("text", "toxic").mapInArrow(weigh, "toxic boolean, x double").groupBy("x", "toxic").count().toPandas()
    scorer.curve = logistic(bins["x"].to_numpy(), bins["toxic"].to_numpy().astype(float), bins["count"].to_numpy().astype(float))
    return scorer, toxic / (toxic + clean)


SEGMENTS = "array<struct<first:int,last:int,score:double>>"


def score(docs: DataFrame, labels: DataFrame, scratch: shared.Scratch, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns ``keep``, score and the significant segments (words, last excluded)."""
    scorer, share = train(docs, labels, scratch)
    form = (scorer.scale, scorer.constant, scorer.curve) if scorer else None
    weights = docs.sparkSession.sparkContext.broadcast(scorer.weights if scorer else {})

    def run(batches):
        own = Scorer(weights.value, *form) if form else None
        for whole in batches:
            for batch in shared.slices(whole, "text", 4 << 20):
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                found = [own.evidence(t or "") if own else (0.0, []) for t in texts]
                scores = [own.score(e) if own else share for e, _ in found]
                spans = [[{"first": a, "last": b, "score": s} for a, b, s in kept] for _, kept in found]
                columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64()), pa.array(spans, kind)], names=[*keep, "score", "segments"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{kinds}, score double, segments {SEGMENTS}")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"), shared.Scratch(spark, "op6"))
    held = ~learned("doc_id")
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("segments").cast("long").alias("n_segments"))
