"""From raw documents to packed token sequences, stage by stage.

Every stage but the last returns the columns of its input.  Rows of one doc_id
are one document: they stay or go together.  Extra columns go through
unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import decontaminate, neardup, packing, pii, shared, toxicity
from docspark.plans.session import ship

#: Documents of this score or more go.
TOXIC = 0.3
#: Words of a shingle for near-duplicates: five, as no contract names another number for this stage (op10's names four).
SHINGLE_WORDS = 5

_open: list[shared.Scratch] = []


def _begin(spark: SparkSession, label: str, first: bool = False) -> shared.Scratch:
    """A stage's folder; those of earlier stages go, as their results are written by now."""
    ship(spark)
    while _open and not first:
        _open.pop().drop()
    _open.append(shared.Scratch(spark, f"pipeline-{label}"))
    return _open[-1]


def _aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but doc_id and text under names that no operator uses; and the way back."""
    names = docs.columns
    moved = docs.toDF(*[c if c in ("doc_id", "text") else f"_{i}_{c}" for i, c in enumerate(names)])
    return moved, lambda df: df.select(*moved.columns).toDF(*names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go; those below a score of TOXIC stay.

    Null and empty texts have no evidence and the score of none, so they stay.
    Repeated rows have equal texts and go or stay alike; a score of exactly
    TOXIC goes.  Very long texts are scored whole.  Without labels, or an empty
    table of them, all stay; an empty table gives an empty one.
    """
    moved, back = _aside(docs)
    labels = shared.table(spark, sf_dir, "labels")
    scored = toxicity.score(moved, labels, _begin(spark, "toxicity", first=True), tuple(moved.columns))
    return back(scored.filter(F.col("score") < TOXIC))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similar word shingles connect, the one with the smallest id stays.

    Null and empty texts have no links and stay, and so do rows without a
    doc_id.  All rows of the id that stays do; where their texts differ, the
    least text speaks for them.  Pairs right at the similarity are links.  Very
    long texts count whole; an empty table gives an empty one.
    """
    scratch = _begin(spark, "neardup")
    found = neardup.near_duplicates(docs, scratch, SHINGLE_WORDS)
    gone = scratch.keep(found.filter("not kept").select("doc_id").distinct(), "gone")
    some = F.broadcast(gone) if gone.count() <= neardup.BROADCAST_IDS else gone
    return docs.join(some, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts have no words and stay, as all do where the benchmark
    is empty.  Each of repeated rows is judged by its own text.  Very long texts
    are searched whole; an empty table gives an empty one.
    """
    moved, back = _aside(docs)
    bench = shared.table(spark, sf_dir, "benchmark")
    found = decontaminate.contamination(moved, bench, _begin(spark, "decontamination"), tuple(moved.columns))
    return back(found.filter("n_hit = 0"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars follows the text.

    Null texts stay null and keep their n_chars, empty ones stay empty.  Of
    overlapping spans one bracket remains, of the kind that begins first.
    Repeated rows change alike, very long texts whole; no row goes, and an
    empty table gives an empty one.
    """
    _begin(spark, "pii")
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in docs.columns else masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of 2048: doc_id, piece, start, length, ids, sequence_id, offset.

    Null and empty texts are the end id alone.  Repeated rows are packed each,
    very long texts in pieces; pieces of equal length take their places in the
    order of tasks and rows.  An empty table gives no piece.
    """
    return packing.pack(docs, _begin(spark, "packing"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: Trained and hashed stages have no SQL; the tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    own = shared.Scratch(spark, "pipeline")
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = own.keep(stage(spark, docs, sf_dir), name)
    return docs
