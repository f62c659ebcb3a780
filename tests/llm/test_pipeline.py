"""The pipeline, stage by stage, against plain versions of each stage's rule."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docspark.llm import packing


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 7)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(160)]
    item = " ".join(word() for _ in range(15))
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(200, clean[0]), (201, clean[1] + " end"), (202, f"{clean[2][:100]} {item} x"), (203, "write to me@host.org or 10.0.0.1"), (204, None), (205, "")]
    rows += [(300 + i, f"{word()} zorkish vileful {word()} zorkish scumble " + " ".join(word() for _ in range(30))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"), F.lit(0.5).alias("score"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(160)] + [(300 + i, 0, 1) for i in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    ids, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, corpus).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name == "personal_data":
            texts = {r["doc_id"]: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == columns
    toxic, near, leak, private, packed = ids
    assert not {i for i in toxic if i >= 300} and toxic >= set(range(160)) | {200, 201, 202, 203, 204, 205}
    assert toxic - near == {200, 201}
    assert near - leak == {202}
    assert private == leak == packed
    assert texts[203]["text"] == "write to [EMAIL] or [IP]" and texts[203]["n_chars"] == 24 and texts[204]["text"] is None and texts[5]["score"] == 0.5
    by = collections.Counter()
    for r in docs.collect():
        by[r["sequence_id"]] += r["length"]
    assert max(by.values()) <= packing.CAPACITY and len(by) <= sum(by.values()) / packing.CAPACITY * 1.2 + 1


def test_stages_on_odd_rows_and_empty_tables(spark, corpus, tmp_path):
    """Nulls, repeated rows and ids go through; a stage on no rows gives none, and empty side tables reject nothing."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    odd = spark.createDataFrame([(900, None, None, None, None, None), (901, "", "en", "s", 0, 0.1), (None, "no id here", "en", "s", 10, 0.1), (902, "x", "en", "s", 1, 0.1), (902, "x", "en", "s", 1, 0.1)], docs.schema)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), corpus).count() == 0, name
        kept = stage(spark, odd, str(tmp_path))
        assert kept.count() == odd.count(), name
        if name != "packing":
            assert sorted(map(str, kept.collect())) == sorted(map(str, odd.collect())) and kept.columns == odd.columns


def test_run(spark, corpus):
    assert corpus_pipeline.run(spark, corpus).columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
