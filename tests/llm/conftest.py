import pytest

LONG = " ".join(f"wörd{i % 977} tail" for i in range(60_000))


@pytest.fixture(scope="session")
def edge_texts():
    """Nulls, empty and white-space texts, one word, ties, a very long text, odd signs."""
    return [None, "", " \t\n ", "one", "a b c", "two words\ntwo words\n\n", "same text here for all of us today", "same text here for all of us today", LONG, "it's 1 2   — “q”  x\x1cy <|endoftext|>", "日本語 テスト 😀 ok", "\n".join(["x y z"] * 50)]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_texts):
    """The texts by doc_id, the first row twice, with extra columns of names that operators use."""
    rows = [(i, t, "en", "h1" if i % 2 else None, len(t or ""), "extra", 1.0) for i, t in enumerate(edge_texts)]
    rows.append(rows[6])
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, score double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark, edge_docs):
    return edge_docs.filter("doc_id < 0")


@pytest.fixture
def scratch(spark, tmp_path):
    from docspark.llm import shared

    made = shared.Scratch(spark, "test")
    yield made
    made.drop()
