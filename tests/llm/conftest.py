import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_lines int, `part` string, `__extra` string"
LONG = "Lorem " * 30_000
BASE = " ".join(f"w{i}" for i in range(120))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, extra columns with names that operators use."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, LONG, "en", "a", len(LONG)), (5, BASE, "en", "a", 9), (5, BASE, "en", "a", 9), (6, BASE, "en", None, 9),
        (7, BASE + " end", "de", "b", 9), (None, BASE, "de", "b", 9), (None, None, None, None, None), (8, "one two", "fr", "b", 7), (9, "One  two", "fr", "b", 8), (10, "<|endoftext|> x", "fr", "b", 15),
    ]
    return spark.createDataFrame([r + ("s", 1, "p", "x") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def some_labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 11)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.orderBy("doc_id").select("doc_id", "text").collect()}

