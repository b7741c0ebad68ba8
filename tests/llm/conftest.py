import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def corpus(spark):
    """(doc_id, text, lang, source) of the smallest documents table, as tuples."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    return sorted(tuple(r) for r in rows)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names clash."""
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [
        (1, "one two three four five six", "en", "a", 1, 1.0), (1, "one two three four five six", "en", "a", 1, 1.0),
        (2, None, None, None, None, None), (3, "", "en", "a", 0, 0.0), (None, "one two three four five six", None, "b", 9, 2.0),
        (4, " \t\n ", "en", None, 4, 3.0), (5, long, "en", "b", len(long), 1.0), (6, "ONE two three four five six", "en", "c", 2, 1.0),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, size int, score double")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
