import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty, white space, repeated rows, ties, a very long text, extra columns with clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog", "en", "a", 43), (2, "the quick  brown fox jumps over the lazy dog", "en", "b", 44), (3, "The quick brown fox\njumps over the lazy dog ", None, None, None),
        (4, None, None, "a", 0), (5, "", "en", "a", 0), (6, " \t\n", "en", "a", 3), (7, "Der schnelle braune Fuchs", "de", "b", 25), (7, "Der schnelle braune Fuchs", "de", "b", 25),
        (None, "id is null", "en", "c", 10), (8, "x" * 50_000, "en", "c", 50_000), (9, "wort " * 20_000, "de", "c", 100_000), (10, "12 34 -- 56", None, "b", 11), (11, "é́ ß 中文 текст", None, "c", 12),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("clash") for c in ("keep_id", "rid", "fp", "size", "score", "_row_id", "lang_pred", "ids_le", "label", "at", "t")})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
