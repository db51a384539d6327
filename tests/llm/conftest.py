import pytest

LONG = "alpha beta gamma delta " * 20_000


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows and rows of one id."""
    text = "The quick brown fox jumps over the lazy dog and then it sleeps under the old oak tree until the sun is low again"
    return [
        (1, text, "en"), (2, text, "en"), (2, text, "en"), (3, None, None), (4, "", "en"), (5, " \t\n", "de"), (6, LONG, "en"), (7, "x", "fr"),
        (8, text.replace(" ", "  "), "en"), (None, text, "en"), (9, "token = 'abcdef0123456789abcdef'", "en"), (9, "öäü ß 中文 \U0001f600", "de"),
        (10, "The quick brown fox", "en"), (11, "the QUICK brown\nfox", "en"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with extra columns whose names clash with those of the operators."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows, "doc_id bigint, text string, lang string")
    extra = ["kept", "quality", "row", "found", "blob", "_file", "_row", "_digest", "rank", "length", "fp", "key", "arc", "n", "value", "_text", "_part"]
    return docs.withColumns({c: F.lit(c) for c in extra}).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
