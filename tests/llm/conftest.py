import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, digest string, bucket string, rep string, label string, verdict string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and further columns whose names operators use themselves."""
    long_text = " ".join(f"word{i % 977} the and" for i in range(30_000))
    texts = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today."), (2, None), (3, ""), (4, "   "), (5, "123 456 !!"),
        (6, "The quick brown fox jumps over the lazy dog near the river bank today."), (7, long_text), (7, long_text), (8, None), (9, "one"), (10, "One two"),
        (11, "é ▁ 😀 \x00 \u2028 don't  stop <|endoftext|> <s>"), (12, "tab\there\r\nnew"), (None, "a row without an id"), (None, None), (13, "stupid idiot you are a worthless loser and pathetic scum"),
    ]
    return spark.createDataFrame([(i, t, None if i in (2, 5) else "en", None, None, "x", "x", "x", "x", "x", "x", "x") for i, t in texts], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
