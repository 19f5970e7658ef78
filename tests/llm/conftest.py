import pytest

DOCUMENT = "doc_id long, text string, kept string, text_sha256 string, score string, source string, lang string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls, blanks, a very long text, ties, repeated rows, and extra columns whose names clash with results."""
    words = " ".join(f"word{k} again" for k in range(40_000))
    rows = [
        (1, "a b c d e f g h"), (2, "a b  c d e f g h"), (3, "A B C D E F G H"), (3, "A B C D E F G H"), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r"), (None, "a b c d e f g h"), (None, None),
        (7, words), (8, words + " end"), (9, "é漢🙂 é漢🙂"), (10, "x"), (11, "x"), (12, "token = 'abcdefghijkl0123'"), (13, "\x00\x01"), (14, "a" * 3000), (15, "ab" * 1500),
    ]
    full = [(i, t, "clash", "clash", "clash", None if i == 9 else "s1", None, None) for i, t in rows]
    return spark.createDataFrame(full, DOCUMENT)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENT)
