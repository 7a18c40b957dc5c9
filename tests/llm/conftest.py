import pytest

LONG = "The word of a very long text with and for " * 3000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empties, a long text, ties, repeated rows, and columns whose names clash with results."""
    rows = [
        (1, None, "en", None, 0), (2, "", "en", "a", 0), (3, "   \n\t ", None, "a", 5), (4, LONG, "en", "a", len(LONG)), (5, "The same text of the day, and more.", "en", "b", 35),
        (6, "The same text of the day, and more.", "en", "b", 35), (6, "The same text of the day, and more.", "en", "b", 35), (7, "x", "en", "b", 1), (8, "éè ça la de un", "fr", "b", 14), (None, "no id of the text", "en", "b", 17),
        (9, "12345 678 !!!", "en", "c", 13), (10, "héé🦆 <|endoftext|> \x1c\x85 word", "de", "c", 20),
    ]
    df = spark.createDataFrame([(*r, "clash", 1.0, "z") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, score double, copy string")
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("1 = 0")


def rows(df, *by):
    return sorted(map(tuple, df.select(*by).collect()), key=str) if by else sorted(map(tuple, df.collect()), key=str)
