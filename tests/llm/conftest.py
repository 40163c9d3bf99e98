import pytest

#: Nulls, empties, repeats, ties, long and odd texts, and columns whose names clash with results.
TEXTS = [
    None, "", "   \n\t", "one two", "the quick brown fox jumps over the lazy dog again and again", "The QUICK brown fox jumps over the lazy dog again and again",
    "é😀\x00 a'll <|endoftext|> ▁x  y\n \n z", "word " * 3000, "日本語テキスト " * 40, "x" * 5000,
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, None if i % 3 == 0 else "en", "s", 1, "clash") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "en", "s", 1, "clash"), (None, "no id here", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, score string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
