import pytest


@pytest.fixture(scope="session")
def words():
    """A made-up vocabulary and a maker of texts from it."""
    import random

    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    return lambda r, n: " ".join(r.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def hard_docs():
    """Rows (doc_id, text, lang, source, n_chars) with nulls, ties, repeats and a long text."""
    return [(1, "a b c d e f g h", "en", "s", 15), (1, "a b c d e f g h", "en", "s", 15), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "x y z", "en", None, 5), (4, " \n\t ", "en", "s", 4), (5, "word " * 30_000, "en", "t", 150_000), (6, "a b c d e f g h", "en", "s", 15), (7, "é ñ 日本 \x85 <|endoftext|> it's", "fr", "s", 9)]


DOCS = "doc_id long, text string, lang string, source string, n_chars long, band long, node string, key string, score string, bucket string"


@pytest.fixture(scope="session")
def hard(spark, hard_docs):
    """The hard rows as a table with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "n", "k", "s", "b") for r in hard_docs], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
