import random

import pytest

WORDS = ["alpha", "Beta", "gamma,", "delta", "épsilon", "zeta.", "eta", "THETA", "iota", "kappa", "lambda", "mü"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (str(rng.randint(0, 99)) if rng.random() < 0.3 else "") for _ in range(n))


@pytest.fixture(scope="session")
def rng():
    return random.Random(5)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a long one, ties, repeated rows,
    null and repeated ids, and columns whose names clash with the operators' own."""
    r = random.Random(7)
    long = prose(r, 30_000)
    rows = [(1, None, None, "s"), (2, "", "en", None), (3, " \n\t ", "en", "s"), (4, long, "en", "s"),
            (5, "one", None, "s"), (6, "one two", "en", "s"), (7, prose(r, 60), "en", "s"), (7, prose(r, 40), "fr", "t"),
            (8, "same text here " * 20, "en", "s"), (8, "same text here " * 20, "en", "s"), (9, "same text here " * 20, "en", "s"),
            (None, "same text here " * 20, "fr", None), (None, None, None, None), (10, "\U0001F600 \u00e9\u0301 \x00 x", "fr", "s")]
    extra = [(f"k{i}", i, None, 1.5, "n", i) for i in range(len(rows))]
    schema = ("doc_id long, text string, lang string, source string, batch string, row int, fp string, score double, "
              "kept string, n_words int")
    return spark.createDataFrame([a + b for a, b in zip(rows, extra)], schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
