import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, fp string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty, blank and long texts, ties, repeated rows, clashing column names."""
    rng = random.Random(3)
    long = prose(rng, 30_000)
    base = prose(rng, 80)
    texts = [
        (1, base, "xx", "a"),
        (2, base, None, "a"),
        (2, base, None, "a"),
        (3, base + " tail", "xx", None),
        (4, None, "xx", "b"),
        (5, "", None, "b"),
        (6, " \t\n \n", "yy", None),
        (7, long, "yy", "c"),
        (8, "x" * 5000, "yy", "é"),
        (None, "no id here at all", "xx", "c"),
        (None, None, None, None),
        (9, "ends\n\nwith breaks\n", "xx", "a"),
        (2**62, "\U0001f600 ▁ mark \u0000 nul", "xx", "𝕏"),
        (-3, "short", "yy", "a"),
    ]
    return [(i, t, lang, s, 0, "r", "i", "f") for i, t, lang, s in texts]


@pytest.fixture
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
