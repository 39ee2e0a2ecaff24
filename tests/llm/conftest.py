import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, fp string, key string, content string, i string, t string,"
    " same int, root string, node string, __id int, __digest string, __row string, __stay boolean, kept_id int, KEPT_ROW int, stays string, copies string, `a.b` string"
)
EXTRA = (7, "r", "n", 5, "d", "r", False, 3, 4, "no", "c", "x")


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empties, a very long text, ties, repeated rows, and columns whose names operators use themselves."""
    rng = random.Random(9)
    long = words(rng, 30_000)
    base = words(rng, 60)
    texts = [(1, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (6, long), (7, words(rng, 3)), (8, words(rng, 2)), (9, base + " x"), (9, base + " x"), (10, base), (None, words(rng, 20)), (None, base)]
    return [(i, t, "en", "s", len(t or ""), 0.1, "d", "f", "k", "c", "i", "t", *EXTRA) for i, t in texts]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
