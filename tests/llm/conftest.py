import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in "bcdfglmr" for b in "aeiou" for c in ("n", "st", "rt", "lo", "")]


@pytest.fixture
def prose():
    rng = random.Random(7)
    return lambda n: " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text)."""
    return lambda rows: spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
