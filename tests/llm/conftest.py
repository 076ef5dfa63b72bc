from __future__ import annotations

import random

import pytest

SYLLABLES = "an the er on in es re th ti or ea he nd at ed".split()


@pytest.fixture(scope="session")
def words():
    """A maker of invented words, the same at every run."""
    rng = random.Random(5)

    def make(n: int, alphabet=SYLLABLES) -> list[str]:
        return ["".join(rng.choices(alphabet, k=rng.randint(1, 4))) for _ in range(n)]

    return make


@pytest.fixture
def table(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with columns whose names operators also
    use inside."""

    def make(rows):
        full = [
            (*r, *(None,) * (4 - len(r)), None if r[1] is None else len(r[1]), 7, "x", 1.5)
            for r in rows
        ]
        return spark.createDataFrame(
            full,
            "doc_id long, text string, lang string, source string, n_chars long, row int, "
            "word string, n double",
        )

    return make
