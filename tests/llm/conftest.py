from __future__ import annotations

import random

import pytest

WORDS = [a + b for a in "ba co di fu ge hi jo ku la me".split() for b in "n r s t x".split()]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with every awkward case: nulls, empty texts, repeated rows, a
    very long text, clashing extra columns."""
    def make(rows, columns="doc_id bigint, text string, lang string, source string, n_chars bigint, class string, tokens int, key int"):
        full = [(*r, *[None] * (columns.count(",") + 1 - len(r))) for r in rows]
        return spark.createDataFrame(full, columns)

    return make
