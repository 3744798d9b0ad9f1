from __future__ import annotations

import pytest

# Null and empty texts, ties, white space only, a very long text and a long word; rows with the same doc_id.
LONG = "alpha beta gamma delta " * 30_000


@pytest.fixture(scope="session")
def odd(spark):
    rows = [
        (1, None, None), (2, "", "en"), (3, "   \n\t ", "en"), (4, "one", "en"), (4, "one", "en"), (5, LONG, None), (6, "x" * 70_000, "de"),
        (7, "été ΣΑΣ İstanbul <|endoftext|> it's 日本語 \x1c 42", "fr"), (None, "a null id", "en"),
    ]
    # Further columns whose names operators use inside.
    more = [(*r, "a", 1, "b") for r in rows]
    return spark.createDataFrame(more, "doc_id long, text string, lang string, token string, n int, _doc string")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
