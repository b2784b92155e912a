import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, id string, key string, score string"


def prose(rng, n):
    syllables = ["the", "of", "an", "er", "in", "th", "on", "re", "ed", "st", "ing", "ou"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(5)
    base = prose(rng, 120)
    texts = [None, "", "   \n\t ", "a", "A b", base, base, base.upper(), base + " x", prose(rng, 30000), "é" * 50, "ﬁn Σίσυφος İ ǅ", "<|endoftext|> it's 12,5%", "日本語 ☃☃ a☃b", "x" * 20000]
    rows = [(i, t, "en" if i % 3 else None, "s", None if t is None else len(t), "?", "?", "?", "?", "?") for i, t in enumerate(texts)]
    rows += [rows[5], rows[0], (None, "no id here", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
