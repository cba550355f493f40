import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_tables import table  # noqa: E402


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long, repeated, in several scripts, with odd characters."""
    rng = random.Random(11)
    words = ["the", "Of", "and", "Ärger", "niño", "日本語", "don't", "x", "1234", "a,b.", "ΑΣ", "İ", "é", "token=abcdef1", "AKIA" + "Z" * 16]
    prose = [" ".join(rng.choices(words, k=rng.randint(1, 60))) + rng.choice(["", "\n", "\n\n"]) + " ".join(rng.choices(words, k=30)) for _ in range(60)]
    long = " ".join(rng.choices(words, k=60_000))
    return [None, "", "   \t", "\n", long, long + " end", "x" * 50_000, "a\x1cb \x85c\u2028d", "<|endoftext|> a", "\U0001f600" * 5, *prose, *prose[:9], prose[0]]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    return table(spark, odd_texts)


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, [])
