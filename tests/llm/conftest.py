import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

CLASHES = ("score", "n_words", "k", "h", "word", "items", "ids", "key", "spot", "low", "label", "held_out")


def prose(rng: random.Random, words: int, pool: int = 400) -> str:
    return " ".join(rng.choice("the of and to a in".split()) if rng.random() < 0.4 else f"w{rng.randrange(pool)}x" for _ in range(words))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, ties, near and exact copies, columns with the operators' own names."""
    rng = random.Random(8)
    base = prose(rng, 160)
    near = base.replace("w1", "v1", 1)
    rows = [
        (1, base, "en", "s", 1),
        (2, near, "en", "s", 2),
        (3, base, None, None, None),
        (4, None, "en", "s", 4),
        (5, "", "fr", "s", 5),
        (6, " \t\n\x0b\x0c\r ", "fr", None, 6),
        (7, prose(rng, 30_000), "en", "s", 7),
        (8, "été à l'école où ça va <|endoftext|> 你好 مرحبا 😀", "fr", "s", 8),
        (9, "one", "de", "s", 9),
        (9, "one", "de", "s", 9),
        (10, "x " * 300, "de", "s", 10),
        (None, base, "en", "s", 11),
        (11, "Tel +1 (212) 555-0142, bob@example.org, 10.0.0.1, 4111 1111 1111 1111.", "en", "s", 12),
        (12, prose(rng, 20) + " " + " ".join(base.split()[:70]) + " " + prose(rng, 20), "en", "s", 13),
        (13, "a" * 5000, "en", "s", 14),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(*r, *("?" for _ in CLASHES)) for r in rows], schema).repartition(3)
