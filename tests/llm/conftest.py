import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row__ string, spans_ string, size bigint"


def words(rng, n):
    return " ".join(rng.choice(["river", "stone", "Light", "of", "the", "a", "winter", "cloud,", "é", "naïve", "12", "end."]) + rng.choice(["", "", "s"]) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(4)
    base = words(rng, 120)
    rows = [(1, base, "en", "a"), (2, base, "en", "b"), (3, base.replace("river", "rivers", 1), "en", None), (3, words(rng, 60), None, "a"), (4, "", "en", "a"), (5, None, "en", "b"), (None, None, None, None), (None, words(rng, 40), "en", "c"), (None, words(rng, 40), "en", "c")]
    rows += [(6, words(rng, 9000), "en", "b"), (7, "one", "en", "c"), (7, "one", "en", "c"), (8, " \n\n \t ", "en", "c"), (9, "x" * 300, "en", "a"), (10, "🙂 漢字 á <|endoftext|> z", "en", "b")]
    rows += [(20 + i, words(rng, rng.randint(1, 90)), "en", "abc"[i % 3]) for i in range(30)]
    return spark.createDataFrame([(*r, len(r[1] or ""), "clash", "clash", -1) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
