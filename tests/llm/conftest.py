import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    syllables = ["tion", "er", "an", "th", "in", "re", "on", "at", "en", "nd"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Null, empty, blank, tiny, long, repeated and nearly repeated texts, with all kinds of white space."""
    rng = random.Random(3)
    base = prose(rng, 300)
    near = base.replace(" ", " x ", 1)
    long = prose(rng, 30_000)
    passage = prose(rng, 60)
    return [
        None, "", " \n\t ", "a", "Ünï çödé — ñ 漢字 words here too", base, base, near, base[:-40] + " changed the end",
        long, prose(rng, 80) + " " + passage + " " + prose(rng, 20), passage + "\n" + prose(rng, 50), "x" * 49, "x" * 50, "x" * 200,
        "line one here\nline one here\n\nline two", "aa " * 100, "mail me at jo.e@mail.example.com or +1 (743) 555-3824 now",
        "don't  stop   <|endoftext|> it's\r\n\r\nfine \x1c odd", "\n\nleading and trailing \n", "0123456789 " * 9,
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i * 3, t, ["en", "fr", None][i % 3], f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
