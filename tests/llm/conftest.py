import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, row_id string, print string"


def messy():
    """Rows with nulls everywhere, empty and long texts, ties, repeats, and columns named as operators name theirs."""
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma,", "δέλτα", "of", "the", "tion", "x" * 30, "漢字", "é", "1,5", "don't"]
    body = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = body(120)
    rows = [(1, base), (2, base), (3, base.replace(" ", "\n")), (3, base.replace(" ", "\n")), (4, None), (5, ""), (6, " \t\n"), (None, "one two three"), (None, None), (7, body(4000)), (8, "a" * 5000), (9, base[:300] + " tail " + body(80)), (10, "tail " + base[100:500]), (11, "!!! ### 12"), (12, base + " end"), (13, "\0 nul \0"), (14, " wide space\u0085"), (15, "one two"), (16, "\U0001F600 " * 60)]
    rows += [(100 + i, body(rng.randint(1, 150))) for i in range(30)]
    return [(d, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s2", "s2", None, "ß"]), None, 5, "k", "r", "p") for d, t in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(messy(), COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
