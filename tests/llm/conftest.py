import random

import pytest

WORDS = "the of and to harbour lantern copper window meadow quiet seven running stone paper river garden distant velvet engine market silver north winter letter candle".split()


@pytest.fixture(scope="session")
def prose():
    def make(n, seed):
        rng = random.Random(seed)
        out = []
        while n > 0:
            k = min(n, rng.randint(4, 12))
            out.append(" ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ly"]) for _ in range(k)) + ".")
            n -= k
        return " ".join(out)

    return make


@pytest.fixture(scope="session")
def corpus(spark, prose):
    """Documents with nulls, empty and long texts, ties, repeated rows and a clashing extra column."""
    base = [prose(60, i) + "\n" + prose(80, 100 + i) for i in range(12)]
    near = base[0].replace("the ", "teh ", 1)
    texts = [*base, base[0], near, base[1] + "\n" + prose(30, 7), "", None, "one two", "   \n\t", prose(4000, 5), "é" * 30 + "日本語 テキスト 😀"]
    rows = [(i, t, "en", "s", len(t or ""), "x", i) for i, t in enumerate(texts)] + [(3, base[3], "en", "s", 1, "x", 0), (None, base[4], None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, rank long")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
