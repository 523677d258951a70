"""Documents with every odd case, and what each operator must return for them."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, _key long, _id long, _row string, print string, size long, n long, toxic int, a int, b int, spans string, bucket int, target double, taken int, copy int, finish double, shard int, votes int"


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "Alpha", "beta", "gamma,", "delta.", "eps", "zeta", "idiot", "été", "x1"]) for _ in range(n))


def odd_rows():
    rng = random.Random(5)
    texts = [None, "", "   \n\t ", "one", "two words", words(rng, 40), words(rng, 20_000)]
    base = words(rng, 60)
    texts += [base, base, base.replace("beta", "Beta", 1), base + " tail", "l1\nl2\nl3\nl4\nl5", "x\nl1\nl2\nl3\nl4\ny", "l1\nl2\nl3\nl1\nl2\nl3"]
    texts += ["Foo bar.\nReleased under the MIT License.", "x" * 30_000, "é" * 500, "idiot moron stupid"]
    texts += [words(rng, rng.randint(1, 80)) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 4}", None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[7], (None, "null id text here", None, None, None), (None, base, "de", None, 3), (None, None, None, None, None), (3, "another text of doc 3", "fr", "s1", 9)]
    clash = ("z", "z", 1, 2, "r", "p", 3, 4, 1, 5, 6, "s", 7, 1.0, 8, 9, 2.0, 10, 11)
    return [(*r, *clash) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
