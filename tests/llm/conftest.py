import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, n int, position string, score string"


def words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and long texts, ties, repeated rows, shared ids, exact and near copies and shared lines."""
    r = random.Random(3)
    line, passage = "The Shared Line.", words(r, 60)
    texts = [words(r, r.randint(1, 80)) + "\n" + words(r, 20) for _ in range(40)]
    texts += [t + "\n  " + line.upper() + "\t" for t in texts[:12]]
    texts += [texts[0], texts[0], texts[1] + " x", texts[1] + " y", None, None, "", " \t\n ", "\n\n", "!!!", "a", words(r, 4000), (line + "\n") * 3]
    texts += [words(r, 10) + "\n" + passage + "\n" + words(r, 5) for _ in range(6)] + [words(r, 8) + " " + passage[20:260] for _ in range(3)] + ["ab" * 150, "ab" * 150 + "c", "x" * 99, "x" * 100, "x" * 201]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["a", "b", None]), None if t is None else len(t), "k", 1, "p", "s") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (3, "another text of the same id", "en", "a", 5, "k", 1, "p", "s"), (None, texts[2], "en", "a", 5, "k", 1, "p", "s"), (None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
