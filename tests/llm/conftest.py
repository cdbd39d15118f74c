import random

import pytest

WORDS = "ba be bi bo da de di do fa fe fi fo ga ge gi go la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to".split()


def prose(r: random.Random, n: int, syllables=WORDS) -> str:
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, piece int, _key int, n_words string"


@pytest.fixture(scope="session")
def odd_rows():
    """Rows with nulls anywhere, empty and very long texts, repeats, and extra columns with clashing names."""
    r = random.Random(9)
    same = prose(r, 60)
    near = same.split()
    near[30] = "changed"
    texts = [None, "", "  \n\t ", "one", "one", same, same, " ".join(near), prose(r, 60_000), "é" * 500, "<|endoftext|> a", "x" * 5000, "<|endoftext|>", same.upper()]
    rows = [(i, t, None if i % 5 == 0 else "en", None, None, "s", 1, 2, "w") for i, t in enumerate(texts)]
    rows += [(None, "one", "en", "src", 3, None, None, None, None), (None, None, None, None, None, None, None, None, None), rows[5], rows[5], (5, "another text", "en", None, None, None, None, None, None)]
    rows += [(100 + i, prose(r, 40), "en", "a", 1, None, None, None, None) for i in range(10)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(4)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
