import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, _id string, _text string, "
    "_row int, kept string, keep_id string, shard int, block string, ids string, _mark int"
)
WORDS = "the of and to in house river stone light garden winter paper yellow quiet mountain".split()


def prose(draw, n):
    return " ".join(draw.choice(WORDS) + str(draw.randint(0, 60)) for _ in range(n))


def rows_of(pairs, lang="en", source="web"):
    return [(i, t, lang, source, len(t or ""), "x", "y", 1, "k", "z", 7, "b", "w", 3) for i, t in pairs]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, a long text, ties, repeated rows, and columns with clashing names."""
    draw = random.Random(5)
    long = prose(draw, 30_000)
    same = prose(draw, 40)
    pairs = [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, long),
        (5, same),
        (6, same.upper()),
        (7, same),
        (7, same),
        (None, same),
        (None, None),
        (8, "É" + same),
        (9, "é" + same),
        (10, "one two three"),
        (11, "one two three four"),
    ]
    rows = rows_of(pairs)
    rows += [(12, prose(draw, 50), None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def small_rows(small):
    return [(r["doc_id"], r["text"]) for r in small.collect()]


@pytest.fixture(scope="session")
def odd_rows(odd):
    return [(r["doc_id"], r["text"]) for r in odd.collect()]
