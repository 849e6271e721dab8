"""Shared fixtures of the training-data tests: awkward documents and the session."""

import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """(doc_id, text): nulls, empty texts, blanks, one very long text, exact copies, repeated rows, shared lines."""
    rng = random.Random(7)
    rows = [(i, "\n".join(prose(rng, rng.randrange(1, 40)) for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    shared = "\n".join(prose(rng, 12) for _ in range(5))
    rows += [(100 + i, prose(rng, 5) + "\n" + shared + "\n" + prose(rng, 3)) for i in range(5)]
    rows += [(200, None), (201, ""), (202, "   \n\t "), (203, "é" * 200), (204, "x" * 120 + " " + "ab " * 100)]
    rows += [(300, "\n".join(prose(rng, 30) for _ in range(2000)))]
    rows += [(400, rows[3][1]), (401, rows[3][1]), (5, rows[5][1]), (5, rows[5][1]), (402, rows[4][1].replace("alpha", "omega", 1))]
    return rows


@pytest.fixture(scope="session")
def docs(spark, awkward):
    return spark.createDataFrame(awkward, "doc_id long, text string").repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
