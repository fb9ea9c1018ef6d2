import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "s", "ed", "ing", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty and very long texts, repeated rows, an id with two texts, shared passages, ties."""
    rnd = random.Random(7)
    shared = prose(rnd, 90)
    rows = [(i, prose(rnd, rnd.randint(1, 120))) for i in range(30)]
    rows += [(100 + i, f"{prose(rnd, 20)} {shared} {prose(rnd, 15)}") for i in range(6)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, rows[3][1] + " end"), (203, prose(rnd, 20_000))]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, None), (304, "x" * 60_000), (305, "ab " * 400), (306, "é漢🎉 \x00\x1c\x85\xa0▁"), (307, "one")]
    rows += [(310, shared), (310, shared), (311, rows[5][1]), (311, rows[6][1]), (None, shared), (None, prose(rnd, 30)), (None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The same with sources, languages and columns whose names may clash."""
    extra = [(*r, "name", 1, 2, "z", 3, [1]) for r in odd_rows]
    schema = "doc_id long, text string, id string, n long, key long, fp0 string, size long, found array<int>"
    return spark.createDataFrame(extra, schema).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")
