"""Small document tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

import pytest

COLS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, `key` string, `a.b` int, _row int"
PLAIN = "doc_id long, text string, lang string, source string, n_chars long"


def make_rows():
    r = random.Random(3)
    words = ["the", "and", "of", "to", "in", "tion", "er", "house", "réseau", "größe", "día"]
    base = [" ".join(r.choice(words) + str(r.randrange(30)) for _ in range(60)) for _ in range(12)]
    rows = []
    for i, t in enumerate(base):
        rows.append((i, t, "en", "a", len(t)))
    near = base[0].split(" ")
    for k in range(5):  # near copies: one word changed
        w = list(near)
        w[10 + 7 * k] = "changed"
        rows.append((100 + k, " ".join(w), "en", "b", 1))
    rows += [(200, base[1], "en", "c", 2), (201, base[1], "en", None, 2), (202, base[1].upper(), "en", "c", 2)]
    rows += [(300, None, "de", "a", None), (301, "", None, "a", 0), (302, " \n\t ", "de", None, 3), (303, "one two", "en", "d", 7),
             (304, "One  TWO\n", "en", "d", 8), (305, "12 34 !!", "en", "d", 8)]
    rows += [(None, "no id here", "en", "a", 1), (None, None, None, None, None), (None, "no id here", "en", "a", 1)]
    rows += [(400, base[2], "en", "a", 5), (400, base[2], "en", "a", 5), (400, base[3], "fr", "a", 6)]
    rows.append((500, " ".join(f"w{k}" for k in range(30_000)), "en", "e", 1))
    rows.append((501, "x" * 50_000, "en", "e", 1))
    return rows


ROWS = make_rows()


@pytest.fixture(scope="session")
def docs(spark):
    """The rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, True, "k", i, i) for i, r in enumerate(ROWS)], COLS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLS)
