"""Small awkward tables for the corpus operators."""

import random

import pytest

# nulls in every column, empty and white-space texts, repeats, ties, extra columns with clashing names
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, score string, _row int, queue string"


def make_docs(n=120, seed=5):
    r = random.Random(seed)
    words = ["the", "river", "runs", "Ünder", "old", "bridges", "and", "turns", "north.", "日本語", "naïve", "x", "don't", "42"]
    rows = []
    for i in range(n):
        text = " ".join(r.choices(words, k=r.randint(1, 60)))
        rows.append([i, text, r.choice(["en", "de", None]), r.choice(["a", "a", "b", "c", None]), len(text)])
    rows[3][1] = None
    rows[4][1] = ""
    rows[5][1] = " \t\n "
    rows[6][1] = "  two  spaces \n and   more　wide\x85 end  "
    rows[7][1] = rows[8][1] = rows[9][1] = rows[10][1]
    rows[11] = list(rows[12])  # a repeated row
    rows[13][0] = None
    rows[14] = [None] * 5
    rows[15][1] = " ".join(r.choices(words, k=30_000))  # very long
    rows[16][1] = "y" * 20_000
    return [tuple(x) + (1, "s", 2, "q") for x in rows]


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
