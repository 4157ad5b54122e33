import re

import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def edges(spark):
    """Null ids and texts, empty and blank texts, a very long text, ties,
    repeated rows, and columns named like the operators' own."""
    long = " ".join(f"w{i % 7919}x{i % 13}" for i in range(30_000))
    rows = [(None, "a text without an id, with a few words"), (None, None), (1, None), (2, ""), (3, " \n\t\n"), (4, long), (5, long), (5, long), (6, "word"), (7, " WORD "),
            (8, "É"), (9, "1234 5678"), (10, "the same line of enough length\nx"), (11, "The same line of enough length \ny"), (12, "the same line of enough length")]
    rows = [(d, t, "en", "s", len(t or ""), 1, 2, "k", 3.0) for d, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block int, n long, key string, score double")


@pytest.fixture(scope="session")
def empty(edges):
    return edges.where("false")
