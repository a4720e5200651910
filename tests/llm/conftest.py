"""Small tables with every odd case, shared by the operator tests."""

from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"

# names that the operators use for columns of their own, as further columns of the input
CLASHES = "row long, name string, kind string, h string, rank int, size int, target string, score double, doc string, bucket int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"


def widen(rows):
    return [(*r, 1, "n", "k", "h", 2, 3, "t", 0.5, "d", 4) for r in rows]


BASE = "the quick brown fox jumps over the lazy dog and runs far away into the deep green forest while birds sing loudly above the old oak tree near a quiet river"
ROWS = [
    (1, BASE, "en", "a", 10), (2, BASE.replace(" ", "\t\n"), "en", "a", 10), (3, BASE.upper(), "en", "a", 10), (3, BASE.upper(), "en", "a", 10),
    (4, BASE + " today", "en", "b", 10), (5, BASE.replace("loudly", "softly"), "en", None, 10), (None, BASE + " now", None, "b", None),
    (6, None, "en", "b", None), (7, "", None, None, 0), (8, " \t\n ", "de", "c", 4), (9, "... 123 !", "de", "c", 9), (None, None, None, None, None),
    (10, "one", "fr", "c", 3), (11, "one", "fr", "c", 3), (12, "der hund und die katze sind im haus und der garten ist groß", "de", "c", 50),
    (13, "x" * 50_000, "en", "d", 50_000), (14, ("lorem ipsum dolor sit amet " * 4000).strip(), "fr", "d", 1), (15, "mail a.b@c.de or call +1 (319) 555-5132 now", "en", "d", 1),
    (16, "é 𝒳 ñandú a@b.co,1.2.3.4 4387 5130 3523 7269", "es", "d", 1), (17, "\x1cΣας <|endoftext|> İx", "es", "e", 1),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(widen(ROWS), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
