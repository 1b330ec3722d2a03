from __future__ import annotations

import zlib

import pytest

LINES = [
    "the quick brown fox jumps over the lazy dog and runs home again today",
    "el perro corre por la calle y la casa es grande como una montaña vieja",
    "der hund läuft über die straße und das haus ist groß wie ein alter berg",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns that clash with inner names."""
    texts = [None, "", " ", "1 2 3", LINES[0], LINES[0], LINES[1], LINES[2], "x", "漢字 かな", (LINES[0] + " ") * 3000, "a\n\nb. c!\n"]
    rows = [(i, t, "en" if i % 2 else None, i, i * 1.0, "k") for i, t in enumerate(texts)]
    rows += [(4, LINES[0], "en", 4, 4.0, "k"), (4, LINES[0], "en", 4, 4.0, "k"), (None, LINES[1], None, None, None, None), (None, None, None, None, None, None)]
    schema = "doc_id bigint, text string, lang string, key bigint, score double, words string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds
