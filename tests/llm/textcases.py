from __future__ import annotations

import re

import pytest


WORD = re.compile(r"[^\x20\x09-\x0D]+")
TESTDATA = "/root/testdata/sf0.001"


def lowered(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text: str | None, lower: bool = True) -> list[str]:
    return WORD.findall(lowered(text) if lower else text or "")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with further columns, some named like an operator's own."""
    def make(rows, columns="doc_id long, text string, lang string, source string"):
        n = len(columns.split(","))
        frame = spark.createDataFrame([tuple(r) + (None,) * (n - len(r)) for r in rows], columns)
        return frame.selectExpr("*", "'x' AS size", "'x' AS tokens", "'x' AS node", "'x' AS score", "'x' AS shard", "'x' AS rate")
    return make


EDGE = [
    (1, "", "en", "a"), (2, None, "en", None), (3, " \n\t ", None, "a"), (4, "one", "en", "a"), (5, "one two three", "fr", ""),
    (6, "Ünï code 漢字 \x1c x", "fr", "b"), (None, "a text without an id that is long enough to count as a text of some words", "en", "b"),
    (8, "same words here " * 40, "en", "b"), (9, "same words here " * 40, "en", "b"), (9, "same words here " * 40, "en", "b"),
    (10, "x " * 30_000 + "tail", "en", "b"), (11, "y" * 50_000, "en", "b"),
]
