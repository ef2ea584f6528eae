from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, k int, score double, lines int, part int, node string, c0 string, keep_0 int, size int"


def words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(1, 6))) for _ in range(n))


def row(doc_id, text, source="s0", lang="en"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", 1, 0.5, 3, 4, "n", "c", 6, 7)


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in each column, empty, blank and very long texts, ties, repeated rows, one id with two texts; columns named as the operators' own."""
    r = random.Random(4)
    base = words(r, 120)
    rows = [row(i, words(r, r.randint(1, 80)) + "\n" + words(r, r.randint(1, 30)), f"s{i % 3}") for i in range(40)]
    rows += [row(40, base), row(41, base), row(42, base.upper()), row(43, base + " tail"), row(44, base.replace(" ", "  ", 3)), row(5, base)]
    rows += [row(50, None), row(51, ""), row(52, " \t\n "), row(53, "\n\n\n"), row(54, "é ü 日本語   <|endoftext|>"), row(None, "no id here " + base[:90]), row(None, None)]
    rows += [row(60, words(r, 30_000), "s1"), row(61, "one", None), row(62, "a b c d", None)]
    rows += [rows[0], rows[0], rows[41], (63, None) + (None,) * 12, (64, "all else is null") + (None,) * 12]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
