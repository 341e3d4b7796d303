"""Shared inputs of the training-data tests."""

import random

import pytest

EXTRA = ["id", "key", "score", "row_id", "n", "cls", "label", "host", "rank"]
SYLLABLES = ["ka", "lo", "mi", "ter", "van", "os", "ru", "del", "shi", "pon"]


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def odd_rows():
    """doc_id, text, lang: nulls, empty, long, tied and repeated rows."""
    rng = random.Random(4)
    base = prose(rng, 60)
    rows = [(1, base, "xx"), (2, base, "xx"), (2, base, "xx"), (3, None, "xx"), (4, "", None), (5, " \n\t ", "yy"), (None, prose(rng, 30), None),
            (None, None, None), (6, "one", "yy"), (7, "two words", "yy"), (8, "ÄÖ ß日本語 emoji \U0001f600 " * 5, "zz"), (9, prose(rng, 60_000), "xx"),
            (10, "a" * 200_000, "yy"), (11, base.upper(), "xx"), (12, "'s don't I'll 12 345\r\n\r\n  <|endoftext|> x", None), (-5, "!!! ??? ...", "zz")]
    rows += [(100 + i, prose(rng, rng.randint(5, 80)), rng.choice(["xx", "yy", "zz", None])) for i in range(30)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows as a documents table with extra, clashing columns."""
    rows = [(i, t, g, f"s{k % 3}" if k % 5 else None, None if t is None else len(t), *[k] * len(EXTRA)) for k, (i, t, g) in enumerate(odd_rows())]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in EXTRA)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
