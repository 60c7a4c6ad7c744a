"""Odd rows that every operator has to take."""

from __future__ import annotations

import pytest

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(20_000))
SPACELESS = "x1@" + "a" * 60_000 + "7" * 60_000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (2, None),
    (3, ""),
    (4, " \t\n \x0b "),
    (5, LONG),
    (6, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (7, "THE QUICK brown fox jumps over the lazy dog near the river bank today."),
    (8, SPACELESS),
    (9, "é" * 300 + " ½ ² 字字 \U0001f600 ́ x\x1cy \x00z"),
    (9, "é" * 300 + " ½ ² 字字 \U0001f600 ́ x\x1cy \x00z"),
    (None, "no id here but words enough for a shingle or two"),
    (11, "one"),
    (12, "Mail a.b+c@mail.example.com, call +1 (212) 555-0199, card 4111 1111 1111 1111, host 10.0.0.255, bad 10.0.0.256, IBAN DE89 3704 0044 0532 0130 00, ssn 123-45-6789"),
    (13, "Released under the MIT License.\nother text"),
]
#: Columns whose names operators use inside.
EXTRA = {"score": 1.5, "row": 2, "id": 3, "words": "w", "size": 4, "node": 5, "signature": "s", "shard": 6, "class": "c", "u": 7, "v": 8}


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en" if i != 1 else None, "s" if i != 2 else None, len(t) if t and i != 5 else None, *EXTRA.values()) for i, t in TEXTS]
    kinds = {float: "double", int: "long", str: "string"}
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in EXTRA.items())
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("1 = 0")


@pytest.fixture
def work(spark):
    from featuregrid.llm.common import Workspace

    return Workspace(spark, "test")
