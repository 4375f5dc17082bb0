"""Small documents with every awkward case."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"


def make_texts(seed: int = 0, n: int = 40) -> list[tuple]:
    """Random prose with copies, near copies, shared passages, nulls and blanks."""
    rnd = random.Random(seed)
    words = ["the", "of", "Thnd", "ering", "ble", "ouérent", "a", "x1", "ñandú", "tion,", "re."] + [f"w{i}" for i in range(60)]
    prose = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    shared = prose(60)
    rows = []
    for i in range(n):
        kind = i % 8
        text = prose(rnd.randint(30, 120))
        if kind == 1 and rows:
            text = rows[rnd.randrange(len(rows))][1]
        elif kind == 2:
            text = text + "\n" + shared + " " + prose(5)
        elif kind == 3:
            text = shared[: rnd.randint(50, len(shared))]
        elif kind == 4:
            text = prose(rnd.randint(0, 4))
        elif kind == 5:
            text = text + "\n\t" + text
        rows.append((i * 3, text, "en", "src0", len(text or ""), "e"))
    return [*rows, (1, None, None, None, None, None), (2, "", "en", "s", 0, ""), (4, " \n\t ", "en", "s", 4, ""), (5, "word " * 3000, "en", "s", 15000, "")]


@pytest.fixture(scope="session")
def rows():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def ascii_lower(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words_of(text: str | None) -> list[str]:
    return [x.decode() for x in (text or "").encode().split()]
