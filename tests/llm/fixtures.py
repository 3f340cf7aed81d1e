"""Rows with nulls in every column, empty and very long texts, ties and repeats."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, __hash string, `row` int"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    known = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(vocabulary)]
    return " ".join(rng.choice(known) + rng.choice(["", "", "", ",", "."]) for _ in range(words))


def edge_texts() -> list[str | None]:
    return [None, "", " \n\t ", "one", "two words", "<|endoftext|> Straße ÉCOLE don't ﬁne é é 日本語 a b  x", "A a A a " * 400, prose(1, 30000), prose(2, 60), prose(2, 60), "x" * 5000]


def edge_docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "web", None, i, "clash", i) for i, t in enumerate(edge_texts())]
    rows += [(None, "a text without an id of its own", None, None, None, None, None, None), (8, edge_texts()[8], "en", "web", 1, 1, "c", 2), rows[9], rows[9], (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)
