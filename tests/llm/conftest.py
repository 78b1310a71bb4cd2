from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, kept string, failures string, n int, doc string, row int, words string, sha string"


def rows_of(texts):
    """Documents with columns whose names the operators use themselves."""
    return [(i, t, "en", "s", len(t) if t is not None else None, -1, "x", "x", 7, "x", 3, "x", "x") for i, t in texts]


def messy_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    prose = [" ".join(word() for _ in range(rng.randint(60, 120))) for _ in range(12)]
    near = [prose[0].replace(prose[0].split()[k], "changed", 1) for k in (3, 40)]
    texts = [*enumerate(prose), (20, prose[1]), (21, prose[1].upper().replace("É", "é")), (22, prose[1]), (22, prose[1]), (30, None), (31, ""), (32, " \n\t "), (33, "one two"),
             (34, "one two"), (40, near[0]), (41, near[1]), (None, prose[2]), (None, None), (50, " ".join(word() for _ in range(30_000))), (51, "a" * 200_000), (52, "line one\n" * 80)]
    return texts


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda texts: spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def messy(make_docs):
    return make_docs(messy_texts()).cache()
