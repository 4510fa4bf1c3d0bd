import random
import re

import pytest
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality string, row string, size long, shard int, `key` string, node long, _bin int, label string"
BASE = " ".join(f"w{i}" for i in range(70))

#: Nulls in every column, empty and blank texts, a long text, ties, repeated rows, ids of several rows.
ROWS = [
    (1, BASE, "en", "a"),
    (2, BASE + " end", "en", "a"),
    (3, "", "en", "b"),
    (4, None, "en", "b"),
    (5, " \t\n ", None, "b"),
    (6, "one", "de", None),
    (7, "one two", "de", None),
    (None, BASE, "en", "a"),
    (None, "text without id " * 30, None, None),
    (8, "repeated row " * 25, "en", "c"),
    (8, "repeated row " * 25, "en", "c"),
    (9, "same id, first text " + BASE, "en", "c"),
    (9, "same id, second text, which is another one", "en", "c"),
    (10, "lang " * 30_000, "en", "d"),
    (11, "x" * 200_000, "en", "d"),
    (12, "UPPER lower é ü \u00a0 nbsp \U0001f600 mail a.b@c.de, 10.0.0.1; 4111 1111 1111 1111 and +49 (30) 1234-5678", "fr", "e"),
    (13, "\n".join(["a line that repeats"] * 40), "fr", "e"),
]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, None, "q", "r", -1, -2, "k", -3, -4, "l") for r in rows], schema)


@pytest.fixture(scope="session")
def messy(spark):
    return frame(spark, ROWS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def corpus(spark):
    """Small random texts with many shared passages; a list and a table (doc_id, text, source, lang)."""
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choices("abcdeé", k=rnd.randint(1, 5))) for _ in range(60)]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.randint(15, 60))] for _ in range(12)]
    rows = []
    for i in range(160):
        words = []
        for _ in range(rnd.randint(0, 4)):
            words += rnd.choice(passages) if rnd.random() < 0.6 else rnd.choices(vocabulary, k=rnd.randint(1, 40))
        if rows and rnd.random() < 0.35:  # a near copy
            words = rnd.choice(rows)[1].split(" ")
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        text = rnd.choice([" ", " ", " ", "  ", "\n", "\t"]).join(words)
        rows.append((i, text.title() if rnd.random() < 0.1 else text, rnd.choice("aaab"), rnd.choice(["en", None])))
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(5)


def taken(df, *columns):
    """Rows as tuples, sorted."""
    return sorted(df.select(*[F.col(c) for c in columns]).collect(), key=repr)
