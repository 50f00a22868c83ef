"""A small table of documents with every awkward kind of row."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_documents(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Água", "straße", "x", "tion", "and,", "Ha."] + ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = sentence(70)
    rows = []
    for i in range(n):
        words = sentence(rng.randint(20, 160)).split()
        text = "".join(w + rng.choice([" ", " ", " ", "\n", "\t "]) for w in words)
        if i % 10 == 0:
            text += "\n" + passage + "\n" + sentence(30)
        if i % 9 == 0 and rows:
            near = rows[rng.randrange(len(rows))][1].split(" ")
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            text = " ".join(near)
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "ü", None]), len(text)))
    rows += [
        (n, None, "en", "a", None), (n + 1, "", "en", "a", 0), (n + 2, " \n\t ", None, None, 4), (n + 3, "one", "en", "b", 3), (n + 4, "ONE", "en", "b", 3), (n + 5, "one two", "en", "b", 7),
        (n + 6, sentence(6000), "en", "a", None), (n + 7, rows[3][1], "en", "c", None), (n + 8, rows[3][1].upper().replace("Á", "Á"), "en", "c", None),
        (n + 9, "Ａ full width   space 😀 " * 20, "en", "c", None), (4, rows[4][1], rows[4][2], rows[4][3], rows[4][4]), (None, "a row without an id " * 4, "en", "a", None),
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_documents()


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(documents):
    """The same rows with further columns named as the operators name theirs."""
    names = ["node", "token", "text_hash", "size", "shard", "slot", "pos", "line", "h", "kept", "cell", "distance", "band", "root", "taken", "target", "n", "a", "b", "key", "word", "n_words", "_key", "window", "_part", "_range", "_at", "_copies", "part", "range", "nth", "row", "worded", "kept_id"]
    from pyspark.sql import functions as F

    return documents.select("*", *[F.lit("clash").alias(x) for x in names])


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
