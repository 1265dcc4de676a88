"""Small documents with what operators have to stand: nulls, empty and blank texts, one very long, copies, repeated rows."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_documents():
    r = random.Random(7)
    vocabulary = ["the", "of", "and", "Haus", "été", "año", "word", "x", "Zebra,", "end.", "naïve", "日本", "river", "stone", "cloud", "blue", "idiot", "seven"]
    say = lambda n: " ".join(r.choice(vocabulary) + str(r.randint(0, 30)) * r.randint(0, 1) for _ in range(n))
    passage = say(60)
    texts = [say(r.randint(1, 120)) for _ in range(40)]
    texts += [None, "", "  \t\n ", "one", "one two", passage, "before " + passage + " after", passage + "\n" + say(30), "a" * 3000, "tab\tand\x0bvt\x0cff\r\nline\n\nline\nline"]
    texts += [texts[3]] * 5 + [texts[7] + " tail"] + [say(4000)] + ["<|endoftext|> is text", "same same same same same same same same same same same same same same same"]
    rows = [(i * 3, t, r.choice(["en", "de", None]), "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated rows, null ids, and columns whose names operators use inside."""
    rows = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", 5, "a"), (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", 5, "a"), (None, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", 6, "b"), (4, None, None, None), (None, None, 1, "c"), (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", 5, "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, id long, t string").selectExpr("doc_id", "text", "id", "t", "id AS fp", "t AS h", "id AS range", "t AS score", "id AS label", "t AS w", "id AS n_words", "id AS bucket", "id AS start", "id AS shard", "id AS ids", "id AS c0")
