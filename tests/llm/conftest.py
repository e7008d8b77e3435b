import pytest

#: Null, empty, white space, ties, repeated rows, long texts, and columns whose names could clash with internal ones.
SCHEMA = "doc_id long, text string, lang string, id long, value long, _bucket string, salt int"


def clash(doc_id, text):
    return (doc_id, text, "en", 7, 8, "x", 9)


@pytest.fixture(scope="session")
def odd_documents(spark):
    base = " ".join(f"w{k}" for k in range(60))
    texts = [
        None, "", " \t\n", "one", "One", "ONE", "one two", "one two three four", base, base + " x", base.upper(), "É é É é", "é", "a\x1cb  c<|endoftext|> d",
        " ".join(f"long{k % 977}" for k in range(30_000)), "x" * 5_000, "idiot scum"]
    rows = [clash(k, t) for k, t in enumerate(texts)] + [clash(3, "one"), clash(8, base), clash(None, "one"), clash(None, None), clash(100, base)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
