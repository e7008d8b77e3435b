import hashlib
import re

import pytest

from sayplace.llm.decontaminate import _parts, clean, scan, windows, words

ITEMS = [(1, "The quick brown fox jumps over the lazy dog and then some more words follow"), (2, "Short one"), (3, ""), (4, None), (None, "alpha beta"), (5, "é-à 1 2"), (6, "short ONE"), (1, "second text of item one here it is now really")]


def normal(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, size=10):
    w, hit, found = normal(text), set(), set()
    for i, t in items:
        v = normal(t)
        n = min(size, len(v))
        for k in range(max(1, len(v) - size + 1)) if v else ():
            for at in range(len(w) - n + 1):
                if w[at : at + n] == v[k : k + n]:
                    hit |= set(range(at, at + n))
                    found.add("" if i is None else str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in ITEMS], "item_id long, text string, id int, spans string")


def test_against_brute_force(spark, benchmark, odd_documents):
    extra = [
        "xx The QUICK, brown fox jumps over the lazy dog and... yes", "quick brown fox jumps over the lazy dog and then some more words follow", "short one short\tone", "Alpha, BETA!", "é à 1 2 é",
        "the quick brown fox jumps over the lazy dog", "shorts one", "of item one here it is now really; second text of item one here it is now really"]
    docs = odd_documents.select("doc_id", "text").unionByName(spark.createDataFrame([(500 + k, t) for k, t in enumerate(extra)], "doc_id long, text string"))
    rows = scan(docs, "doc_id", "text", benchmark, "item_id", "text").collect()
    want = sorted(((d.doc_id, *brute(d.text, ITEMS)) for d in docs.collect()), key=str)
    assert sorted(((r.id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in rows), key=str) == want
    # Spans give the hit words back from the original text.
    texts = {d.doc_id: d.text for d in docs.collect()}
    for r in rows:
        assert sum(len(words(texts[r.id][s.begin : s.end])) for s in r.spans) == r.n_hit


def test_empty(spark, benchmark, no_documents, odd_documents):
    assert scan(no_documents, "doc_id", "text", benchmark, "item_id", "text").count() == 0
    nothing = scan(odd_documents, "doc_id", "text", benchmark.limit(0), "item_id", "text")
    assert nothing.filter("n_hit > 0 or n_items > 0").count() == 0 and nothing.count() == odd_documents.count()


def test_parts(spark, benchmark, odd_documents):
    """A large suite is scanned for in parts, with the same results."""
    docs = odd_documents.unionByName(spark.createDataFrame([(77, "the quick brown fox jumps over the lazy dog and; second text of item one here it is now really. Alpha beta", "en", 1, 2, "b", 3)], odd_documents.schema))
    whole = scan(docs, "doc_id", "text", benchmark, "item_id", "text").collect()
    assert sorted(map(str, scan(docs, "doc_id", "text", benchmark, "item_id", "text", max_bytes=900).collect())) == sorted(map(str, whole))
    assert len(_parts(benchmark, "item_id", "text", 10, 900)) > 1


def test_clean(spark, benchmark, odd_documents):
    """Rows are judged one by one, also those that share an id."""
    rows = [(1, "short one", "en", 1, 2, "b", 3), (1, "nothing here", "en", 1, 2, "b", 3), (1, "nothing here", "de", 1, 2, "b", 3)]
    docs = spark.createDataFrame(rows, odd_documents.schema)
    for most in (10**6, 900):
        got = clean(docs, "text", benchmark, "item_id", "text", max_bytes=most)
        assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == sorted(rows[1:])
    assert sorted(map(str, clean(odd_documents, "text", benchmark.limit(0), "item_id", "text").collect())) == sorted(map(str, odd_documents.collect()))


def test_windows():
    assert windows(None) == windows("...") == set()
    assert windows("A b") == {" a b "}
    assert len(windows(" ".join(map(str, range(12))))) == 3
