import hashlib
from collections import defaultdict

import pytest

from sayplace.llm.exact_dedup import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").encode().lower()].append(i)
    out = []
    for content, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(content).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_odd_rows(odd_documents, digest_bytes):
    """With digests of one byte, different contents share one, and contents alone keep them apart."""
    got = exact_dedup(odd_documents, "doc_id", "text", digest_bytes=digest_bytes)
    assert got.columns == ["id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute([(r.doc_id, r.text) for r in odd_documents.collect()])


def test_clashing_digests(spark):
    rows = [(k, f"text {k % 700}") for k in range(1500)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), "doc_id", "text", digest_bytes=1)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_hot_group(spark):
    rows = [(k, "Same" if k % 2 else "same") for k in range(3000)] + [(k, f"own {k}") for k in range(3000, 4000)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), "doc_id", "text", salts=4)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty(no_documents):
    assert exact_dedup(no_documents, "doc_id", "text").count() == 0
