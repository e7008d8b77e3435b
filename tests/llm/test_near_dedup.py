import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from sayplace.llm import common
from sayplace.llm import near_dedup as module
from sayplace.llm.near_dedup import likely, near_dedup, prefix_length, shared_at_least, shingle_set, similar, union_estimate, whole_percent


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute(rows, size):
    """Components over all pairs; a null id is the smallest."""
    sets = defaultdict(set)
    for i, t in rows:
        sets[i].add(shingles(t, size))
    ids = sorted(sets, key=lambda i: (i is not None, i))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(ids, 2):
        for x in sets[a]:
            for y in sets[b]:
                n = len(x & y)
                if x and y and 100 * n >= 80 * (len(x) + len(y) - n):
                    low, high = sorted((find(a), find(b)), key=ids.index)
                    root[high] = low
    return {i: find(i) for i in ids}


def check(spark, rows, size, **kwargs):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = near_dedup(df, "doc_id", "text", size=size, **kwargs).collect()
    want = brute(rows, size)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want[r.id], r
        assert r.kept == (r.id == want[r.id])


def variants(rng, words, n, changes):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randrange(changes)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_random_variants(spark):
    rng = random.Random(5)
    texts = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(5000)}" for _ in range(rng.choice([6, 30, 120, 400]))]
        texts += variants(rng, base, 12, max(2, len(base) // 12))
    passage = " ".join(f"common{k}" for k in range(40))
    texts += [passage + " " + " ".join(f"u{k}x{j}" for j in range(rng.randrange(5, 60))) for k in range(40)]
    check(spark, list(enumerate(texts)), 4)


def test_dense_group(spark, monkeypatch):
    """One group of variants, of which leaders connect only a part; small blocks so that there are many."""
    monkeypatch.setattr(module, "BLOCK", 3000)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(100)]
    rows = list(enumerate(variants(rng, base, 150, 8)))
    check(spark, rows, 4)


def test_odd_rows(spark, odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect() if r.doc_id is not None]
    got = near_dedup(odd_documents.filter("doc_id is not null"), "doc_id", "text", size=4).collect()
    want = brute(rows, 4)
    assert sorted((r.id, r.component_id) for r in got) == sorted((i, want[i]) for i, _ in rows)
    assert {r.n_shingles for r in got if r.id in (0, 1, 2)} == {0}
    assert all(r.n_shingles == len(shingles(dict(rows)[r.id], 4)) for r in got)


def test_a_value_that_unlike_documents_share(spark, monkeypatch):
    """One run of words in hundreds of documents that are otherwise unlike, among them a few that are like."""
    monkeypatch.setattr(module, "BLOCK", 2000)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rng = random.Random(8)
    texts = ["same words in all of them " + " ".join(f"u{k}" for _ in range(1)) for k in range(150)]
    texts += ["same words in all of them " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.choice([1, 2, 3, 20]))) for _ in range(150)]
    texts += variants(rng, ("same words in all of them " + " ".join(f"y{k}" for k in range(60))).split(), 30, 5)
    check(spark, list(enumerate(texts)), 4)


def test_long_sets_at_the_threshold(spark, monkeypatch):
    """Pairs of sets far larger than a sketch with similarities from 0.80 to 0.85, none lost; and some below."""
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rng, rows, wanted = random.Random(9), [], 0
    for g in range(120):
        base = [f"g{g}w{k}" for k in range(rng.choice([300, 700, 2000]))]
        n = len(base) - 3
        # With the last d words of both changed, n - d shingles are shared and n + d are in the union.
        similarity = rng.uniform(0.77, 0.85)
        d = round(n * (1 - similarity) / (1 + similarity))
        other = base[: len(base) - d] + [f"h{g}w{k}" for k in range(d)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
        wanted += 100 * (n - d) >= 80 * (n + d)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = near_dedup(df, "doc_id", "text", size=4).collect()
    want = brute_pairs(rows, 4)
    assert {r.id for r in got if not r.kept} == want and len(want) == wanted > 60


def brute_pairs(rows, size):
    """The second ids of neighbours that are similar."""
    out = set()
    for (_, a), (i, b) in zip(rows[::2], rows[1::2]):
        x, y = shingles(a, size), shingles(b, size)
        n = len(x & y)
        if 100 * n >= 80 * (len(x) + len(y) - n):
            out.add(i)
    return out


def test_ids_that_repeat(spark):
    """An id with several texts is linked through any of them, also a null one."""
    rng = random.Random(10)
    bases = [[f"g{g}w{k}" for k in range(50)] for g in range(6)]
    rows = [(rng.choice([None, *range(40)]), rng.choice(variants(rng, base, 3, 4))) for base in bases for _ in range(10)]
    check(spark, rows, 4)


def test_components(spark, monkeypatch):
    """Chains, stars and circles against a search; hubs are broadcast."""
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rng = random.Random(11)
    edges = [(k, k + 1) for k in range(100, 180)] + [(500, k) for k in range(501, 600)] + [(k, 650) for k in range(601, 650)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r.node: r.root for r in common.components(common.Workspace(spark, "test"), spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for start in sorted(near):
        todo = [start] if start not in want else []
        while todo:
            n = todo.pop()
            if n not in want:
                want[n] = start
                todo += near[n]
    assert {n: got.get(n, n) for n in want} == want
    assert common.components(common.Workspace(spark, "test"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_null_ids(spark):
    got = near_dedup(spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (4, None)], "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted(((r.id, r.component_id, r.kept) for r in got), key=str) == sorted([(None, None, True), (3, None, False), (4, 4, True)], key=str)


def test_empty(no_documents):
    assert near_dedup(no_documents, "doc_id", "text").count() == 0


def test_estimates():
    a, b = shingle_set(" ".join(map(str, range(2000))), 4), shingle_set(" ".join(map(str, range(200, 2000))), 4)
    assert abs(union_estimate(a, b) - len(set(a) & set(b)) / len(set(a) | set(b))) < 0.15
    assert similar(a, b, 0.8) and likely(a, b, len(a), len(b), 0.8)
    c, d = shingle_set(" ".join(map(str, range(700, 2000))), 4), shingle_set(" ".join(map(str, range(1900, 4000))), 4)
    assert not similar(a, c, 0.8) and not likely(a, c, len(a), len(c), 0.8) and not likely(a, d, len(a), len(d), 0.8)
    for wrong in (0.805, 0, 1.2):
        with pytest.raises(ValueError):
            whole_percent(wrong)
    # Small sets are exact; the prefix of n elements is the usual one.
    assert prefix_length(100, 0.8) == 21 and shared_at_least(100, 80, 0.8) == 80
    assert 40 < prefix_length(5000, 0.8) <= 60


@pytest.mark.parametrize("text, n", [(None, 0), ("", 0), (" \n", 0), ("a", 1), ("a b c d", 1), ("a b c d e", 2), ("a a a a a a", 1)])
def test_set_sizes(text, n):
    assert len(shingle_set(text, 4)) == n


def test_filters_come_to_the_driver_as_bytes(spark, monkeypatch):
    """A bit for each key and no other, and a row for each slice of them, not for each word."""
    hashes = spark.range(300_000).selectExpr("xxhash64(id) AS h").toArrow()["h"].to_numpy()
    kind, came = type(spark.range(0)), []

    def counted(name):
        inner = getattr(kind, name)

        def run(self, *args):
            out = inner(self, *args)
            came.append(out.num_rows if name == "toArrow" else len(out))
            return out

        return run

    for name in ("collect", "toPandas", "toArrow"):
        monkeypatch.setattr(kind, name, counted(name))
    bitmap = common.key_filter(spark.range(300_000), "id").value
    assert sum(came) <= len(bitmap) * 64 // 32768
    want = np.zeros(len(bitmap) * 64, bool)
    want[hashes % len(want)] = True
    assert (np.unpackbits(bitmap.view(np.uint8), bitorder="little").astype(bool) == want).all()
    assert common.admits(bitmap, hashes).all()
    assert not common.key_filter(spark.range(0), "id").value.any()
