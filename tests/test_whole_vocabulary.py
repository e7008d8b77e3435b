"""The word-list queries over vocabularies larger than any head of one that they could be cut to."""

import random
from collections import Counter

import pytest

from sayplace.operators import phonetics, selection
from sayplace.plans import queries


@pytest.fixture(scope="module")
def words():
    rng = random.Random(4)
    out = {}
    while len(out) < 1700:
        out["".join(rng.choice("aeioubdgklmnprst") for _ in range(rng.choice((4, 4, 5, 5, 6, 8))))] = 1 + len(out) % 3
    return Counter(out)


@pytest.fixture(scope="module")
def folder(spark, words, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("words"))
    listed = list(words.elements())
    rows = [(k, " ".join(listed[k::7]), "en") for k in range(7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    return path


def keystroke(a, b):
    """Whether one insertion, deletion or substitution makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def test_keystroke_pairs(spark, words, folder):
    names = sorted(words)
    want = {(a, b) for k, a in enumerate(names) for b in names[k + 1 :] if abs(len(a) - len(b)) < 2 and keystroke(a, b)}
    assert {tuple(r) for r in queries.QUERIES["keystroke_pairs"](spark, folder).collect()} == want


@pytest.fixture(scope="module")
def distances(words):
    """The distances below 2 of all pairs (a, b), a before b, as their lengths allow."""
    names = sorted(words)
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :] if abs(len(a) - len(b)) < 2]
    said = {w: [queries.LETTERS[c] for c in w] for w in names}
    found = phonetics.distances([said[a] for a, _ in pairs], [said[b] for _, b in pairs])
    return {p: d for p, d in zip(pairs, found.tolist()) if d < 2}


def test_phonetic_audit(spark, folder, distances):
    assert {(r.a, r.b): r.d for r in queries.QUERIES["phonetic_audit"](spark, folder).collect()} == distances


def test_isolation_nearest(spark, words, folder, distances):
    want = dict.fromkeys(words, 2.0)
    for (a, b), d in distances.items():
        want[a], want[b] = min(want[a], d), min(want[b], d)
    rows = queries.QUERIES["isolation_nearest"](spark, folder).collect()
    assert len(rows) == len(words) and {r.word: r.isolation for r in rows} == want


def test_reject_reasons_beyond_the_head(spark, folder):
    assert "rare" not in {r.reason for r in queries.QUERIES["reject_reasons"](spark, folder).collect()}


def test_greedy_select(spark, words, folder):
    """Against one candidate after the other, first those whose three letters are free."""
    entries = spark.createDataFrame([(w, [queries.LETTERS[c] for c in w]) for w in words], "word string, phonemes array<string>")
    near = {}
    for r in selection.conflicts(entries, entries.select("word")).collect():
        near.setdefault(r.word, set()).add(r.other)
    want, starts = {}, set()
    for k in (1, 2):
        for w in sorted(words, key=lambda w: (-words[w], w)):
            if w not in want and (k == 2 or w[:3] not in starts) and not near.get(w, set()) & want.keys():
                want[w] = k
                starts.add(w[:3])
    assert {r.word: r["round"] for r in queries.QUERIES["greedy_select"](spark, folder).collect()} == want


@pytest.mark.parametrize("block", [10**6, 400])
def test_chains_take_blocks_and_not_rounds(spark, monkeypatch, block):
    """A chain of conflicts as long as the list, beside claims and keys that several words have."""
    rng, n, tables_written = random.Random(8), 300, []
    monkeypatch.setattr(selection, "BLOCK", block, raising=False)
    inner = selection.written
    monkeypatch.setattr(selection, "written", lambda df: tables_written.append(1) or inner(df))
    arcs = {(k, k - 1) for k in range(1, n)} | {(k, rng.randrange(k)) for k in range(1, n)}
    claims, keys = [rng.randrange(200) for _ in range(n)], [{rng.randrange(400) for _ in range(rng.randrange(3))} for _ in range(n)]
    vertices = spark.createDataFrame([(f"w{k}", k, f"p{claims[k]}") for k in range(n)], "word string, order long, p string")
    edges = spark.createDataFrame([(f"w{x}", f"w{y}") for a, b in arcs for x, y in ((a, b), (b, a))], "word string, other string")

    def want(claims, keys):
        taken = []
        for k in range(n):
            if not any((k, t) in arcs or claims and claims[k] == claims[t] or keys and keys[k] & keys[t] for t in taken):
                taken.append(k)
        return set(taken)

    got = selection.first_fit(vertices, edges, claim="p").collect()
    assert len(got) == n and {r.order for r in got if r.taken} == want(claims, None)
    assert len(tables_written) < 30
    shared = spark.createDataFrame([(f"w{k}", f"k{x}") for k in range(n) for x in keys[k]], "word string, key string")
    got = selection.first_fit(vertices, edges, claim="p", keys=shared).collect()
    assert len(got) == n and {r.order for r in got if r.taken} == want(claims, keys)
