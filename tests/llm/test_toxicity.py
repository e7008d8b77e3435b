import random
from collections import Counter

import numpy as np

from sayplace.llm.toxicity import Model, below, fit, ngram_places, regression, scores


def texts(rng, n):
    calm, rude = [f"word{k}" for k in range(200)], ["scumbag", "idiotic", "moronish"]
    out = []
    for k in range(n):
        w = [rng.choice(calm) for _ in range(rng.randrange(5, 60))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(rude)
        out.append((k, " ".join(w), toxic))
    return out


def test_held_out(spark):
    rng = random.Random(2)
    train, held = texts(rng, 500), texts(rng, 300)
    model = fit(spark.createDataFrame(train, "doc_id long, text string, toxic int"), "doc_id", "text", "toxic")
    got = {r.id: r.score for r in scores(spark.createDataFrame([h[:2] for h in held], "doc_id long, text string"), "doc_id", "text", model).collect()}
    right = sum((got[k] >= 0.3) == bool(y) for k, _, y in held)
    assert right >= 0.98 * len(held)


def test_sample_is_bounded(spark):
    rows = spark.createDataFrame(texts(random.Random(3), 200), "doc_id long, text string, toxic int")
    a, b = (fit(rows.repartition(n), "doc_id", "text", "toxic", max_rows=100) for n in (1, 5))
    assert np.array_equal(a.places, b.places) and np.allclose(a.weights, b.weights) and len(a.places) <= 8192


def test_odd_rows(spark, odd_documents, no_documents):
    model = fit(spark.createDataFrame(texts(random.Random(4), 200), "doc_id long, text string, toxic int"), "doc_id", "text", "toxic")
    got = scores(odd_documents, "doc_id", "text", model).collect()
    assert len(got) == odd_documents.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.id in (0, 1, 2)}) == 1
    assert scores(no_documents, "doc_id", "text", model).count() == 0


def test_one_class_and_none(spark):
    schema = "doc_id long, text string, toxic int"
    for rows, most in (([(1, "a", 0), (2, None, 0), (None, "b", None)], 0.01), ([], 0.01)):
        model = fit(spark.createDataFrame(rows, schema), "doc_id", "text", "toxic")
        assert model.score("anything", model.table()) <= most
    assert fit(spark.createDataFrame([(1, "a", 1)], schema), "doc_id", "text", "toxic").score("", np.zeros(1 << 22, np.uint16)) > 0.9


def test_parts():
    assert len(ngram_places(None)) == len(ngram_places("")) == 0
    assert len(ngram_places("ab")) == 1 and np.array_equal(ngram_places("AB\tc"), ngram_places("ab c"))
    w, b = regression([np.array([0]), np.array([1]), np.array([0, 1]), np.array([], int)], np.array([1.0, 0, 1, 0]), np.array([2.0, -1.0]))
    assert w[0] * 2 + b > 0 > b
    m = Model(np.array([3]), np.array([1.0]), 0.0)
    assert m.table()[3] == 1


def test_against_brute_force(spark):
    """Ratios and scores from n-grams as strings; and the weights are where the loss, written out again, is least."""
    rows = texts(random.Random(6), 300)
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), "doc_id", "text", "toxic")

    def grams(text):
        t = f" {text.lower()} "
        return {t[k : k + n] for n in (4, 5, 6) for k in range(len(t) - n + 1)}

    has = [grams(t) for _, t, _ in rows]
    y = [label for _, _, label in rows]
    pos, neg = sum(y), len(y) - sum(y)
    counts = {}
    for own, label in zip(has, y):
        for g in own:
            counts.setdefault(g, [0, 0])[label] += 1
    ratio = {g: np.log((p + 1) / (pos + 2)) - np.log((n + 1) / (neg + 2)) for g, (n, p) in counts.items() if n + p >= 3}
    worth = {g: abs(r * (counts[g][1] / pos - counts[g][0] / neg)) for g, r in ratio.items()}
    from sayplace.llm import toxicity

    def place_of(g):
        a = np.frombuffer(g.encode("utf-32-le"), np.uint32)
        h = np.uint32(0)
        with np.errstate(over="ignore"):
            for c in a:
                h = h * np.uint32(0x01000193) ^ (c + np.uint32(1)) * np.uint32(0x9E3779B1)
            return int((h ^ np.uint32(len(g) * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - toxicity.PLACES.bit_length() + 1))

    place = {g: place_of(g) for g in ratio}
    alone = {p for p, n in Counter(place.values()).items() if n == 1}
    known = dict(zip(model.places.tolist(), model.ratios))
    assert len(known) == min(8192, len(set(place.values())))
    assert all(abs(known[place[g]] - r) < 1e-12 for g, r in ratio.items() if place[g] in known and place[g] in alone)
    assert min(model.ratios) < 0 < max(model.ratios)
    least = min(w for g, w in worth.items() if place[g] in known and place[g] in alone)
    assert all(w <= least + 1e-12 for g, w in worth.items() if place[g] not in known)

    weight = dict(zip(model.places.tolist(), model.weights))
    table = model.table()
    for (_, text, _), own in list(zip(rows, has))[:40]:
        z = model.bias + sum(weight[p] for p in {place_of(g) for g in own} if p in weight)
        assert abs(model.score(text, table) - 1 / (1 + np.exp(-z))) < 1e-9
    # No gradient is left.
    theta = model.weights / model.ratios
    z = np.array([model.bias + sum(weight[p] for p in {place_of(g) for g in own} if p in weight) for own in has])
    g = 1 / (1 + np.exp(-z)) - np.array(y)
    slope = toxicity.PENALTY * theta
    at = {p: k for k, p in enumerate(model.places.tolist())}
    for own, gi in zip(has, g):
        for p in {place_of(x) for x in own} & set(at):
            slope[at[p]] += gi * model.ratios[at[p]] / len(y)
    assert np.abs(slope).max() < 1e-3 and abs(g.mean()) < 1e-3


def test_below_keeps_rows(spark, odd_documents, no_documents):
    model = fit(spark.createDataFrame(texts(random.Random(4), 200), "doc_id long, text string, toxic int"), "doc_id", "text", "toxic")
    docs = odd_documents.unionByName(spark.createDataFrame([(1, "word1 scumbag idiotic moronish scumbag", "en", 1, 2, "b", 3), (1, "word1 word2", "en", 1, 2, "b", 3)], odd_documents.schema))
    got = below(docs, "text", model, 0.3)
    assert got.columns == docs.columns
    table = model.table()
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in docs.collect() if model.score(r.text, table) < 0.3)
    assert "scumbag" not in str([r.text for r in got.collect() if r.doc_id == 1]) and below(no_documents, "text", model, 0.3).count() == 0
