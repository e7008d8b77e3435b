import math
import random

import pytest
from pyspark.sql import functions as F

from sayplace.operators import measure, phonetics, pool, selection, semantics, spelling
from sayplace.sources import wordlists

PHONES = "P B T D K M N S Z TH AA AE IY IH".split()


def edit(a, b):
    """Weighted edit distance by definition."""
    table = [[float(i + j) for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = min(table[i - 1][j - 1] + phonetics.substitution(x, y), table[i - 1][j] + 1, table[i][j - 1] + 1)
    return table[-1][-1]


def words_of(spark, *words):
    return spark.createDataFrame([(w,) for w in words], "word string")


@pytest.fixture(scope="module")
def entries():
    rng = random.Random(9)
    return [(f"w{k}", [rng.choice(PHONES) for _ in range(rng.randrange(1, 6))]) for k in range(120)]


def test_distances(entries):
    pairs = [(a, b) for _, a in entries[:40] for _, b in entries[:40]] + [([], ["P"]), ([], [])]
    assert [edit(a, b) for a, b in pairs] == phonetics.distances([a for a, _ in pairs], [b for _, b in pairs]).tolist()


@pytest.mark.parametrize("threshold", [0.6, 2.0, 2.5])
def test_audit_loses_no_pair(spark, entries, threshold):
    df = spark.createDataFrame(entries, "word string, phonemes array<string>")
    got = {(r.a, r.b): r.d for r in phonetics.audit(df, threshold).collect()}
    assert got == {(a, b): edit(x, y) for a, x in entries for b, y in entries if a < b and edit(x, y) < threshold}


def test_isolation_and_report(spark, entries):
    df = spark.createDataFrame(entries, "word string, phonemes array<string>")
    got = {r.word: r.isolation for r in phonetics.isolation(df, df).collect()}
    assert got == {w: min([2.0] + [edit(x, y) for v, y in entries if v != w]) for w, x in entries}
    r = {x.threshold: x for x in phonetics.report(df).collect()}
    assert r[2.0].pairs == sum(edit(x, y) < 2 for a, x in entries for b, y in entries if a < b) and r[0.6].words <= r[2.0].words


def test_phonemes(spark):
    df = spark.createDataFrame([("HH AH0 L OW1",), ("",)], "p string").select(phonetics.phonemes(F.col("p")).alias("x"))
    assert [r.x for r in df.collect()] == [["HH", "AH", "L", "OW"], []]
    assert [r.n for r in df.select(phonetics.syllables(F.col("x")).alias("n")).collect()] == [2, 0]


def test_spelling(spark):
    v = words_of(spark, "walk", "stop", "carry", "corn", "corner", "color", "colour", "land", "lady", "landlady", "help", "helpful", "unhelpful", "water", "later", "planet", "planets", "rate", "celebrate")
    names = lambda df: sorted(r.word for r in df.collect())
    asked = words_of(spark, "walked", "stopped", "carries", "corner", "planets", "water")
    assert names(spelling.inflections(asked, v)) == ["carries", "corner", "planets", "stopped", "walked"]
    seen = spark.createDataFrame([("corn", 1), ("corner", 5)], "word string, n long")
    assert "corner" not in names(spelling.inflections(asked, v, seen))
    assert names(spelling.with_variants(v, v)) == ["color", "colour"]
    assert [tuple(r) for r in spelling.splits(v, v).collect()] == [("landlady", "land", "lady")]
    assert {r.member for r in spelling.families(words_of(spark, "unhelpful"), v).collect()} == {"unhelpful", "helpful", "help"}
    assert {(r.a, r.b) for r in spelling.keystroke_pairs(v).collect()} == {("color", "colour"), ("later", "water"), ("planet", "planets")}
    assert ("rate", "celebrate") in {(r.a, r.b) for r in spelling.contained_pairs(v).collect()}
    assert names(spelling.sharing(words_of(spark, "landlady", "water"), v, spark.createDataFrame([("lady",)], "part string"))) == ["landlady"]
    stems = words_of(spark, "running").select(spelling.base_forms(F.col("word")).alias("b")).first().b
    assert set(stems) == {"runn", "run", "runne"}


def greedy(order, edges, prefix=3, size=None):
    """The list and the tallies, one candidate after the other."""
    taken, tallies = [], dict.fromkeys(selection.KINDS, 0)
    for free_only in (True, False):
        for w in order:
            if size is not None and len(taken) >= size:
                return taken, tallies
            if w in taken or free_only and any(t[:prefix] == w[:prefix] for t in taken):
                continue
            kinds = [edges[w, t] for t in taken if (w, t) in edges]
            if kinds:
                tallies[selection.KINDS[min(kinds)]] += 1
            else:
                taken.append(w)
    return taken, tallies


@pytest.mark.parametrize("size", [None, 8])
def test_selection_is_greedy(spark, size):
    rng = random.Random(size or 1)
    order = [a + b + c for a in "bd" for b in "ao" for c in "kmst"] + ["bakery", "dotted"]
    rng.shuffle(order)
    edges = {}
    for _ in range(25):
        a, b = rng.sample(order, 2)
        edges[a, b] = edges[b, a] = rng.randrange(5)
    candidates = spark.createDataFrame([(w, k + 1) for k, w in enumerate(order)], "word string, order int")
    frame = spark.createDataFrame([(a, b, k) for (a, b), k in edges.items()], "word string, other string, kind int")
    chosen, tallies = selection.select(candidates, frame, size=size, prefix=2)
    want, counts = greedy(order, edges, 2, size)
    assert {r.word for r in chosen.collect()} == set(want)
    assert {r.kind: r.n for r in tallies.collect()} == {k: n for k, n in counts.items() if n}


def test_conflicts_and_statistics(spark):
    v = words_of(spark, "land", "lady", "landlady", "help", "helpful", "water", "later")
    rows = [(w, list(w.upper())) for w in ("landlady", "lady", "help", "helpful", "water", "later")]
    got = {(r.word, r.other): selection.KINDS[r.kind] for r in selection.conflicts(spark.createDataFrame(rows, "word string, phonemes array<string>"), v).collect()}
    assert got["landlady", "lady"] == got["lady", "landlady"] == "shared piece" and got["helpful", "help"] == "shared root" and got["water", "later"] == "sound"
    s = selection.statistics(words_of(spark, "abc", "abd", "xyz", "abcd")).first()
    assert (s.n_words, s.shortest, s.longest, s.unique_prefixes) == (4, 3, 4, 2)
    bands = spark.createDataFrame([(0,), (1000,), (2000,), (4000,), (5000,)], "rank int").select(selection.band(F.col("rank")).alias("b"))
    assert [int(r.b) for r in bands.collect()] == [int(math.log(x + 2, 4)) for x in (0, 1000, 2000, 4000, 5000)]


def test_part_of_speech(spark):
    counts = spark.createDataFrame([("run", "v", 9), ("run", "n", 3), ("well", "r", 5), ("tie", "n", 2), ("tie", "v", 2), ("odd", "a", 2), ("odd", "n", 2), ("odd", "v", 1)], "word string, kind string, n long")
    own = spark.createDataFrame([("run", "-"), ("new", "n")], "word string, kind string")
    assert {r.word: r.kind for r in selection.part_of_speech(counts, own).collect()} == {"new": "n", "tie": "n"}


def test_sources(spark, tmp_path):
    def file(name, content, encoding="utf-8"):
        (tmp_path / name).write_bytes(content.encode(encoding))
        return str(tmp_path / name)

    said = wordlists.pronunciations(spark, file("cmu", ";;; no\nREAD  R EH1 D\nREAD(2)  R IY1 D\nA  AH0\nX\n"))
    assert sorted((r.word, r.pronunciation) for r in said.collect()) == [("a", "AH0"), ("read", "R EH1 D"), ("read", "R IY1 D")]
    assert {r.word: r.ways for r in pool.spoken(said).collect()} == {"read": 2, "a": 1}
    f = wordlists.ranked(wordlists.frequencies(spark, file("freq", "the 10\nof 20\nbad line here\nthe 30\nto 20\n")))
    assert {r.word: (r.n, r["rank"]) for r in f.collect()} == {"the": (30, 0), "of": (20, 1), "to": (20, 2)}
    assert {r.word for r in wordlists.words(spark, file("w", "A b # c\n#\n d")).collect()} == {"a", "b", "d"}
    assert {(r.word, r.proper) for r in wordlists.cased_dictionary(spark, file("d", "Bill\nbill\nit's\n café\nZed\n")).collect()} == {("bill", True), ("bill", False), ("zed", True)}
    assert {r.word for r in wordlists.surnames(spark, file("s", "name,n\nSMITH,1\n\"JONES\",2\nBROWN,3\n"), 2).collect()} == {"smith", "jones"}
    assert {(r.word, r.kind) for r in wordlists.overrides(spark, file("o", "run v\nrun n # last\nx\n")).collect()} == {("run", "n")}
    cities = spark.createDataFrame([("Paris", 2000000), ("New York", 9000000), ("Ham", 10)], "name string, population long")
    assert {r.word for r in wordlists.places(cities, spark.createDataFrame([("Chad",)], "name string")).collect()} == {"paris", "chad"}
    data = "  licence\n00000001 03 n 02 Flu 0 grippe_x 1 002 @ 00000002 n 0000 ~ 00000009 n 0000 | An ACUTE illness\n00000002 03 n 01 disease 0 000 | bad\n"
    sets = wordlists.synsets(spark, file("data.noun", data, "latin-1"), "n").collect()
    assert [(r.offset, r.words, [(p.symbol, p.offset) for p in r.pointers], r.gloss) for r in sets] == [("00000001", ["flu", "grippe x"], [("@", "00000002")], "an acute illness"), ("00000002", ["disease"], [], "bad")]
    index = wordlists.senses(spark, file("index.noun", "  licence\nflu n 2 1 @ 2 7 00000001 00000002\n", "latin-1"), "n").collect()
    assert [(r.word, r.place, r.offset, r.tagged) for r in index] == [("flu", 0, "00000001", 7), ("flu", 1, "00000002", 7)]
    wordlists.write_list(words_of(spark, "b", "a"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a", "b"]


@pytest.fixture(scope="module")
def net(spark):
    kind = "kind string, offset string, words array<string>, pointers array<struct<symbol: string, offset: string, kind: string>>, gloss string"
    sets = spark.createDataFrame([
        ("n", "1", ["flu"], [("@", "2", "n")], "a cough"), ("n", "2", ["disease"], [("@", "3", "n")], ""), ("n", "3", ["state"], [("@", "2", "n")], ""), ("a", "4", ["lustful"], [("+", "5", "n")], "full"),
        ("n", "5", ["lust"], [("@", "6", "n"), ("+", "1", "n")], ""), ("n", "6", ["sexual desire"], [], ""), ("n", "7", ["oslo"], [("@i", "3", "n")], ""), ("n", "8", ["neck"], [], "opening to the uterus")], kind)
    index = spark.createDataFrame([("flu", "n", 0, "1"), ("lustful", "a", 0, "4"), ("oslo", "n", 0, "7"), ("neck", "n", 0, "3"), ("neck", "n", 1, "8")], "word string, kind string, place int, offset string")
    return index, sets


def test_semantics(spark, net):
    index, sets = net
    asked = words_of(spark, "flu", "lustful", "oslo", "neck", "absent")
    above = {}
    for r in semantics.ancestors(asked, index, sets).collect():
        above.setdefault(r.word, set()).add(r.ancestor)
    assert above == {"flu": {"flu", "disease", "state"}, "lustful": {"lustful", "lust", "sexual desire"}, "oslo": {"oslo", "state", "disease"}, "neck": {"state", "disease"}}
    assert {r.word for r in semantics.instances(asked, index, sets).collect()} == {"oslo"}
    some = {r.word: r.category for r in semantics.classify(asked, index, sets, roots={"sexual": ["sexual desire"]}).collect()}
    assert some == {"lustful": "sexual", "neck": "sexual"}


def test_reject_chains(spark):
    say = spark.createDataFrame([(w, "K AA1 T", k) for k, w in enumerate(["goodword", "walked", "walk", "ab", "don't", "rareword", "badword", "jones", "paris", "unknown", "bill", "handed", "colour", "color", "lewd"])] + [("read", "R EH1 D", 90), ("read", "R IY1 D", 91)], "word string, pronunciation string, position long")
    rank = spark.createDataFrame([(r.word, k, 100 - k) for k, r in enumerate(say.select("word").distinct().filter("word != 'rareword'").orderBy("word").collect())], "word string, rank int, n long")
    names = [r.word for r in say.collect()]
    dictionary = spark.createDataFrame([(w, False) for w in names if w != "unknown"] + [("bill", True)], "word string, proper boolean")
    none = words_of(spark)
    meanings = spark.createDataFrame([("lewd", "sexual")], "word string, category string")
    got = {r.word: r.reason for r in pool.frequency_pool(say, rank, words_of(spark, "badword"), words_of(spark, "jones"), words_of(spark, "paris"), dictionary, none.withColumn("proper", F.lit(False)), words_of(spark, "handed"), meanings, none).collect()}
    assert got == {
        "goodword": None, "walked": "inflected", "walk": None, "ab": "length", "don't": "letters", "rareword": "rare", "badword": "offensive", "jones": "name", "paris": "place", "unknown": "uncommon", "bill": "proper", "handed": "excluded",
        "colour": "variant", "color": "variant", "lewd": "meaning", "read": "two_ways"}
    graded = spark.createDataFrame([("walk", "A1"), ("goodword", "C2"), ("walked", "A1"), ("missing", "A1"), ("lewd", "A2")], "word string, level string")
    got = {r.word: r.reason for r in pool.graded_pool(graded, say, none, dictionary, dictionary, none, none, meanings, words_of(spark, "lewd"), levels=("A1", "A2")).collect()}
    assert got == {"walk": None, "goodword": "level", "walked": "inflected", "missing": "unspoken", "lewd": None}
    assert {r.word for r in pool.reference_words(say, rank.withColumn("position", F.col("rank")), 3).collect()} == {r.word for r in rank.orderBy("rank").limit(3).collect()}


def test_measures(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (5, 1, 3, 3)] + [("b", None), ("b", 2.0)], "g string, v double")
    assert {r.g: r["median"] for r in measure.upper_median(df, "v", ["g"]).collect()} == {"a": 3.0, "b": 2.0}
    assert measure.upper_median(df, "v").first()["median"] == 3.0
    assert {r.g: r.radius for r in measure.farthest(df, ["g"], "v").collect()} == {"a": 5.0, "b": 2.0}
    lat, lng = measure.sphere_point(F.col("id"))
    r = spark.range(4000).select(lat.alias("lat"), lng.alias("lng")).selectExpr("avg(sin(radians(lat))) s", "min(lng) lo", "max(lng) hi", "avg(lng) m").first()
    assert abs(r.s) < 0.05 and -180 <= r.lo < -170 and 170 < r.hi < 180 and abs(r.m) < 8


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_upper_median_of_many_values(spark):
    import random

    rng = random.Random(4)
    values = [rng.choice([0.5, round(rng.gauss(0, 100), 3), rng.random()]) for _ in range(20_000)]
    df = spark.createDataFrame([(k % 3 or None, v) for k, v in enumerate(values)], "g long, v double").repartition(7)
    assert measure.upper_median(df, "v", accuracy=100).first()["median"] == sorted(values)[len(values) // 2]
    want = {g: sorted(v for k, v in enumerate(values) if (k % 3 or None) == g) for g in (None, 1, 2)}
    assert {r.g: r["median"] for r in measure.upper_median(df, "v", ["g"], accuracy=100).collect()} == {g: v[len(v) // 2] for g, v in want.items()}
    assert measure.upper_median(df.limit(0), "v").first()["median"] is None


def test_numbered(spark):
    from sayplace.operators.tables import numbered

    rows = [(k * 7919 % 1000 // 3, k) for k in range(1000)]
    got = numbered(spark.createDataFrame(rows, "n long, position long").repartition(5), [F.desc("n"), "position"], "rank").collect()
    assert [(r.n, r.position) for r in sorted(got, key=lambda r: r["rank"])] == sorted(rows, key=lambda r: (-r[0], r[1])) and sorted(r["rank"] for r in got) == list(range(1000))
    assert numbered(spark.createDataFrame([], "n long, position long"), ["n"], "rank").count() == 0


def test_first_fit_on_a_long_chain(spark):
    from sayplace.operators.selection import first_fit

    n = 60
    vertices = spark.createDataFrame([(f"w{k:03}", k) for k in range(n)], "word string, order long")
    edges = spark.createDataFrame([(f"w{a:03}", f"w{b:03}") for k in range(n - 1) for a, b in ((k, k + 1), (k + 1, k))], "word string, other string")
    assert {r.order for r in first_fit(vertices, edges).filter("taken").collect()} == set(range(0, n, 2))


PHONEMES = ["AA", "AO", "IY", "B", "P", "S", "Z", "K"]


def said(rng, n):
    return {f"{chr(97 + k % 26)}{chr(97 + k // 26)}word{k}": [rng.choice(PHONEMES) for _ in range(rng.randrange(2, 6))] for k in range(n)}


def test_bound_is_below_distance():
    rng = random.Random(12)
    a, b = ([[rng.choice(PHONEMES) for _ in range(rng.randrange(7))] for _ in range(500)] for _ in range(2))
    d, low = phonetics.distances(a, b), phonetics.bounds(a, b)
    assert (low <= d + 1e-12).all() and (low > 0).any()
    cut = phonetics.distances(a, b, 1.1)
    assert all(x == y or (x == math.inf and y >= 1.1) for x, y in zip(cut, d)) and (cut < math.inf).any()
    assert len(phonetics.bounds([], [])) == 0 == len(phonetics.distances([], [], 1.0))


def test_distinct_sounds_and_closest(spark):
    rng = random.Random(13)
    words = said(rng, 60)
    df = spark.createDataFrame([(w, p, k) for k, (w, p) in enumerate(words.items())], "word string, phonemes array<string>, order long").repartition(4)
    names, taken = list(words), []
    d = {(a, b): x for a in names for b, x in zip(names, phonetics.distances([words[a]] * len(names), [words[b] for b in names]))}
    for w in names:
        if all(d[w, v] >= 1.1 for v in taken):
            taken.append(w)
    got = [r.word for r in selection.distinct_sounds(df, 1.1).orderBy("order").collect()]
    assert got == taken and 5 < len(taken) < 60
    assert [r.word for r in selection.distinct_sounds(df, 1.1, size=4).orderBy("order").collect()] == taken[:4]
    near = sorted((x, a, b) for (a, b), x in d.items() if a < b and x < 2.0)
    assert [tuple(r) for r in phonetics.closest(df, 7).collect()] == near[:7]


def test_select_kinds(spark):
    """Each kind has the list that it would have alone."""
    rng = random.Random(14)
    words = said(rng, 45)
    rows = [(w, p, k, "anv"[k % 3]) for k, (w, p) in enumerate(words.items())]
    df = spark.createDataFrame(rows, "word string, phonemes array<string>, order long, kind string")
    edges = selection.conflicts(df.select("word", "phonemes"), df.select("word"))
    got = {(r.kind, r.word, r.order, r.round) for r in selection.select_kinds(df, edges).collect()}
    for kind in "anv":
        own = df.filter(F.col("kind") == kind)
        alone, _ = selection.select(own.select("word", "order"), selection.conflicts(own.select("word", "phonemes"), df.select("word")))
        assert {x[1:] for x in got if x[0] == kind} == {(r.word, r.order, r.round) for r in alone.collect()}


def test_levels_and_tagged_counts(spark):
    rows = spark.createDataFrame([("a", None), ("b", "rare"), ("c", None), ("d", None)], "word string, reason string")
    graded = spark.createDataFrame([("a", "b1"), ("c", "C2"), ("d", "A1"), ("d", "A1")], "word string, level string")
    got = {r.word: r.reason for r in pool.of_levels(rows, graded, ("A1", "B1")).collect()}
    assert got == {"a": None, "b": "rare", "c": "not_graded", "d": None}
    senses = spark.createDataFrame([("run", "v", 0, "1", 7), ("run", "v", 1, "2", 7), ("run", "n", 0, "3", 0)], "word string, kind string, place int, offset string, tagged long")
    assert {tuple(r) for r in wordlists.tagged_counts(senses).collect()} == {("run", "v", 8), ("run", "n", 1)}


def test_mask_points_and_squareness(spark):
    from sayplace.operators.codecs import Plane

    plane = Plane()
    n = len(plane.grid.squares)
    df = spark.createDataFrame([(0, 0.01, 0.99), (n - 1, 0.5, 0.5), (n // 2, 0.999, 0.001), (n, 0.5, 0.5), (None, 0.5, 0.5)], "rank long, east double, north double")
    df = measure.mask_point(df, plane.grid, "rank", F.col("east"), F.col("north"), "lat", "lng")
    got = {r["rank"]: r.cell for r in plane.grid.cell(df, "lat", "lng", plane.k, "cell").collect()}
    assert {k: v // plane.k**2 for k, v in got.items() if v is not None} == {0: 0, n - 1: n - 1, n // 2: n // 2} and got[n] is None is got[None]
    rows = spark.createDataFrame(measure.grid_corners(), "x double, y double")
    off = [r.off for r in measure.squareness(rows, "x", "y", 2000.0, "off").collect()]
    # The grid is made so that cells are square within half a percent at its corners.
    assert len(off) == 5 and 0 < max(off) < 0.005
