import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from sayplace.functions.numbers import digits, horner, sha_mod
from sayplace.functions.plane import Projection, great_circle, wrapped
from sayplace.operators import cells, mask, text
from sayplace.operators.codecs import Phrase, Plane, World
from sayplace.operators.feistel import Feistel
from sayplace.operators.vocabulary import Vocabulary, built_in, built_in_kinds

#: Numbers and their images under the three permutations.
KNOWN = [
    (Feistel(60466176, 60466176), [(0, 579385187702070), (1, 3011622845203281), (2563464692609525, 1167912722722190), (2248930270782660, 2759726946811334)]),
    (Feistel(46656, 46656, key=b"uk", hash_bytes=4), [(0, 310616742), (1, 1587441874), (36422432, 1776761177), (363698845, 1541983142)]),
    (Feistel(367 * 800, 419 * 800, key=b"ukp", half_bytes=8), [(0, 16691799550), (1, 36132904384), (73050866464, 5936257475), (68235284052, 37835577805)]),
]
#: Cells of the index, the last one a pentagon's centre.
CELLS = ["8e194ad14c254f7", "8e19727657582b7", "8e1870cb6d6836f", "8e182c17498bb27", "8e4c00000000007"]


@pytest.fixture(scope="module")
def world():
    return World()


@pytest.fixture(scope="module")
def plane():
    return Plane()


@pytest.fixture(scope="module")
def phrase(plane):
    return Phrase(plane.grid)


@pytest.mark.parametrize("f, pairs", KNOWN)
def test_permutations(spark, f, pairs):
    df = f.back(f.forward(spark.createDataFrame(pairs, "v long, n long"), "v", "image"), "n", "source")
    assert all(r.image == r.n and r.source == r.v for r in df.collect())
    rng = random.Random(1)
    values = [(rng.randrange(f.space),) for _ in range(2000)] + [(f.space - 1,)]
    df = f.back(f.forward(spark.createDataFrame(values, "v long"), "v", "n"), "n", "back")
    assert df.filter("back != v or n < 0").count() == 0
    assert f.forward(spark.createDataFrame([(None,)], "v long"), "v", "n").first().n is None


def test_rounds_stay_apart(spark):
    """One projection a round: hashes don't multiply (each is written twice, for its two halves)."""
    f = KNOWN[1][0]
    plan = f.forward(spark.range(5), "id", "n")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == f.rounds


def test_hash(spark):
    rows = spark.createDataFrame([(bytes([k, 255 - k]).hex(),) for k in range(200)], "m string")
    for r in rows.select("m", sha_mod(F.col("m"), 60466176).alias("a"), sha_mod(F.col("m"), 44, 4).alias("b")).collect():
        h = hashlib.sha256(bytes.fromhex(r.m)).digest()
        assert r.a == int.from_bytes(h[:8], "big") % 60466176 and r.b == int.from_bytes(h[:4], "big") % 44
    parts = digits(F.lit(12345), [7, 50, 60])
    assert spark.range(1).select(horner(parts, [7, 50, 60]).alias("v")).first().v == 12345


def test_cells(spark):
    df = spark.createDataFrame([(int(c, 16),) for c in CELLS], "cell long")
    df = df.withColumn("ordinal", cells.ordinal(F.col("cell"))).withColumn("again", cells.cell(F.col("ordinal"))).withColumn("ok", cells.valid(F.col("again")))
    assert all(r.cell == r.again and r.ok and 0 <= r.ordinal < cells.SLOTS for r in df.collect())
    # A pentagon has no children along the first axis.
    pentagon = spark.createDataFrame([(4 * 7**14 + 1,), (4 * 7**14 + 2,), (5 * 7**14 + 1,)], "x long").select(cells.valid(cells.cell(F.col("x"))).alias("ok"))
    assert [r.ok for r in pentagon.collect()] == [False, True, True]


def test_world(spark, world):
    assert world.check == 44 and world.used == 3640701455053432
    df = world.decode(world.encode(spark.createDataFrame([(int(c, 16),) for c in CELLS], "c long"), "c"), "words")
    assert all(r.cell == r.c and r.status == "ok" for r in df.collect())
    good = world.words.words
    said = [(None,), ([],), (list(good[:4]),), ([*good[:4], "nowhere"],), (["nowhere"],), (list(good[:5]),)]
    got = [r.status for r in world.decode(spark.createDataFrame(said, "w array<string>"), "w").collect()]
    assert got[:5] == [None, "wrong_count", "wrong_count", "unknown_word", "unknown_word"] and got[5] in ("ok", "no_such_address", "no_such_cell", "check_failed")


def test_projection(spark):
    p = Projection()
    rows = spark.createDataFrame([(p.lat, p.lng), (51.5, -0.1), (60.8, -0.9), (49.9, -6.3)], "lat double, lng double")
    x, y = p.to_plane(F.col("lat"), F.col("lng"))
    df = rows.withColumns({"x": x, "y": y})
    lat, lng = p.to_sphere(F.col("x"), F.col("y"))
    for r in df.withColumns({"a": lat, "b": lng}).collect():
        assert abs(r.a - r.lat) < 1e-8 and abs(r.b - r.lng) < 1e-8
    d = spark.range(1).select(great_circle(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("d"), great_circle(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("n"), wrapped(F.lit(190.0)).alias("w")).first()
    assert abs(d.d - math.pi * 6371008.8) < 1e-3 and d.n is None and d.w == -170


def test_plane(spark, plane):
    df = spark.range(3000).selectExpr("50.0D + id * 7919 % 90001 / 10000D as lat", "-6.0D + id * 104729 % 75001 / 10000D as lng")
    df = plane.number(plane.encode(df, "lat", "lng", status="encoded"), "lat", "lng", "cell").withColumnRenamed("cell", "at")
    df = plane.decode(df.filter("encoded = 'ok'"), "words", "a", "b")
    df = plane.decode(df.drop("cell", "status"), "words", "c", "d", number="number")
    df = df.withColumns({"near": great_circle(F.col("lat"), F.col("lng"), F.col("a"), F.col("b")), "nearer": great_circle(F.col("lat"), F.col("lng"), F.col("c"), F.col("d"))})
    r = df.selectExpr("count(*) n", "max(near) near", "max(nearer) nearer", "count_if(at = cell and status = 'ok') same").first()
    side = mask.SIDE / plane.k
    assert r.n > 500 and r.same == r.n and r.near < side * 0.72 and r.nearer < side * 0.37
    outside = plane.encode(spark.createDataFrame([(48.8566, 2.3522), (40.7, -74.0), (None, 1.0)], "lat double, lng double"), "lat", "lng").collect()
    assert [(x.cell, x.words, x.status) for x in outside] == [(None, None, "outside"), (None, None, "outside"), (None, None, None)]


def test_optional_number(spark, plane):
    df = spark.createDataFrame([(12345, q) for q in range(-1, 101)], "cell long, number long")
    df = plane.scramble.forward(df, "cell", "n")
    from sayplace.operators.codecs import _spoken

    df = plane.decode(df.withColumn("words", _spoken(F.col("n"), [plane.words] * 3)).drop("cell"), "words", number="number")
    got = {r.number: r.status for r in df.collect()}
    assert got[-1] == got[100] == "number_range"
    assert sorted(got.values()).count("ok") == 4 and sorted(n // 25 for n, s in got.items() if s == "ok") == [0, 1, 2, 3]


def test_phrase(spark, phrase):
    df = phrase.encode(spark.range(2000).selectExpr("51.0D + id % 50 / 60D as lat", "-2.5D + id div 50 / 60D as lng"), "lat", "lng", status="encoded").filter("encoded = 'ok'").withColumnRenamed("cell", "at")
    df = phrase.decode(df, "words")
    assert df.count() > 500 and df.filter("at != cell or status != 'ok'").count() == 0
    lists = {k: v.words for k, v in phrase.lists.items()}
    said = [([lists["noun"][0], lists["noun"][1], lists["verb"][0], lists["noun"][2]],), (["x"],), ([lists["adjective"][0], "zzz", lists["verb"][0], lists["noun"][0]],)]
    got = [(r.status, r.hint) for r in phrase.decode_cell(spark.createDataFrame(said, "w array<string>"), "w", hint="hint").collect()]
    assert got == [("unknown_word", "noun"), ("wrong_count", None), ("unknown_word", None)]
    assert phrase.check >= 20


def test_lists(spark, tmp_path):
    assert len(built_in()) == 1296 and {k: len(v) for k, v in built_in_kinds().items()} == {"adjective": 367, "noun": 800, "verb": 419}
    (tmp_path / "list").write_text("b\na c\n")
    v = Vocabulary.read(spark, str(tmp_path / "list"), 3, hashlib.sha256(b"b\na c\n").hexdigest())
    assert v.words == ("b", "a", "c")
    with pytest.raises(ValueError):
        Vocabulary.read(spark, str(tmp_path / "list"), sha256="0")
    with pytest.raises(ValueError):
        Vocabulary(("a", "a"))


@pytest.mark.parametrize("said, words, number, status", [
    ("a b c", "a b c", None, "ok"), ("A.b, c 07", "a b c", 7, "ok"), (" a-b/c forty two ", "a b c", 42, "ok"), ("a b c four two", "a b c", 42, "ok"), ("a b c oh seven", "a b c", 7, "ok"), ("a b c 4 2", "a b c", 42, "ok"),
    ("a ten b", "a ten b", None, "ok"), ("", None, None, "empty"), (" . ", None, None, "empty"), ("forty", None, None, "no_words"), ("a 123", None, None, "bad_number"), ("a forty zero", None, None, "bad_number"), ("a twelve three", None, None, "bad_number"),
    ("a thirteen", "a", 13, "ok"), (None, None, None, None)])
def test_parse(spark, said, words, number, status):
    r = text.parse_full(spark.createDataFrame([(said,)], "said string"), "said").first()
    assert (r.words and " ".join(r.words), r.number, r.status) == (words, number, status)


def test_parse_words(spark):
    df = spark.createDataFrame([("A.b, c",), ("\ta\tb ",), (" ",), (None,)], "t string").select(text.parse_words(F.col("t")).alias("p"))
    assert [r.p and (r.p.words, r.p.status) for r in df.collect()] == [(["a", "b", "c"], "ok"), (["a\tb"], "ok"), (None, "empty"), None]


def test_runs(spark, plane):
    squares = [3, 4, 5, 9, 20, 21]
    df = spark.createDataFrame([(s,) for s in squares], "square long")
    runs = mask.encode_runs(df, 25).orderBy("at").collect()
    assert [r.run for r in runs] == [3, 3, 3, 1, 10, 2, 3]
    assert sorted(r.square for r in mask.decode_runs(spark.createDataFrame(runs), "at", "run").collect()) == squares
    grown = {r.square for r in mask.dilate(spark.createDataFrame([(12,)], "square long"), 5, 5).collect()}
    assert grown == {6, 7, 8, 11, 12, 13, 16, 17, 18}
    assert sum(plane.grid.runs) == mask.WIDTH * mask.HEIGHT and len(plane.grid.squares) == sum(plane.grid.runs[1::2])


def test_fill_against_points(spark):
    ring = [(0.3, 0.2), (9.4, 1.1), (5.2, 5.3), (9.1, 9.7), (0.6, 8.8), (3.3, 4.4)]
    rings = spark.createDataFrame([(1, ring)], "ring int, points array<struct<x: double, y: double>>")
    got = {(r.j, r.i) for r in mask.fill(mask.ring_edges(rings, "ring", "points"), 1.0, 0.0, 0.0, 10, 10).collect()}
    want = set()
    for j in range(10):
        for i in range(10):
            x, y, inside = i + 0.5, j + 0.5, False
            for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
                if (y0 <= y) != (y1 <= y) and x0 + (y - y0) * (x1 - x0) / (y1 - y0) < x:
                    inside = not inside
            if inside:
                want.add((j, i))
    assert got == want


def test_geojson(spark, tmp_path):
    square = [[-3.4, 54.9], [-3.3, 54.9], [-3.3, 55.0], [-3.4, 55.0]]
    (tmp_path / "g.json").write_text(__import__("json").dumps({"features": [
        {"properties": {"ADM0_A3": "GBR"}, "geometry": {"type": "Polygon", "coordinates": [square]}}, {"properties": {"ADM0_A3": "IMN"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}},
        {"properties": {"ADM0_A3": "FRA"}, "geometry": {"type": "Polygon", "coordinates": [square]}}]}))
    rings = mask.rings_from_geojson(spark, str(tmp_path / "g.json"), Projection())
    assert rings.count() == 3
    squares = {r.square for r in mask.mask_from_rings(rings, "ring", "points").collect()}
    assert (308 + 321 * mask.WIDTH) in squares and 20 < len(squares) < 80


def test_generated_methods_are_small_enough_to_be_compiled(spark):
    """The JVM only interprets methods of more than 8000 bytes."""
    from sayplace.plans import queries

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("uk_encode", "uk_square_density", "uk_decode_with", "global_words", "global_decode_status", "phrase_encode"):
            plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
            stages = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package").codegenStringSeq(plan)
            assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000, name
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
