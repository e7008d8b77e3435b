"""The codecs, measurements and word-list operators applied to the standard tables.

The tables hold no coordinates and no pronunciations, so points come from keys by whole-number
arithmetic, and phonemes from letters by a fixed map that stands in for a pronouncing dictionary.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sayplace.functions.numbers import digits
from sayplace.functions.plane import great_circle
from sayplace.operators import cells, mask, measure, phonetics, points, pool, selection, semantics, spelling, tables, text
from sayplace.operators.codecs import Phrase, Plane, World, spoken_text
from sayplace.sources import wordlists


@cache
def world() -> World:
    return World()


@cache
def plane() -> Plane:
    return Plane()


@cache
def phrase() -> Phrase:
    return Phrase()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_point(df: DataFrame, key: str) -> DataFrame:
    """lat, lng: a point in and around the built-in mask, from a whole number."""
    k = F.col(key)
    return df.withColumns({"lat": 50.0 + (k * 7919 + 13) % 900001 / 100000.0, "lng": -6.0 + (k * 104729 + 7) % 750001 / 100000.0})


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey")


def uk_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = plane().encode(with_point(orders(spark, sf_dir), "o_orderkey"), "lat", "lng")
    return df.select("o_orderkey", "cell", spoken_text(F.col("words")).alias("words"), "status")


def uk_roundtrip_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = plane().encode(with_point(orders(spark, sf_dir), "o_orderkey"), "lat", "lng", status="encoded").filter("encoded = 'ok'").drop("cell")
    df = plane().decode(df, "words", "to_lat", "to_lng")
    error = F.round(great_circle(F.col("lat"), F.col("lng"), F.col("to_lat"), F.col("to_lng")), 6)
    df = tables.written(df.select("status", error.alias("error")))
    whole = df.agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("status") == "ok").alias("decoded"), F.round(F.max("error"), 4).alias("worst"))
    return whole.crossJoin(measure.upper_median(df, "error").select(F.round("median", 4).alias("median_error")))


def uk_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = plane().encode(with_point(orders(spark, sf_dir), "o_orderkey"), "lat", "lng").filter("status = 'ok'")
    df = plane().number(df, "lat", "lng", "cell")
    return df.select("o_orderkey", "number", plane().text(F.col("words"), F.col("number")).alias("address"))


def uk_decode_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = plane().encode(with_point(orders(spark, sf_dir), "o_orderkey"), "lat", "lng", status="encoded").filter("encoded = 'ok'")
    df = plane().number(df, "lat", "lng", "cell", "right").drop("cell")
    tried = F.when(F.col("o_orderkey") % 4 == 0, F.col("right")).when(F.col("o_orderkey") % 4 == 1, F.lit(None)).when(F.col("o_orderkey") % 4 == 2, (F.col("right") + 1) % 100).otherwise(F.lit(100))
    df = plane().decode(df.withColumn("tried", tried.cast("long")), "words", "to_lat", "to_lng", number="tried")
    return df.select("o_orderkey", "tried", "status", F.round("to_lat", 6).alias("to_lat"), F.round("to_lng", 6).alias("to_lng"))


def uk_outside_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    df = plane().encode(with_point(customers, "c_custkey"), "lat", "lng")
    counts = df.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("status") == "outside").alias("outside"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return counts.join(nations, "c_nationkey").select("n_name", "customers", "outside")


def uk_square_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"))
    g = plane().grid
    df = g.cell(with_point(items, "key"), "lat", "lng", plane().k, "cell").filter("cell is not null")
    counts = df.groupBy(F.expr(f"cell div {plane().k ** 2}").alias("rank")).agg(F.count(F.lit(1)).alias("items"))
    return counts.orderBy(F.desc("items"), "rank").limit(20)


def _cell(key: str) -> Column:
    return cells.cell((F.col(key) * 1_000_003_000_037 + 17) % cells.SLOTS)


def global_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = world().encode(orders(spark, sf_dir).withColumn("cell", _cell("o_orderkey")), "cell")
    return df.select("o_orderkey", "cell", cells.valid(F.col("cell")).alias("valid"), spoken_text(F.col("words")).alias("words"))


def global_scramble(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders(spark, sf_dir).withColumn("value", F.col("o_orderkey") * 1_000_003_000_037 % world().scramble.space)
    df = world().scramble.forward(df, "value", "number")
    return world().scramble.back(df, "number", "back").select("o_orderkey", "value", "number", "back")


def with_sphere_point(df: DataFrame, key: str) -> DataFrame:
    """lat, lng: a point anywhere on the sphere, the poles and the last meridian among them, from a whole number."""
    k = F.col(key)
    return df.withColumns({"lat": (k * 7919 + 13) % 180001 / 1000.0 - 90, "lng": (k * 104729 + 7) % 360001 / 1000.0 - 180})


def world_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = world().encode_point(with_sphere_point(orders(spark, sf_dir), "o_orderkey"), "lat", "lng")
    return df.select("o_orderkey", F.hex("cell").alias("cell"), spoken_text(F.col("words")).alias("words"))


def world_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From points to words and back: the words' cell is the point's, and so is its centre's, which is within the longest radius of a cell."""
    df = world().encode_point(with_sphere_point(orders(spark, sf_dir), "o_orderkey"), "lat", "lng", cell="at")
    df = world().decode_point(df, "words", "to_lat", "to_lng").withColumn("again", points.cell_at(F.col("to_lat"), F.col("to_lng")))
    error = great_circle(F.col("lat"), F.col("lng"), F.col("to_lat"), F.col("to_lng"))
    return df.select("o_orderkey", "status", (F.col("cell") == F.col("at")).alias("same_cell"), (F.col("again") == F.col("at")).alias("centre_inside"), (error < 1.9).alias("near"))


def mask_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points spread over the mask's squares; each has an address."""
    k = F.col("o_orderkey")
    df = orders(spark, sf_dir).withColumn("rank", k * 7919 % len(plane().grid.squares))
    df = measure.mask_point(df, plane().grid, "rank", k * 31 % 1000 / 1000 + 0.0005, k * 17 % 1000 / 1000 + 0.0005, "lat", "lng")
    df = plane().grid.cell(df, "lat", "lng", plane().k, "cell")
    return df.select("o_orderkey", "rank", F.expr(f"cell div {plane().k ** 2}").alias("square_rank"))


def plane_squareness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How square cells are on the ground at the grid's corners and in its middle."""
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(measure.grid_corners())], "corner long, x double, y double")
    df = measure.squareness(rows, "x", "y", mask.SIDE, "off")
    return df.select("corner", F.round("off", 6).alias("off"))


def _mutated(spark: SparkSession, sf_dir: str, lists: list, df: DataFrame) -> DataFrame:
    return measure.substituted(df, "words", F.col("o_orderkey") % len(lists), F.col("o_orderkey") * 31, lists, "said")


def global_decode_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = world().encode(orders(spark, sf_dir).withColumn("from_cell", _cell("o_orderkey")), "from_cell")
    df = world().decode(_mutated(spark, sf_dir, [world().words] * 5, df), "said")
    return df.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def phrase_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = phrase().encode(with_point(orders(spark, sf_dir), "o_orderkey"), "lat", "lng")
    return df.select("o_orderkey", "cell", spoken_text(F.col("words")).alias("words"), "status")


def phrase_wrong_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a wrong word of the right kind does: refused, or how far off the place is."""
    df = phrase().encode(with_point(orders(spark, sf_dir), "o_orderkey"), "lat", "lng", status="encoded").filter("encoded = 'ok'").drop("cell")
    df = phrase().decode(_mutated(spark, sf_dir, phrase().slots, df), "said", "to_lat", "to_lng")
    return _refusals(df)


def _refusals(df: DataFrame) -> DataFrame:
    km = F.round(great_circle(F.col("lat"), F.col("lng"), F.col("to_lat"), F.col("to_lng")) / 1000, 3)
    df = tables.written(df.select("status", km.alias("km")))
    whole = df.agg(F.count(F.lit(1)).alias("trials"), F.count_if(F.col("status") != "ok").alias("refused"), F.count_if(F.col("km") < 1).alias("within_1_km"))
    return whole.crossJoin(measure.upper_median(df, "km").select(F.round("median", 2).alias("median_km")))


def uk_wrong_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = plane().encode(with_point(orders(spark, sf_dir), "o_orderkey"), "lat", "lng", status="encoded").filter("encoded = 'ok'").drop("cell")
    return _refusals(plane().decode(_mutated(spark, sf_dir, [plane().words] * 3, df), "said", "to_lat", "to_lng"))


def uk_wrong_word_with_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = plane().encode(with_point(orders(spark, sf_dir), "o_orderkey"), "lat", "lng", status="encoded").filter("encoded = 'ok'")
    df = plane().number(df, "lat", "lng", "cell").drop("cell")
    df = plane().decode(_mutated(spark, sf_dir, [plane().words] * 3, df), "said", "to_lat", "to_lng", number="number")
    return _refusals(df)


def neighbour_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the addresses of a cell and the next one have in the same place."""
    df = orders(spark, sf_dir).withColumn("value", F.col("o_orderkey") * 104_729 % (plane().count - 1)).withColumn("next", F.col("value") + 1)
    for value, words in (("value", "here"), ("next", "there")):
        df = plane().scramble.forward(df, value, "number")
        df = df.withColumn(words, F.array(*(plane().words.spell(d) for d in _three(F.col("number"))))).drop("number")
    return df.groupBy(measure.shared_words(F.col("here"), F.col("there")).alias("shared")).agg(F.count(F.lit(1)).alias("n"))


def _three(number: Column) -> list[Column]:
    return digits(number, [1296] * 3)


def collision_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.collisions(plane().encode(with_point(orders(spark, sf_dir), "o_orderkey"), "lat", "lng"), "cell", "words")


def numbers_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer's cell, the numbers from 00 to 99 that fit it."""
    df = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 1_299_709 % plane().count).alias("cell"))
    df = df.withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long"))))
    fits = plane().check_of(F.col("cell"), F.expr(f"number div {plane().check}")) == F.col("number") % plane().check
    return df.filter(fits).groupBy("c_custkey", "cell").agg(F.array_join(F.sort_array(F.collect_list("number")), ",").alias("numbers"))


def with_said(df: DataFrame, key: str) -> DataFrame:
    """said: addresses as people type them, in nine forms."""
    k = F.col(key)
    df = df.withColumns({name: plane().words.spell(k * p % 1296) for name, p in (("_a", 1), ("_b", 7), ("_c", 11))})
    a, b, c = F.col("_a"), F.col("_b"), F.col("_c")
    forms = [
        F.concat_ws(".", a, b, c), F.concat_ws(", ", F.upper(a), b, c), F.concat(F.lit("  "), F.concat_ws(" ", a, b, c), F.lit(" 07 ")), F.concat_ws(" ", a, b, c, F.lit("forty two")),
        F.concat_ws("/", a, b, c, F.lit("four"), F.lit("oh")), F.lit(" . "), F.lit("seventeen"), F.concat_ws(" ", a, b, c, F.lit("twelve three")), F.concat_ws("-", a, F.lit("ten"), b, F.lit("4"), F.lit("2"))]
    return df.withColumn("said", F.element_at(F.array(*forms), (k % len(forms) + 1).cast("int"))).drop("_a", "_b", "_c")


def parse_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = text.parse_full(with_said(orders(spark, sf_dir), "o_orderkey"), "said")
    return df.select("o_orderkey", F.array_join("words", " ").alias("words"), F.col("number").cast("long").alias("number"), "status")


def parse_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_said(orders(spark, sf_dir), "o_orderkey").withColumn("p", text.parse_words(F.col("said")))
    return df.select("o_orderkey", F.array_join("p.words", " ").alias("words"), F.col("p.status").alias("status"))


def mask_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask's run lengths again, from its squares."""
    return mask.encode_runs(plane().grid.table(spark), mask.WIDTH * mask.HEIGHT)


def mask_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spark.createDataFrame(list(enumerate(plane().grid.runs)), "at long, run long")
    return mask.decode_runs(runs, "at", "run").agg(F.count(F.lit(1)).alias("squares"), F.min("square").alias("first"), F.max("square").alias("last"))


def mask_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = mask.dilate(plane().grid.table(spark))
    return grown.agg(F.count(F.lit(1)).alias("squares"), F.sum("square").alias("total"))


#: A ring in metres of the plane for the scanline query: concave, so rows cross it up to four times.
RING = [(-300000.5, -300000.25), (100000.5, -250000.25), (50000.5, 0.25), (250000.5, 200000.25), (-50000.5, 100000.25), (-250000.5, 300000.25), (-150000.5, -50000.25)]


def scanline_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = spark.createDataFrame([(1, RING)], "ring long, points array<struct<x: double, y: double>>")
    rows = mask.fill(mask.ring_edges(rings, "ring", "points"), mask.SIDE, mask.WEST, mask.SOUTH, mask.WIDTH, mask.HEIGHT)
    return rows.groupBy("j").agg(F.count(F.lit(1)).alias("samples"), F.min("i").alias("first"), F.max("i").alias("last"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (word, n): lower-case words of four to nine letters in documents, with their counts."""
    all_words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]+"), F.lit(0))).alias("word"))
    return all_words.filter(F.length("word").between(4, 9)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def ranked_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordlists.ranked(tokens(spark, sf_dir).withColumn("position", F.col("word")))


def token_frequency_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ranked_tokens(spark, sf_dir)
    return df.select("word", "n", F.col("rank").cast("long").alias("rank"), pool.affordable(F.col("word"), F.col("rank") * 20).alias("affordable"))


#: The stand-in for a pronouncing dictionary: each letter's phoneme.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", "AE B K D EH F G HH IH JH K L M N AA P K R S T AH V W Z IY ZH".split()))


def _letters(word: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in LETTERS.items() for x in pair])
    return F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.element_at(named, c))


def syllable_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tokens(spark, sf_dir).withColumn("syllables", phonetics.syllables(_letters(F.col("word"))))
    return df.groupBy(F.col("syllables").cast("long").alias("syllables")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("uses"))


def spoken_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).select("word", "n", _letters(F.col("word")).alias("phonemes"))


def phonetic_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phonetics.audit(spoken_tokens(spark, sf_dir), 2.0)


def isolation_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens against the reference's number of the commonest ones."""
    words = spoken_tokens(spark, sf_dir)
    said = words.select("word", F.array_join("phonemes", " ").alias("pronunciation"), F.col("word").alias("position"))
    frequency = words.select("word", "n", F.col("word").alias("position"))
    return phonetics.isolation(words, pool.reference_words(said, frequency))


def keystroke_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.keystroke_pairs(tokens(spark, sf_dir).select("word"))


def contained_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.contained_pairs(tokens(spark, sf_dir).select("word"))


def inflected_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokens(spark, sf_dir)
    return spelling.inflections(words.select("word"), words.select("word"), words)


def variant_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokens(spark, sf_dir).select("word")
    return spelling.with_variants(words, words)


def compound_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokens(spark, sf_dir).select("word")
    return spelling.splits(words, words, 4)


def word_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokens(spark, sf_dir).select("word")
    return spelling.families(words, words).groupBy("word").agg(F.count(F.lit(1)).alias("members"))


def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequency chain over the tokens, with the vocabulary's own words standing for the dictionaries."""
    words = ranked_tokens(spark, sf_dir)
    spoken = words.select("word", F.array_join(_letters(F.col("word")), " ").alias("pronunciation"), "position")
    none = spark.createDataFrame([], "word string")
    dictionary = words.select("word", F.lit(False).alias("proper"))
    starts = lambda p: words.filter(F.col("word").startswith(p)).select("word")
    chain = pool.frequency_pool(spoken, words, starts("wh"), starts("an"), starts("es"), dictionary, dictionary, starts("on"), none, none)
    return pool.tallies(chain)


def greedy_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of distinct words out of all tokens, by frequency."""
    words = tables.written(spoken_tokens(spark, sf_dir))
    ranked = wordlists.ranked(words.withColumn("position", F.col("word"))).select("word", "phonemes", (F.col("rank") + 1).alias("order"))
    ranked = tables.written(ranked)
    spoken = ranked.select("word", "phonemes")
    chosen, _ = selection.select(ranked.select("word", "order"), selection.close(spoken), keys=selection.claims(spoken, words.select("word")))
    return chosen.select("word", F.col("order").cast("long").alias("order"), F.col("round").cast("long").alias("round"))


def distinct_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens in order of frequency, none sounding like one before it."""
    ranked = wordlists.ranked(spoken_tokens(spark, sf_dir).withColumn("position", F.col("word")))
    return selection.distinct_sounds(ranked.select("word", "phonemes", F.col("rank").alias("order")), 1.1)


def closest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phonetics.closest(spoken_tokens(spark, sf_dir))


def sound_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phonetics.report(spoken_tokens(spark, sf_dir), (0.6, 1.1))


def list_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.statistics(tokens(spark, sf_dir).select("word"))


def list_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens by syllables, and by a made isolation."""
    df = spoken_tokens(spark, sf_dir).withColumn("isolation", F.col("n") % 5 / 2)
    return selection.histograms(df)


def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens by band of rank, the most isolated first; their isolation is made from their counts."""
    df = ranked_tokens(spark, sf_dir).withColumn("isolation", F.col("n") % 5 / 2)
    return selection.ordered(df.select("word", "rank", "isolation", "position")).select("word", "order")


def graded_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of a graded vocabulary over the tokens, with levels made from their counts, and the vocabulary's own words standing for the dictionaries."""
    words = tokens(spark, sf_dir)
    levels = F.array(*(F.lit(x) for x in pool.LEVELS))
    graded = words.select("word", F.get(levels, (F.col("n") % 6).cast("int")).alias("level"))
    said = words.select("word", F.array_join(_letters(F.col("word")), " ").alias("pronunciation"), F.col("word").alias("position"))
    none = spark.createDataFrame([], "word string")
    dictionary = words.select("word", F.lit(False).alias("proper"))
    starts = lambda p: words.filter(F.col("word").startswith(p)).select("word")
    chain = pool.graded_pool(graded, said, starts("wh"), dictionary, dictionary, starts("es"), starts("on"), none, none, levels=("A1", "A2", "B1", "B2", "C1"))
    return pool.tallies(pool.of_levels(chain, graded, ("A1", "A2", "B1")))


def select_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list for each kind of the tokens of seven letters, kinds made from counts, in order of frequency."""
    words = tables.written(spoken_tokens(spark, sf_dir).filter("length(word) = 7"))
    ranked = tables.written(wordlists.ranked(words.withColumn("position", F.col("word"))).select(
        "word", "phonemes", F.col("rank").alias("order"), F.get(F.array(F.lit("a"), F.lit("n"), F.lit("v")), (F.col("n") % 3).cast("int")).alias("kind")))
    edges = selection.conflicts(ranked.select("word", "phonemes"), words.select("word"))
    return selection.select_kinds(ranked.select("word", "order", "kind"), tables.written(edges)).withColumn("round", F.col("round").cast("long"))


def words_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of French documents that English ones don't have."""
    docs = table(spark, sf_dir, "documents")
    of = lambda lang: docs.filter(F.col("lang") == lang).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]{5,9}"), F.lit(0))).alias("word")).distinct()
    return of("fr").exceptAll(of("en"))


def pos_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language that most uses of a word are in stands for its part of speech."""
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in {"en": "n", "fr": "v", "de": "a", "es": "r"}.items() for x in pair]), F.col("lang"))
    rows = table(spark, sf_dir, "documents").select(kind.alias("kind"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]+"), F.lit(0))).alias("word")).filter("length(word) between 2 and 4")
    counts = rows.groupBy("word", "kind").agg((F.count(F.lit(1)) + 1).alias("n"))
    own = spark.createDataFrame([("the", "-"), ("de", "v")], "word string, kind string")
    return selection.part_of_speech(counts, own)


def hypernym_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are kinds of nations, those of regions, those of one root: what is above each supplier."""
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    up = lambda offset: F.array(F.struct(F.lit("@").alias("symbol"), offset.alias("offset"), F.lit("n").alias("kind")))
    name = lambda p, k: F.concat(F.lit(p), k.cast("string"))
    rows = [
        supplier.select(name("s", F.col("s_suppkey")).alias("offset"), F.array(F.col("s_name")).alias("words"), up(name("n", F.col("s_nationkey"))).alias("pointers")),
        nation.select(name("n", F.col("n_nationkey")).alias("offset"), F.array(F.col("n_name")).alias("words"), up(name("r", F.col("n_regionkey"))).alias("pointers")),
        region.select(name("r", F.col("r_regionkey")).alias("offset"), F.array(F.col("r_name")).alias("words"), up(F.lit("root")).alias("pointers"))]
    synsets = rows[0].unionByName(rows[1]).unionByName(rows[2]).select(F.lit("n").alias("kind"), "offset", "words", "pointers", F.lit("").alias("gloss"))
    words = supplier.select(F.lower("s_name").alias("word"))
    senses = supplier.select(F.lower("s_name").alias("word"), F.lit("n").alias("kind"), F.lit(0).alias("place"), name("s", F.col("s_suppkey")).alias("offset"))
    return semantics.ancestors(words, senses, synsets).groupBy("ancestor").agg(F.count(F.lit(1)).alias("words"))


def stream_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid codec on a stream of orders, gathered when the stream has run through."""
    from sayplace.streaming.encode import encode_available

    return encode_available(spark, f"{sf_dir}/orders.parquet", plane()).select("o_orderkey", "cell", spoken_text(F.col("words")).alias("words"), "status")


QUERIES = {f.__name__: f for f in (
    uk_encode, uk_roundtrip_error, uk_digits, uk_decode_with, uk_outside_by_nation, uk_square_density, uk_wrong_word, uk_wrong_word_with_number,
    global_words, global_scramble, global_decode_status, world_points, world_roundtrip, mask_sample, plane_squareness, phrase_encode, phrase_wrong_word, neighbour_share, collision_check, numbers_fit,
    parse_addresses, parse_words, mask_runs, mask_decode, mask_dilate, scanline_fill, token_frequency_rank, syllable_histogram, phonetic_audit,
    isolation_nearest, keystroke_pairs, contained_words, inflected_words, variant_words, compound_words, word_families, reject_reasons,
    greedy_select, distinct_sounds, closest_pairs, sound_report, list_statistics, list_histograms, priority_order, graded_reasons, select_kinds, words_back, pos_dominance, hypernym_closure, stream_encode)}
