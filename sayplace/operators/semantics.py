"""What words mean: everything a sense is a kind of, and categories of meaning by that and by definitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sayplace.operators.selection import written

#: Categories in the order in which they are tested, by what a sense is a kind of.
ROOTS = {
    "sexual": ["sexual desire", "eroticism", "sexual activity", "sex act", "sexual intercourse", "copulation", "genitalia", "sex organ", "reproductive organ", "prostitution"],
    "violence": ["killing", "homicide", "murder", "execution", "weapon", "firearm", "explosive", "corpse", "funeral", "burial", "torture"],
    "drugs": ["narcotic", "drug of abuse", "controlled substance", "poison", "toxin", "venom", "hallucinogen"],
    "clinical": ["disease", "illness", "sickness", "syndrome", "infection", "ailment", "health problem", "pathology", "malignancy", "injury", "trauma", "wound", "internal organ", "viscus"],
    "religious": ["place of worship", "religious person", "religious ceremony", "deity", "sacred text", "clergyman", "religious residence"],
}
#: Then by words of the definition.
GLOSSES = {
    "sexual": r"\b(sexual|sexually|genital|genitalia|uterus|uterine|vagina\w*|penis|testis|testicle|ovary|ovaries|copulation|intercourse|erotic\w*|orgasm\w*|menstrua\w*|lust|prostitut\w*|obscene|incest\w*|sex glands?|sex organs?|sex hormones?)\b",
    "clinical": r"\b(disease|diseased|infection|infected|inflammation|inflamed|tumor|tumour|cancer|cancerous|malignant|carcinoma|abscess|ulcer|venereal|contagious|parasit\w*|deformity|paralysis|amputat\w*)\b",
}


def ancestors(words: DataFrame, senses: DataFrame, synsets: DataFrame, count: int = 1, depth: int = 12, derived: bool = True) -> DataFrame:
    """Rows (word, ancestor): words of a word's first senses and of all they are kinds of, up to a depth.

    From adjectives and adverbs one derivation is followed, to what the word is made from. A state is a
    sense with its depth and whether a derivation is still open; each step joins the newest states with
    the pointers, and a state seen before at no greater depth goes no further, so the steps end. The
    answer is the union over all paths.
    """
    links = synsets.select("kind", "offset", F.explode("pointers").alias("p")).select("kind", "offset", F.col("p.symbol").alias("symbol"), F.col("p.kind").alias("to_kind"), F.col("p.offset").alias("to_offset"))
    start = words.select(F.col("word"), F.lower("word").alias("lower")).join(senses.filter(F.col("place") < count).select(F.col("word").alias("lower"), "kind", "offset"), "lower")
    edge = start.select("word", "kind", "offset", (F.lit(derived) & F.col("kind").isin("a", "r")).alias("derive")).distinct()
    seen = edge
    for _ in range(depth + 1):
        onward = edge.join(links, ["kind", "offset"])
        up = onward.filter("symbol in ('@', '@i')").select("word", F.col("to_kind").alias("kind"), F.col("to_offset").alias("offset"), "derive")
        aside = onward.filter("symbol = '+' and derive").select("word", F.col("to_kind").alias("kind"), F.col("to_offset").alias("offset"), F.lit(False).alias("derive"))
        edge = written(up.unionByName(aside).distinct().join(seen, ["word", "kind", "offset", "derive"], "left_anti"))
        if edge.isEmpty():
            break
        seen = seen.unionByName(edge)
    return seen.select("word", "kind", "offset").distinct().join(synsets.select("kind", "offset", "words"), ["kind", "offset"]).select("word", F.explode("words").alias("ancestor")).distinct()


def instances(words: DataFrame, senses: DataFrame, synsets: DataFrame, count: int = 1) -> DataFrame:
    """Rows (word) of words one of whose first senses is an instance, so a proper noun."""
    marked = synsets.filter(F.exists("pointers", lambda p: p["symbol"] == "@i")).select("kind", "offset")
    own = words.select("word", F.lower("word").alias("lower")).join(senses.filter(F.col("place") < count).select(F.col("word").alias("lower"), "kind", "offset"), "lower")
    return own.join(marked, ["kind", "offset"], "left_semi").select("word").distinct()


def glosses(words: DataFrame, senses: DataFrame, synsets: DataFrame, count: int = 1) -> DataFrame:
    """Rows (word, kind, place, gloss): the definitions of a word's first senses."""
    own = words.select("word", F.lower("word").alias("lower")).join(senses.filter(F.col("place") < count).select(F.col("word").alias("lower"), "kind", "place", "offset"), "lower")
    return own.join(synsets.select("kind", "offset", "gloss"), ["kind", "offset"]).select("word", "kind", "place", "gloss")


def classify(words: DataFrame, senses: DataFrame, synsets: DataFrame, count: int = 2, roots: Mapping[str, Sequence[str]] = ROOTS, patterns: Mapping[str, str] = GLOSSES) -> DataFrame:
    """Rows (word, category) of words that fall in one: the first category a root of which is an ancestor, else the first whose pattern a definition has."""
    spark = words.sparkSession
    table = spark.createDataFrame([(k, c, r) for k, (c, rs) in enumerate(roots.items()) for r in rs], "priority int, category string, ancestor string")
    by_root = ancestors(words, senses, synsets, count).join(F.broadcast(table), "ancestor").select("word", "priority", "category")
    texts = glosses(words, senses, synsets, count)
    by_gloss = [texts.filter(F.col("gloss").rlike(p)).select("word", F.lit(len(roots) + k).alias("priority"), F.lit(c).alias("category")) for k, (c, p) in enumerate(patterns.items())]
    rows = by_root
    for g in by_gloss:
        rows = rows.unionByName(g)
    return rows.groupBy("word").agg(F.min_by("category", "priority").alias("category"))
