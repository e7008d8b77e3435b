"""How easily one word is heard as another: weighted edit distance over phonemes, and exact similarity joins on it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The vowels, and sets of phonemes of which any two are easily confused. Pairs count, not chains of pairs.
VOWELS = "AA AE AH AO AW AY EH ER EY IH IY OW OY UH UW".split()
CONFUSED = [
    "P B", "T D", "K G", "F V", "S Z", "SH ZH", "TH DH", "CH JH", "M N NG", "F TH", "V DH", "S TH", "Z DH", "L R", "M N", "N NG",
    "S SH", "Z ZH", "CH SH", "JH ZH", "W V", "IY IH", "UW UH", "EH AE", "AA AO", "AH AA", "AH ER", "EY EH", "OW AO", "AY OY", "AW OW",
]
#: The costs of a confusion, of any other change, and of a vowel for a consonant.
NEAR, SWAP, CROSS = 0.5, 1.0, 2.0

_PAIRS = {(a, b) for group in CONFUSED for a in group.split() for b in group.split() if a != b}


def phonemes(pronunciation: Column) -> Column:
    """Without stress digits."""
    return F.transform(F.filter(F.split(pronunciation, r"\s+"), lambda p: p != ""), lambda p: F.regexp_replace(p, "[012]+$", ""))


def syllables(phonemes: Column) -> Column:
    return F.size(F.filter(phonemes, lambda p: p.isin(*VOWELS)))


def substitution(a: str, b: str) -> float:
    if a == b:
        return 0.0
    if (a, b) in _PAIRS:
        return NEAR
    return CROSS if (a in VOWELS) != (b in VOWELS) else SWAP


def bounds(a: list, b: list) -> np.ndarray:
    """What the distance of each pair is at least: each phoneme that one has more often than the other takes an edit."""
    codes: dict[str, int] = {}
    counts = []
    for side in (a, b):
        at = [(k, codes.setdefault(p, len(codes))) for k, word in enumerate(side) for p in word]
        counts.append(np.array(at, np.int64).reshape(-1, 2))
    more = np.zeros((len(a), max(1, len(codes))))
    np.add.at(more, tuple(counts[0].T), 1)
    np.subtract.at(more, tuple(counts[1].T), 1)
    return NEAR * np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))


def distances(a: list, b: list, cutoff: float | None = None) -> np.ndarray:
    """Weighted edit distances of pairs of phoneme sequences: one table for all pairs, filled cell by cell in vectors.

    With a cutoff, pairs whose bound reaches it aren't measured and have infinity.
    """
    if cutoff is not None:
        out = np.full(len(a), np.inf)
        near = np.flatnonzero(bounds(a, b) < cutoff)
        if len(near):
            out[near] = distances([a[k] for k in near], [b[k] for k in near])
        return out
    codes: dict[str, int] = {}
    rows = [[[codes.setdefault(p, len(codes)) for p in word] for word in side] for side in (a, b)]
    names = list(codes) + ["", "\0"]
    cost = np.array([[substitution(x, y) for y in names] for x in names])
    na, nb = (np.array([len(w) for w in side]) for side in rows)
    x, y = np.full((len(a), max(na, default=0)), -2), np.full((len(b), max(nb, default=0)), -1)
    for side, table in zip(rows, (x, y)):
        for k, w in enumerate(side):
            table[k, : len(w)] = w
    out = np.where(na == 0, nb, np.where(nb == 0, na, np.inf)) * SWAP
    before = [np.full(len(a), j * SWAP) for j in range(y.shape[1] + 1)]
    for i in range(1, x.shape[1] + 1):
        now = [np.full(len(a), i * SWAP)]
        for j in range(1, y.shape[1] + 1):
            now.append(np.minimum(before[j - 1] + cost[x[:, i - 1], y[:, j - 1]], np.minimum(before[j], now[j - 1]) + SWAP))
            at = (na == i) & (nb == j)
            out[at] = now[j][at]
        before = now
    return out


def distance(a: Column | str, b: Column | str, cutoff: float | None = None) -> Column:
    """The weighted edit distance of two arrays of phonemes; with a cutoff, infinity where a bound reaches it."""

    def measured(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(distances(x.tolist(), y.tolist(), cutoff))

    return F.pandas_udf(measured, "double")(a, b)


def _groups() -> dict[str, str]:
    """Phonemes joined where a chain of confusions leads from one to the other."""
    root = {p: p for pair in _PAIRS for p in pair}
    for a, b in sorted(_PAIRS):
        low, high = sorted((root[a], root[b]))
        root = {p: low if r == high else r for p, r in root.items()}
    return root


def sound_keys(phonemes: Column, cutoff: float) -> Column:
    """Keys of which two words share one if their distance is below the cutoff.

    With confused phonemes written alike, a distance below the cutoff leaves less than cutoff plain edits;
    two sequences within n edits share a sequence that n deletions or fewer make of each.
    """
    heard = phonemes
    table = F.create_map(*[F.lit(x) for pair in sorted(_groups().items()) for x in pair])
    heard = F.transform(phonemes, lambda p: F.coalesce(F.try_element_at(table, p), p))
    keys = F.array(heard)
    for _ in range(max(0, math.ceil(cutoff) - 1)):
        shorter = F.flatten(F.transform(keys, lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0))), lambda k: F.filter(w, lambda _, at: at != k))))
        keys = F.array_distinct(F.concat(keys, shorter))
    return F.array_distinct(F.transform(keys, lambda w: F.array_join(w, " ")))


def _measured(cutoff: float):
    """Pairs (a, b, pa, pb) closer than the cutoff, with d; sequences as text with spaces. Only the table's cells near its diagonal are filled: any other takes insertions for the cutoff or more."""
    band = math.ceil(cutoff / SWAP) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            said = pc.split_pattern(pa.concat_arrays([batch.column("pa"), batch.column("pb")]), " ")
            row, found = pc.list_parent_indices(said).to_numpy(), said.flatten().dictionary_encode()
            code, names = found.indices.to_numpy(), found.dictionary.to_pylist()
            row, code = (x[code != names.index("")] if "" in names else x for x in (row, code))
            size = np.bincount(row, minlength=2 * n)
            counts = np.bincount(row * len(names) + code, minlength=2 * n * len(names)).reshape(2 * n, len(names))
            more = counts[:n] - counts[n:]
            near = np.flatnonzero(NEAR * np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1)) < cutoff)
            table = np.full((2 * n, max(1, size.max(initial=0))), len(names))
            table[row, np.arange(len(row)) - (np.cumsum(size) - size)[row]] = code
            x, y, na, nb = table[near].T, table[near + n].T, size[near], size[near + n]
            cost = np.array([[substitution(p, q) for q in names + [""]] for p in names + [""]])
            away = np.full(len(near), np.inf)
            d = np.where(na == 0, nb * SWAP, away)
            before = {j: np.full(len(near), j * SWAP) for j in range(min(band, len(y)) + 1)}
            for i in range(1, na.max(initial=0) + 1):
                now = {0: np.full(len(near), i * SWAP)} if i <= band else {}
                for j in range(max(0, i - band), min(i + band, nb.max(initial=0)) + 1):
                    if j:
                        now[j] = np.minimum(before.get(j - 1, away) + cost[x[i - 1], y[j - 1]], np.minimum(before.get(j, away), now.get(j - 1, away)) + SWAP)
                    d = np.where((na == i) & (nb == j), now[j], d)
                before = now
            close = d < cutoff
            at = pa.array(near[close])
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at), pa.array(d[close])], names=["a", "b", "d"])

    return run


def sound_pairs(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """Rows (a, b, d) of words that sound alike, d below the cutoff; both tables have rows (word, phonemes). A word isn't paired with itself.

    An equality join on keys, so no word meets all others of its length; a pair that shares several keys is measured once,
    and of a table with itself in one direction only.
    """
    side = lambda df, x: df.select(F.col("word").alias(x), F.array_join("phonemes", " ").alias(f"p{x}"), F.explode(sound_keys(F.col("phonemes"), cutoff)).alias("key"))
    met = side(left, "a").join(side(right, "b"), "key").filter("a < b" if left is right else "a != b").select("a", "b", "pa", "pb").distinct()
    near = met.mapInArrow(_measured(cutoff), "a string, b string, d double")
    if left is not right:
        return near
    return near.select(F.explode(F.array(F.struct("a", "b", "d"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "d"))).alias("p")).select("p.*")


def audit(entries: DataFrame, threshold: float) -> DataFrame:
    """Rows (d, a, b): every pair of words closer than the threshold, once, a before b in the alphabet."""
    return sound_pairs(entries, entries, threshold).filter("a < b").select("d", "a", "b").distinct()


def closest(entries: DataFrame, n: int = 20, threshold: float = 2.0) -> DataFrame:
    """Rows (d, a, b): the n closest pairs of a list, for a look at it."""
    return audit(entries, threshold).orderBy("d", "a", "b").limit(n)


def isolation(pool: DataFrame, reference: DataFrame, cutoff: float = 2.0) -> DataFrame:
    """Rows (word, isolation): the distance to the nearest other word of the reference, the cutoff at most."""
    near = sound_pairs(pool, reference, cutoff).groupBy("a").agg(F.min("d").alias("d"))
    return pool.select("word").distinct().join(near, F.col("word") == F.col("a"), "left").select("word", F.coalesce("d", F.lit(cutoff)).alias("isolation"))


def report(entries: DataFrame, thresholds: tuple[float, ...] = (0.6, 1.1, 2.0)) -> DataFrame:
    """Rows (threshold, pairs, words, share): how many pairs are closer than each threshold, and how many words are in one."""
    pairs = audit(entries, max(thresholds))
    levels = F.explode(F.array(*(F.lit(t) for t in thresholds))).alias("threshold")
    at = pairs.select(levels, "d", "a", "b").filter("d < threshold")
    counts = at.groupBy("threshold").agg(F.count(F.lit(1)).alias("pairs"))
    words = at.select("threshold", F.explode(F.array("a", "b")).alias("w")).groupBy("threshold").agg(F.countDistinct("w").alias("words"))
    total = entries.agg(F.count(F.lit(1)).alias("total"))
    rows = entries.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double").join(counts, "threshold", "left").join(words, "threshold", "left").crossJoin(F.broadcast(total))
    return rows.select("threshold", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("words", F.lit(0)).alias("words"), (F.coalesce("words", F.lit(0)) / F.nullif("total", F.lit(0))).alias("share"))
