"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sayplace.llm.common import Workspace, bound_batches, held, released

ORDERS = (4, 5, 6)
#: n-grams are hashed to so many places. Features, for either class, are those that tell the classes apart best; more
#: of them fit the labelled rows better and held-out rows no better (README).
PLACES, FEATURES = 1 << 22, 8192
#: Labelled rows the model is fitted on at most, the first ones by a hash of their id; n-grams that fewer rows have are no features.
MAX_ROWS, LEAST_ROWS = 20_000, 3
#: What squared weights cost.
PENALTY = 3e-4
#: So many entries of the sample's rows are looked at together.
CHUNK = 1 << 21


def _codes(text: str | None) -> np.ndarray:
    """Lower-cased code points between two spaces, every control character and white space as a space."""
    a = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    a[a <= 32] = 32
    return a


def ngram_places(text: str | None) -> np.ndarray:
    """The place of each character n-gram of the whole text, with repeats."""
    a = _codes(text)
    out, h = [], np.zeros(len(a), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        if len(a) < order:
            break
        h = h[: len(a) - order + 1] * np.uint32(0x01000193) ^ (a[order - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
        if order in ORDERS:
            g = (h ^ np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)
            out.append(g >> np.uint32(32 - PLACES.bit_length() + 1))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


@dataclass
class Model:
    """weights: of the features' places, already times their log-count ratios; a score is the logistic function of their sum and the bias."""

    places: np.ndarray
    weights: np.ndarray
    bias: float
    ratios: np.ndarray | None = None

    def table(self) -> np.ndarray:
        t = np.zeros(PLACES, np.uint16)
        t[self.places] = np.arange(1, len(self.places) + 1)
        return t

    def score(self, text: str | None, table: np.ndarray) -> float:
        present = np.unique(table[ngram_places(text)])
        present = present[present > 0].astype(np.int64) - 1
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[present].sum(), -30, 30))))


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each n-gram's place, the rows of either class that have it."""
    counts = np.zeros((2, PLACES), np.int32)
    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[y][np.unique(ngram_places(text))] += 1
    at = np.flatnonzero(counts[0] + counts[1])
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(counts[y][at], pa.int64()) for y in (0, 1))], names=["place", "neg", "pos"])


def _vectors(places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(PLACES, np.uint16)
        table[places.value] = np.arange(1, len(places.value) + 1)
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                f = np.unique(table[ngram_places(text)])
                found.append((f[f > 0] - 1).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.binary())], names=["y", "features"])

    return run


def _minimum(value, start: np.ndarray, steps: int = 100, memory: int = 8) -> np.ndarray:
    """Where a smooth function, given with its gradient, is least: limited-memory BFGS with halved steps; deterministic."""
    at, moves, turns = start, [], []
    now, slope = value(at)
    for _ in range(steps):
        way, used = slope.copy(), []
        for move, turn in zip(moves[::-1], turns[::-1]):
            a = move @ way / (move @ turn)
            way -= a * turn
            used.append(a)
        way *= moves[-1] @ turns[-1] / (turns[-1] @ turns[-1]) if moves else 1 / max(1.0, np.abs(slope).sum())
        for move, turn, a in zip(moves, turns, used[::-1]):
            way += move * (a - turn @ way / (move @ turn))
        size = 1.0
        while True:
            there = at - size * way
            after, turned = value(there)
            if after <= now - 1e-4 * size * (slope @ way) or size < 1e-10:
                break
            size /= 2
        move, turn = there - at, turned - slope
        if move @ turn > 1e-14:
            moves, turns = [*moves, move][-memory:], [*turns, turn][-memory:]
        settled = now - after < 1e-9 * max(1.0, abs(now))
        at, now, slope = there, after, turned
        if settled:
            break
    return at


def regression(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on presence times ratio: the mean loss and penalty / 2 times the squared weights are least.

    Rows are their features' numbers, two bytes each; what is worked out of them is as large as a chunk.
    """
    n = len(rows)
    bounds, chunks, first, size = np.cumsum([0, *map(len, rows)]), [], 0, 0
    for k in range(n):
        size += len(rows[k])
        if size > CHUNK or k == n - 1:
            chunks.append((first, k + 1, np.concatenate(rows[first : k + 1])))
            first, size = k + 1, 0

    def value(theta: np.ndarray) -> tuple[float, np.ndarray]:
        weights = theta[:-1] * ratios
        loss, slope, bias = 0.0, np.zeros(len(ratios)), 0.0
        for a, b, own in chunks:
            lengths = np.diff(bounds[a : b + 1])
            sums = np.concatenate(([0.0], np.cumsum(weights[own])))
            z = sums[bounds[a + 1 : b + 1] - bounds[a]] - sums[bounds[a:b] - bounds[a]] + theta[-1]
            loss += np.logaddexp(0, np.where(y[a:b] > 0, -z, z)).sum()
            g = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[a:b]
            slope += np.bincount(own, np.repeat(g, lengths), len(ratios))
            bias += g.sum()
        return loss / n + penalty / 2 * (theta[:-1] @ theta[:-1]), np.append(slope * ratios / n + penalty * theta[:-1], bias / n)

    start = np.zeros(len(ratios) + 1)
    start[-1] = np.log(y.mean() / (1 - y.mean()))
    theta = _minimum(value, start)
    return theta[:-1], float(theta[-1])


def fit(labelled: DataFrame, key: str, text: str, label: str, max_rows: int = MAX_ROWS, features: int = FEATURES) -> Model:
    """labelled: rows with an id, a text and a label 0 or 1; others count for nothing.

    The model is fitted on max_rows rows at most, the first by a hash of the id, with their whole texts.
    Counts of n-grams by class are summed on the executors; only the chosen features and the sample's
    sparse rows come to the driver, both bounded by the parameters. Features speak for label 1 or for
    label 0. Without rows of both classes the score is the share of the label, and 0 without rows.
    """
    spark = labelled.sparkSession
    bound_batches(spark)
    if features >= 1 << 16:
        raise ValueError("features are numbered in two bytes")
    ws = Workspace(spark, "toxicity")
    rows = labelled.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(label).cast("int").alias("y")).filter("y in (0, 1)")
    ids = rows.select("id", F.xxhash64("id").alias("h")).distinct().orderBy("h", "id").limit(max_rows).select("id")
    # Read three times below.
    sample = ws.write(rows.join(F.broadcast(ids), "id", "left_semi").select("text", "y"))
    total = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    nn, np_ = total.get(0, 0), total.get(1, 0)
    if not nn or not np_:
        share = min(max(np_ / max(1, nn + np_), 1e-6), 1 - 1e-6)
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share))))
    counts = sample.mapInArrow(released(_class_counts), "place long, neg long, pos long").groupBy("place").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    ratio = F.log((F.col("pos") + 1) / (np_ + 2)) - F.log((F.col("neg") + 1) / (nn + 2))
    # How far an n-gram speaks for either class: its ratio by how far the classes' rates lie apart, of one sign but for rounding.
    worth = F.abs(ratio * (F.col("pos") / np_ - F.col("neg") / nn))
    best = counts.filter(f"pos + neg >= {LEAST_ROWS}").select("place", ratio.alias("r"), worth.alias("worth")).orderBy(F.desc("worth"), "place").limit(features).toPandas()
    best = best.sort_values("place")
    places, ratios = best["place"].to_numpy(np.int64), best["r"].to_numpy(float)
    vectors = sample.mapInArrow(released(_vectors(spark.sparkContext.broadcast(places))), "y int, features binary").toArrow()
    ws.drop(sample)
    # In an order of their own, so that sums don't depend on how the table was read.
    found = sorted(zip(vectors.column("y").to_pylist(), vectors.column("features").to_pylist()))
    del vectors
    w, b = regression([np.frombuffer(v, "<u2") for _, v in found], np.array([y for y, _ in found], float), ratios)
    return Model(places, w * ratios, b, ratios)


def _scores(model, token: str, text: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, table = model.value, held(token, model.value.table)
        for batch in batches:
            found = pa.array([m.score(t, table) for t in batch.column(text).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), found], names=[*columns, "score"])

    return run


def _scored(rows: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """The named columns of rows, which has a column text, and a column score."""
    spark = rows.sparkSession
    bound_batches(spark)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(released(_scores(spark.sparkContext.broadcast(model), uuid.uuid4().hex, "text", columns)), f"{kinds}, score double")


def scores(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """Rows (id, score), one for every row of df: 0 to 1, higher where label 1 is likelier, from the whole text alone.

    Null and empty texts get the score of a text without features. Repeated rows give repeated rows;
    other columns are left out. The scan has no shuffle; the broadcast model has a fixed size.
    """
    return _scored(df.select(F.col(key).alias("id"), F.col(text).alias("text")), model, ["id"])


def below(df: DataFrame, text: str, model: Model, least: float) -> DataFrame:
    """The rows of df whose score is below least, each judged by itself, with their own columns; see scores."""
    names = [f"c{k}" for k in range(len(df.columns))]
    names[df.columns.index(text)] = "text"
    return _scored(df.toDF(*names), model, names).filter(F.col("score") < least).select(*names).toDF(*df.columns)
