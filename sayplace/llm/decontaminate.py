"""Benchmark decontamination: one Aho-Corasick automaton over the items' windows, one scan of each text."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from sayplace.llm.common import Workspace, bound_batches, held, released

WINDOW = 10
#: Windows are broadcast, so many bytes of them at a time; an automaton takes about forty times that in each worker.
#: A larger test suite is scanned for in parts, one after another.
MAX_WINDOW_BYTES = 8 << 20

#: Bytes to bytes: A-Z to a-z; 0-9, a-z and what UTF-8 has beyond ASCII stay; the rest separates words.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def _spaced(some: list[bytes]) -> str:
    return f" {b' '.join(some).decode('utf-8', 'surrogatepass')} "


def windows(text: str | None, size: int = WINDOW) -> set[str]:
    """Each run of so many words, with a space before, between and after; a shorter text that has words is one window."""
    w = words(text)
    return {_spaced(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def automaton(patterns: dict[str, tuple[int, tuple[int, ...]]]):
    a = ahocorasick.Automaton()
    for window, value in patterns.items():
        a.add_word(window, value)
    if patterns:
        a.make_automaton()
    return a


def _offsets(text: str) -> list[tuple[int, int]]:
    """Where each word lies in the original text, in code points."""
    out, begin = [], -1
    for k, c in enumerate(text):
        o = ord(c)
        part = o >= 128 or 48 <= o <= 57 or 65 <= o <= 90 or 97 <= o <= 122
        if part and begin < 0:
            begin = k
        elif not part and begin >= 0:
            out.append((begin, k))
            begin = -1
    return out + [(begin, len(text))] if begin >= 0 else out


def union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for run in sorted(runs):
        if merged and run[0] <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(run[1], merged[-1][1]))
        else:
            merged.append(run)
    return merged


def hits(text: str | None, trie) -> tuple[int, list[tuple[int, int]], set[int]]:
    """The count of words, the runs [first, last) of words inside any window that occurs, and the items hit."""
    w = words(text)
    runs: list[tuple[int, int]] = []
    items: set[int] = set()
    if not w or not len(trie):
        return len(w), runs, items
    norm = _spaced(w)
    at = word = 0
    for end, (size, owners) in trie.iter(norm):
        # The match ends with the space after its last word: the spaces up to it, less the first, count the words.
        word += norm.count(" ", at, end + 1)
        at = end + 1
        last, first = word - 1, word - 1 - size
        items.update(owners)
        if runs and first <= runs[-1][1]:
            runs[-1] = (min(first, runs[-1][0]), last)
        else:
            runs.append((first, last))
    return len(w), union(runs), items


_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_FOUND = "n_words long, runs array<struct<first: long, last: long>>, items array<string>"


def _find(patterns, token: str, before: bool, after: list[str], spans: bool):
    """Of each text the words, the runs hit and the items, with those that parts before this one found; columns named in after go along, and the runs as spans of the text if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, names = held(token, lambda: automaton(patterns.value[0])), patterns.value[1]
        for batch in batches:
            n_words, runs, items = [], [], []
            for text in batch.column("text").to_pylist():
                n, r, i = hits(text, trie)
                n_words.append(n)
                runs.append(r)
                items.append(sorted(names[k] for k in i))
            if before:
                for k, (r, i) in enumerate(zip(batch.column("runs").to_pylist(), batch.column("items").to_pylist())):
                    runs[k] = union([*runs[k], *((x["first"], x["last"]) for x in r)])
                    items[k] = sorted({*items[k], *i})
            found = [pa.array(n_words, pa.int64()), pa.array([[{"first": a, "last": b} for a, b in r] for r in runs], _RUNS), pa.array(items, pa.list_(pa.string()))]
            more = ["n_words", "runs", "items"]
            if spans:
                lie = []
                for text, r in zip(batch.column("text").to_pylist(), runs):
                    at = _offsets(text) if r else []
                    lie.append([{"begin": at[a][0], "end": at[b - 1][1]} for a, b in r])
                found.append(pa.array(lie, _SPANS))
                more.append("spans")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in after), *found], names=[*after, *more])

    return run


def _patterns(items: list[Row], size: int) -> tuple[dict[str, tuple[int, tuple[int, ...]]], list[str]]:
    owners: dict[str, set[int]] = {}
    names = sorted({"" if r[0] is None else str(r[0]) for r in items})
    index = {name: k for k, name in enumerate(names)}
    for r in items:
        for window in windows(r[1], size):
            owners.setdefault(window, set()).add(index["" if r[0] is None else str(r[0])])
    return {w: (w.count(" ") - 1, tuple(sorted(o))) for w, o in owners.items()}, names


def _parts(benchmark: DataFrame, item: str, item_text: str, size: int, most: int) -> list[list[Row]]:
    """The items in parts whose windows have so many bytes at most, but for a part of one item; the driver holds one part at a time but for their numbers.

    A window has some size times its share of the text: that is what is added up here, on the executors.
    """
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text"), (F.octet_length(F.coalesce(F.col(item_text), F.lit(""))) * size + 1).alias("bytes"))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    if total <= most:
        return [rows.select("item", "text").collect()]
    count = -(-total // most) * 2
    part: Column = F.pmod(F.xxhash64("text"), F.lit(count))
    return [some for k in range(count) if (some := rows.filter(part == k).select("item", "text").collect())]


def _found(docs: DataFrame, benchmark: DataFrame, item: str, item_text: str, size: int, max_bytes: int, columns: list[str], spans: bool = False) -> DataFrame:
    """The named columns of docs, which has a column text, and what is found in it, one row for every row.

    One part: one scan without a shuffle. More parts: a scan each, with a table in the shared folder between.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    parts = _parts(benchmark, item, item_text, size, max_bytes)
    ws = Workspace(spark, "decontaminate") if len(parts) > 1 else None
    out = docs
    for k, some in enumerate(parts):
        last = k == len(parts) - 1
        keep = columns if last else list(dict.fromkeys([*columns, "text"]))
        kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
        patterns = spark.sparkContext.broadcast(_patterns(some, size))
        kinds += f", {_FOUND}" + (", spans array<struct<begin: long, end: long>>" if last and spans else "")
        after = out.mapInArrow(released(_find(patterns, uuid.uuid4().hex, k > 0, keep, last and spans)), kinds)
        before, out = out, after if last else ws.write(after)
        if 0 < k and not last:
            ws.drop(before)
    return out


def scan(docs: DataFrame, key: str, text: str, benchmark: DataFrame, item: str, item_text: str, size: int = WINDOW, max_bytes: int = MAX_WINDOW_BYTES) -> DataFrame:
    """Rows (id, n_words, n_hit, n_items, items_sha256, spans), one for every row of docs.

    Texts and items are lower-cased (A-Z) and cut into words of 0-9, a-z and characters beyond ASCII. A
    word inside any occurrence of a window of an item is hit; spans are the runs of hit words, as code
    point offsets in the original text. Null and empty texts have no words; an item without words has no
    window; a null item id counts as the item ''. Rows that share an item id are one item. Repeated rows
    give repeated rows; other columns are left out. The scan has no shuffle: the windows are broadcast,
    max_bytes of them at most, and where there are more, one part after another is scanned for.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    found = _found(rows, benchmark, item, item_text, size, max_bytes, ["id"], spans=True)
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    return found.select(
        "id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "spans")


def clean(docs: DataFrame, text: str, benchmark: DataFrame, item: str, item_text: str, size: int = WINDOW, max_bytes: int = MAX_WINDOW_BYTES) -> DataFrame:
    """The rows of docs in whose text no window of an item occurs, each row judged by itself, with its own columns; see scan."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = docs.columns.index(text)
    rows = docs.toDF(*("text" if k == at else n for k, n in enumerate(names)))
    found = _found(rows, benchmark, item, item_text, size, max_bytes, rows.columns)
    return found.filter(F.size("runs") == 0).select(*rows.columns).toDF(*docs.columns)
