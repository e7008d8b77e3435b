import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tokenizers import Tokenizer

from sayplace.llm import tokenizer, word_ids
from sayplace.llm.packing import pack, pattern, plan
from sayplace.llm.token_count import token_counts
from sayplace.llm.tokenizer import Remembered, byte_level_pieces, counted

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BITS = ["a", "B", "é", "É", " ", "  ", "\n", "\t", "'s", "'", "1", "23", "!", "<|endoftext|>", "<|startoftext|>", "Σ", "İ", "中", "e\u0301", "\u0301", "\x1c", "\x85", "\u200b", "ß", " \n", "_", "—", "🙂", "\0", ".", ",", "\u0958", "²", " the", " of,", "ı", "Ŀ", "ŉ", "ǅ", "ª", "µ", "x;", "...", "<|ENDOFTEXT|>"]


def nasty(rng):
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(15))) for _ in range(20)] + ["x" * 100 + " y", ""]


def test_pieces_are_exact(monkeypatch):
    """Texts put together from pieces have the library's ids, also while the caches turn over."""
    monkeypatch.setattr(tokenizer, "CACHE_PIECES", 500)
    library, rng = Tokenizer.from_file(BYTES), random.Random(3)
    own = Remembered(BYTES, lambda ids, cuts: [tuple(ids[a:b]) for a, b in zip(cuts, cuts[1:])])
    for _ in range(300):
        texts = nasty(rng)
        for t, values in zip(texts, own.lookup([byte_level_pieces(t, own.specials) for t in texts])):
            assert [i for v in values for i in v] == library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("words", [500, 400_000])
def test_word_ids_are_exact(monkeypatch, words):
    monkeypatch.setattr(word_ids, "CACHE_WORDS", words)
    monkeypatch.setattr(word_ids, "JOINED", 7)
    library, own, rng = Tokenizer.from_file(WORDS), word_ids.WordIds(WORDS), random.Random(3)
    for _ in range(300):
        texts = nasty(rng)
        ids, bounds = own.lookup(texts)
        assert len(bounds) == len(texts) + 1
        for t, a, b in zip(texts, bounds, bounds[1:]):
            assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert len(own.numbers) <= words + 500 and all(len(w) <= 60 for w in own.numbers)
    ids, bounds = own.lookup([])
    assert len(ids) == 0 and bounds.tolist() == [0]


def test_white_space_is_one_thing():
    """What cuts texts into pieces here agrees with the language's own, for every character."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    cut = pc.list_value_length(pc.utf8_split_whitespace(pa.array([f"a{c}b" for c in points]))).to_pylist()
    assert cut == [len(f"a{c}b".split()) for c in points]


def test_counts(odd_documents):
    library = Tokenizer.from_file(BYTES)
    got = token_counts(odd_documents, "doc_id", "text", BYTES).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_documents.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_frequent_table(spark):
    docs = spark.createDataFrame([(k, "often often rare%d" % k) for k in range(50)], "doc_id long, text string")
    library = Tokenizer.from_file(BYTES)
    for r in token_counts(docs, "doc_id", "text", BYTES).collect():
        assert r.n_tokens == len(library.encode("often often rare%d" % r.id).ids)
    assert counted([1, 2, 3], [0, 1, 3]) == [1, 2]


def test_no_rows(no_documents):
    assert token_counts(no_documents, "doc_id", "text", BYTES).count() == 0
    assert pack(no_documents, "doc_id", "text", WORDS).count() == 0


def held(rows, docs, capacity):
    library = Tokenizer.from_file(WORDS)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.id].append(r)
        by_sequence[r.sequence_id].append(r)
    for key, texts in docs.items():
        left = sorted(by_doc[key], key=lambda r: r.start)
        want = []
        for t in texts:
            ids = library.encode(t or "", add_special_tokens=False).ids + [1]
            for s in range(0, len(ids), capacity):
                part = ids[s : s + capacity]
                want.append((s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(ids)))
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in left) == sorted(want)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += capacity - at
    return padding


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(odd_documents, capacity):
    docs = defaultdict(list)
    for r in odd_documents.collect():
        docs[r.doc_id].append(r.text)
    held(pack(odd_documents, "doc_id", "text", WORDS, capacity=capacity).collect(), docs, capacity)


def test_little_padding(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: [r.text] for r in docs.collect()}
    rows = pack(docs, "doc_id", "text", WORDS).collect()
    assert held(rows, texts, 2048) < 0.02 * sum(r.length for r in rows)


def best_sum(counts, capacity):
    anchor = max(counts)
    sums = {anchor}
    for n, c in counts.items():
        for _ in range(c - (n == anchor)):
            sums |= {s + n for s in sums if s + n <= capacity}
    return max(sums)


def test_pattern_is_closest():
    rng = random.Random(4)
    for _ in range(300):
        capacity = rng.choice([10, 37, 100])
        counts = {rng.randrange(1, capacity + 1): rng.randrange(1, 5) for _ in range(rng.randrange(1, 7))}
        chosen = pattern(counts, capacity)
        assert all(chosen[n] <= counts[n] for n in chosen)
        assert sum(n * c for n, c in chosen.items()) == best_sum(counts, capacity)


def test_plan_places_each_once():
    counts = {3: 1000, 5: 999, 7: 1, 16: 50}
    rows = plan(counts, 16)
    sums = defaultdict(int)
    for n, c in counts.items():
        mine = sorted(r for r in rows if r[0] == n)
        for (_, first, copies, sequence, _), after in zip(mine, [*mine[1:], (n, c)]):
            for k in range(after[1] - first):
                sums[sequence + k // copies] += n
    assert sum(sums.values()) == sum(n * c for n, c in counts.items()) and max(sums.values()) <= 16
    assert plan({}, 16) == []
