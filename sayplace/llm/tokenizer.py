"""Exact and quick use of the tokenizers library: whole texts are cut where pre-tokens end for certain, and pieces are remembered."""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: A task has one core, and each thread of the library would keep memory of its own.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces a worker remembers at most, in each of two generations; longer ones go to the library each time.
CACHE_PIECES, CACHE_CHARS = 300_000, 60

#: Python counts these as white space and the library doesn't: such texts go to the library whole.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_BYTE_LEVEL = re.compile(r" ?\S+|\s+(?!\S)|\s")


def byte_level_pieces(text: str, specials: tuple[str, ...] = ()) -> list[str]:
    """Pieces that a byte-level pre-tokenizer cuts apart in any case: white space goes to the following word only as one plain space.

    White space before a special token's string is cut as at the end of a text, so such a text stays whole.
    """
    if not text:
        return []
    if _ODD_SPACE.search(text) or any(s in text for s in specials):
        return [text]
    return _BYTE_LEVEL.findall(text)


#: Texts are looked up together until they have so many characters.
GROUP_CHARS = 4_000_000


def grouped(batches: Iterator[pa.RecordBatch], chars: int = GROUP_CHARS) -> Iterator[tuple[pa.Array, list[str]]]:
    """The batches' first columns and texts (null: empty), several batches together while they are small."""
    keys, texts, size = [], [], 0
    for batch in batches:
        more = [t or "" for t in batch.column(1).to_pylist()]
        keys.append(batch.column(0))
        texts += more
        size += sum(map(len, more))
        if size >= chars:
            yield pa.concat_arrays(keys), texts
            keys, texts, size = [], [], 0
    if texts:
        yield pa.concat_arrays(keys), texts


#: What may follow a word in its piece and is a pre-token of its own.
_AFTER = ".,!?;:"


def counted(ids: list[int], cuts: list[int]) -> list[int]:
    """The value of a piece as the number of its ids."""
    return [b - a for a, b in zip(cuts, cuts[1:])]


class Remembered:
    """Values of pieces, through a first table that is given and two generations of remembered pieces.

    values(ids, cuts) gives the values of runs of ids. Values can be added up: a word with punctuation
    after it is the word's value and the punctuation's.
    """

    def __init__(self, path: str, values, first: dict | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        vocabulary = self.tokenizer.get_vocab()
        #: A word's first token shows by the space it begins with.
        self.marked = np.zeros(max(vocabulary.values()) + 1, bool)
        self.marked[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.values = values
        self.first = first or {}
        self.young: dict = dict(self.first)
        self.old: dict = {}

    def encode(self, pieces: list[str]) -> list:
        return [self.values(e.ids, [0, len(e.ids)])[0] for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> list:
        """Of words of letters alone, with a space before each: one text for many, cut again at the marks."""
        out = []
        for k in range(0, len(words), 2000):
            some = words[k : k + 2000]
            ids = self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids
            at = np.flatnonzero(self.marked[ids]).tolist()
            if len(at) == len(some) and at[0] == 0:
                out += self.values(ids, [*at, len(ids)])
            else:
                out += self.encode(some)
        return out

    def _word(self, piece: str) -> str:
        """The piece without punctuation at its end, if letters are left; else nothing."""
        word = piece.rstrip(_AFTER)
        return word if word[:1] == " " and word[1:].isalpha() else ""

    def lookup(self, cut: list[list[str]], combine=list) -> list:
        """What combine makes of the values of each text's pieces; the different pieces of all texts are learned together."""
        # Nothing here makes cycles, and looking for cycles among so many objects takes a sixth of the time.
        collecting = gc.isenabled()
        gc.disable()
        try:
            if len(self.young) > CACHE_PIECES + len(self.first):
                self.old, self.young = self.young, dict(self.first)
            found = self.learn(set().union(*cut))
            return [combine(map(found.__getitem__, pieces)) for pieces in cut]
        finally:
            if collecting:
                gc.enable()

    def learn(self, pieces: set[str]) -> dict:
        """Values of all these pieces, and of others."""
        young, old = self.young, self.old
        words, rest, joined = [], [], []
        new = pieces.difference(young)
        known = new.intersection(old)
        young.update((p, old[p]) for p in known)
        for p in new - known:
            w = self._word(p)
            if not w:
                rest.append(p)
                continue
            if w != p:
                joined.append((p, w, p[len(w) :]))
                rest.append(p[len(w) :])
            words.append(w)
        words, rest = [w for w in dict.fromkeys(words) if w not in young], [p for p in dict.fromkeys(rest) if p not in young]
        young.update(zip(words, self.encode_words(words)))
        young.update(zip(rest, self.encode(rest)))
        for p, w, after in joined:
            young[p] = young[w] + young[after]
        long = [p for p in (*rest, *words) if len(p) > CACHE_CHARS]
        if not long:
            return young
        out = {p: young[p] for p in pieces}
        for p in long:
            del young[p]
        for p, w, after in joined:
            if len(p) > CACHE_CHARS:
                young.pop(p, None)
        return out
