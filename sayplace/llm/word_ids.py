"""Ids of whole texts by a tokenizer that drops white space: different words are looked up or learned once, the rest is arrays."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

#: A task has one core, and each thread of the library would keep memory of its own.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A worker forgets all its words when they are so many, or their ids; longer words are never remembered.
CACHE_WORDS, CACHE_IDS, CACHE_CHARS = 400_000, 1 << 23, 60
#: Words are written into one text so many at a time.
JOINED = 2000

#: Python and Arrow count these as white space and the library doesn't: such texts go to the library whole.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Beyond these, normal form or lower case may depend on more than one character; and the dotted capital I becomes two.
_CHANGING = re.compile("[^\x00-ɏ]|İ")
#: What may follow a word in its piece and is a pre-token of its own.
_AFTER = ".,!?;:"
#: Letters that normal form and lower case leave as letters, one for one, wherever they stand.
_PLAIN = "^[A-Za-zÀ-ÖØ-öø-įı-ɏ]+$"


def lowered(text: str) -> str:
    """In lower case already where it changes characters one by one, so that fewer words differ.

    Strings of special tokens are in lower case themselves, so one in capitals must not become one.
    """
    return text.lower() if "<|" not in text and (text.isascii() or not _CHANGING.search(text)) else text


class WordIds:
    """Remembers the ids of words: their numbers in a dictionary, and for each number a piece of one array of ids."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # For plain words, what cuts and changes texts has nothing to do: the same model without it.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        #: A word's last token shows by its ending.
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.ids = np.empty(0, np.uint32)
        #: Word k has the ids from bounds[k] to bounds[k + 1].
        self.bounds = np.zeros(1, np.int64)

    def _learn(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """ends: of each word's ids among these."""
        known = len(self.bounds) - 1
        self.bounds = np.concatenate((self.bounds, ends + len(self.ids)))
        self.ids = np.concatenate((self.ids, ids.astype(np.uint32)))
        self.numbers.update(zip(words, range(known, known + len(words))))

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids, and where each word's end."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.int64), np.cumsum([len(ids) for ids in found], dtype=np.int64)

    def _encode_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of plain words: one text for many, cut again at their last tokens."""
        all_ids, all_ends, before = [], [], 0
        for k in range(0, len(words), JOINED):
            some = words[k : k + JOINED]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some).lower()], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                ids, ends = self._encode(some)
            all_ids.append(ids)
            all_ends.append(ends + before)
            before += len(ids)
        return np.concatenate(all_ids), np.concatenate(all_ends)

    def _numbers(self, words: pa.Array, plain: np.ndarray) -> np.ndarray:
        """The numbers of different words; those not known are learned."""
        said = words.to_pylist()
        get = self.numbers.get
        numbers = np.fromiter([get(w, -1) for w in said], np.int64, len(said))
        new = numbers < 0
        for kind, encode in ((plain, self._encode_plain), (~plain, self._encode)):
            at = np.flatnonzero(new & kind)
            if len(at):
                some = [said[k] for k in at]
                first = len(self.bounds) - 1
                self._learn(some, *encode(some))
                numbers[at] = np.arange(first, first + len(some))
                for w in some:
                    if len(w) > CACHE_CHARS:
                        del self.numbers[w]
        return numbers

    def lookup(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and bounds: text k has those from bounds[k] to bounds[k + 1]."""
        if len(self.numbers) > CACHE_WORDS or len(self.ids) > CACHE_IDS:
            self.forget()
        odd = [k for k, t in enumerate(texts) if _ODD_SPACE.search(t)]
        if odd:
            texts = list(texts)
            whole = [texts[k] for k in odd]
            for k in odd:
                texts[k] = ""
        pieces = pc.utf8_split_whitespace(pa.array([lowered(t) for t in texts], pa.large_string()))
        different = pieces.flatten().dictionary_encode()
        # Of the different pieces: what is plain before punctuation at the end, and that, are two words; else the piece is one.
        piece = different.dictionary
        word = pc.utf8_rtrim(piece, _AFTER)
        plain = pc.match_substring_regex(word, _PLAIN)
        length, cut = pc.binary_length(piece).to_numpy(zero_copy_only=False), pc.binary_length(word).to_numpy(zero_copy_only=False)
        after = _ends(piece, np.where(plain.to_numpy(zero_copy_only=False), cut, length))
        words = pa.chunked_array([pc.if_else(plain, word, piece), after]).combine_chunks().dictionary_encode()
        one = words.dictionary
        number = self._numbers(one, pc.match_substring_regex(one, _PLAIN).to_numpy(zero_copy_only=False))
        both = number[words.indices.to_numpy()]
        n = len(piece)
        # Each piece's two words in turn, then each text's pieces.
        ids, bounds = _gather(self.ids, self.bounds, np.stack((both[:n], both[n:]), 1).ravel())
        ids, bounds = _gather(ids, bounds[::2], different.indices.to_numpy())
        bounds = bounds[pieces.offsets.to_numpy()]
        if odd:
            found = iter([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)])
            at = set(odd)
            parts = [next(found) if k in at else ids[a:b] for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]
            ids, bounds = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return ids, bounds


def _ends(strings: pa.Array, begin: np.ndarray) -> pa.Array:
    """Of each string the bytes from begin on."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    cut, bounds = _gather_ranges(raw, offsets[:-1] + begin, offsets[1:])
    return pa.Array.from_buffers(pa.large_string(), len(strings), [None, pa.py_buffer(bounds), pa.py_buffer(cut)])


def _gather_ranges(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[begin:end] for each pair, one after another, and the bounds between them."""
    lengths = end - begin
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    at = np.repeat(begin - bounds[:-1], lengths)
    at += np.arange(len(at))
    return values[at], bounds


def _gather(values: np.ndarray, bounds: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of these numbers, one after another, and the bounds between them."""
    return _gather_ranges(values, bounds[numbers], bounds[numbers + 1])
