"""Token ids of whole texts with a public tokenizer, encoding each distinct word once per worker process.

Both vocabularies used here split a text before every run of white space that follows other
characters, so a text's ids are the ids of its words in order. A process keeps the ids of the
words it has met, in a table of bounded size, and asks the tokenizers library for new ones only.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space as the tokenizers see it; Python also counts 1C to 1F, which stay inside words here.
WORDS_WITH_SPACE = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
WORDS_ALONE = re.compile(r"[\S\x1c-\x1f]+")
FIRST = "\x00"
BLANK = pa.scalar(" ", pa.large_string())
# Anything but single blanks and single line ends between words, and what marks a first word.
PAIRS = ("  ", " \n", "\n ", "\n\n")
OTHER_SPACE = [FIRST, *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]
ASCII_SPACE = [c for c in OTHER_SPACE if c.isascii()]
LONG = 256


def unusual(text: str) -> bool:
    return (text[0] in " \n" or text[-1] in " \n" or any(p in text for p in PAIRS)
            or any(c in text for c in (ASCII_SPACE if text.isascii() else OTHER_SPACE)))


def split_with_space(text: str) -> list[str]:
    """Words with the white space before them. A blank before a word is left out, and the first
    word of a text has ``FIRST`` before it; ``spelled`` gives the words as they stand."""
    if not text:
        return []
    words = WORDS_WITH_SPACE.findall(text)
    if not words[0][0].isspace() or words[0][0] in "\x1c\x1d\x1e\x1f":
        words[0] = FIRST + words[0]
    return words


def spelled(word: str) -> str:
    if word[0] == FIRST:
        return word[1:]
    return word if word[0].isspace() and word[0] not in "\x1c\x1d\x1e\x1f" else " " + word


def split_alone(text: str) -> list[str]:
    """Words without the white space around them."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return WORDS_ALONE.findall(text)
    return text.split()


class Places(dict):
    """Numbers words as they are met; ``new`` lists those not numbered before."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


class WordTable:
    """``keep_space``: white space before a word is part of it, as in byte-level vocabularies.

    The first ``most`` words met are kept, which are those that come often; others are encoded
    each time a call has them.
    """

    def __init__(self, path: str, keep_space: bool, most: int = 700_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        self.encoder = Tokenizer.from_file(path)
        self.keep_space = keep_space
        self.find = split_with_space if keep_space else split_alone
        self.most = most
        self.place = Places()
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)

    def _learn(self) -> None:
        new = list(map(spelled, self.place.new)) if self.keep_space else self.place.new
        flats, counts = [], []
        for k in range(0, len(new), 1000):  # words go in together, each is still encoded alone
            part = new[k:k + 1000]
            found = self.encoder.encode(part, is_pretokenized=True, add_special_tokens=False)
            flats.append(np.array(found.ids, np.uint32))
            counts.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(part)))
        flat, counts = np.concatenate(flats), np.concatenate(counts)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.ids = np.concatenate([self.ids, flat])
        self.counts = np.concatenate([self.counts, counts])

    def _forget(self) -> None:
        """Drop the last words met: those beyond the bound, and from a very long one on."""
        new = self.place.new
        first = next((k for k, w in enumerate(new) if len(w) > LONG), len(new))
        first = min(first, max(0, self.most - len(self.place) + len(new)))
        if first < len(new):
            for w in new[first:]:
                del self.place[w]
            n = len(self.place)
            self.starts, self.counts = self.starts[:n], self.counts[:n]
            self.ids = self.ids[:int(self.starts[-1] + self.counts[-1]) if n else 0]
        self.place.new = []

    def _number(self, words, n: int) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, words), np.int64, n)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of texts with single blanks and line ends only, and their counts.
        Arrow splits them and finds the different words, so that each is looked up once."""
        spaced = ([FIRST + t.replace("\n", " \n") for t in texts] if self.keep_space
                  else [t.replace("\n", " ") for t in texts])
        words = pc.split_pattern(pa.array(spaced, pa.large_string()), " ")
        coded = words.flatten().dictionary_encode()
        n = len(coded.dictionary)
        different = pc.binary_join(pa.ListArray.from_arrays([0, n], coded.dictionary), BLANK)[0].as_py()
        return (self._number(different.split(" "), n)[coded.indices.to_numpy()],
                pc.list_value_length(words).to_numpy())

    def _places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words in order, and the number of words of each text."""
        plain = np.array([bool(t) and not unusual(t) for t in texts], bool)
        others = [self.find(t) for t, p in zip(texts, plain) if not p]
        sizes = np.zeros(len(texts), np.int64)
        sizes[~plain] = list(map(len, others))
        if plain.any():
            found, sizes[plain] = self._plain([t for t, p in zip(texts, plain) if p])
            if not others:
                return found, sizes
        at, of_plain = np.empty(sizes.sum(), np.int64), np.repeat(plain, sizes)
        if plain.any():
            at[of_plain] = found
        at[~of_plain] = self._number(chain.from_iterable(others), int(sizes[~plain].sum()))
        return at, sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text."""
        at, sizes = self._places(texts)
        if self.place.new:
            self._learn()
        counts = self.counts[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(self.starts[at] - (ends - counts), counts)
        source += np.arange(total)
        ids = self.ids[source]
        if self.place.new:
            self._forget()
        return ids, np.diff(np.concatenate([[0], ends])[np.cumsum([0, *sizes])])


_TABLES: dict[tuple, WordTable] = {}


def word_table(path: str, keep_space: bool, most: int = 700_000) -> WordTable:
    """The table of this process; Spark reuses a worker for many tasks."""
    if (path, keep_space) not in _TABLES:
        _TABLES.clear()  # one vocabulary at a time bounds the memory
        _TABLES[path, keep_space] = WordTable(path, keep_space, most)
    return _TABLES[path, keep_space]


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end`` after each text's, and the new counts."""
    out = np.full(len(ids) + len(counts), end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, counts + 1


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
