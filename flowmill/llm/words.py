"""Splitting texts into words at once: the usual byte-level BPE pattern on arrays of code points, any other by regular expression."""

from __future__ import annotations

from functools import cache
from itertools import chain

import numpy as np
import regex

from .common import mix64

# Fixed value: the pattern that array operations stand for.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE, LETTER, NUMBER, OTHER = range(4)


@cache
def kinds() -> np.ndarray:
    """Of each code point: white space, letter, number or other."""
    every = "".join(map(chr, range(0x110000)))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


@cache
def values() -> np.ndarray:
    return mix64(np.arange(1, 0x110001, dtype=np.uint64)) | np.uint64(1)


def word_starts(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the usual pattern's matches begin in texts that stand one after the other; first marks each text's first code point.

    A word is a run of letters, numbers or others with the one space before it; an apostrophe that begins a word takes a
    contraction's letters, and the rest of them are a word; of white space before a word the last is apart, or the word's.
    """
    kind = kinds()[code]
    blank = kind == SPACE
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    begins = run & ~blank
    begins[1:] &= first[1:] | (code[:-1] != 32)
    out = begins | run & blank
    out[:-1] |= blank[:-1] & ~blank[1:] & ~first[1:]
    same = lambda at: (at < len(code)) & ~np.append(first, True)[np.minimum(at, len(code))]
    get = lambda at: np.append(code, 0)[np.minimum(at, len(code))]
    letter = lambda at: same(at) & (np.append(kind, OTHER)[np.minimum(at, len(code))] == LETTER)
    marks = np.flatnonzero(begins & (code == 0x27))
    marks = marks[letter(marks + 1)]
    one = np.isin(get(marks + 1), [ord(c) for c in "stmd"])
    pairs = get(marks + 1).astype(np.int64) << 32 | get(marks + 2)
    two = ~one & letter(marks + 2) & np.isin(pairs, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
    out[marks[one | two] + 1] = False
    rest = np.concatenate([marks[one] + 2, marks[two] + 3])
    out[rest[letter(rest)]] = True
    return np.flatnonzero(out)


def by_expression(texts: list[str], pattern: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    find = regex.compile(pattern).findall
    words = [find(t) for t in texts]
    distinct = dict.fromkeys(chain.from_iterable(words))
    code = dict(zip(distinct, range(len(distinct))))
    return list(distinct), np.fromiter(map(code.__getitem__, chain.from_iterable(words)), np.int64), np.fromiter(map(len, words), np.int64, len(words))


def split_words(texts: list[str], pattern: str = USUAL) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of the texts by first occurrence, the number of each word in order, and how many words each text has."""
    whole = "".join(texts)
    if pattern != USUAL or not whole:
        return by_expression(texts, pattern)
    code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    first = np.zeros(len(code), bool)
    first[at[:-1][at[:-1] < len(code)]] = True
    starts = word_starts(code, first)
    sizes = np.diff(starts, append=len(code))
    place = np.arange(len(code)) - np.repeat(starts, sizes)
    power = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
    _, example, same = np.unique(np.add.reduceat(values()[code] * power[place], starts), return_index=True, return_inverse=True)
    begin, size = starts[example], sizes[example]
    if (size[same] != sizes).any() or (code[np.repeat(begin[same], sizes) + place] != code).any():
        return by_expression(texts, pattern)  # two words have one hash
    order = np.argsort(example)
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    distinct = [whole[b : b + n] for b, n in zip(begin[order].tolist(), size[order].tolist())]
    return distinct, number[same], np.diff(np.searchsorted(starts, at))
