"""Vectorised text kernels used inside tasks: everything works on one Arrow batch or one list of words."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD = re.compile(r"\w+")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (shift and multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 bounds of its values; a null is an empty value."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the number of words before each value.

    Words are runs without space or the control characters 9 to 13, with A-Z lower-cased; a word never crosses
    the end of a value. The hash of a word is a polynomial over its bytes, taken from one running sum.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    low = raw.copy()
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = bounds[1:-1]
    cut = cut[cut < n]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = cut[cut > 0] - 1
    last[before] = inside[before]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    run = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=run[1:])
    hashes = mix64((run[end] - run[start]) * powers(_INV, n + 1)[start])
    return hashes, np.searchsorted(start, bounds)


def shingles(column: pa.Array, width: int, block: int = 1 << 18) -> Iterable[np.ndarray]:
    """For each value the sorted distinct 64-bit hashes of its ``width``-word shingles.

    A value with fewer words has its whole word sequence as its one shingle; without words the set is empty.
    Values are hashed in blocks of about ``block`` bytes, so memory follows the block and the longest value.
    """
    raw, bounds = utf8(column)
    i, n = 0, len(column)
    weight = powers(np.uint64(0xD6E8FEB86659FD93), width)
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + block, side="right")) - 1)
        words, at = word_hashes(raw[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i])
        m = len(words) - width + 1
        grams = np.zeros(max(m, 0), np.uint64)
        for k in range(width):
            grams += words[k:k + max(m, 0)] * weight[k]
        grams = mix64(grams)
        for k in range(j - i):
            a, b = int(at[k]), int(at[k + 1])
            if b - a >= width:
                yield np.unique(grams[a:b - width + 1])
            elif b > a:
                yield mix64(np.array([(words[a:b] * weight[:b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
        i = j


def words_of(text: str | None) -> list[str]:
    """Lower-cased words (letters, digits, underscore) of a text; none for a null."""
    return _WORD.findall(text.lower()) if text else []


def subword_ids(words: Sequence[str], buckets: int, shortest: int = 3, longest: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of each word, written as ``<word>``, and of the whole word.

    Returns all buckets in word order and the start of each word's run; every word has at least one.
    """
    flat = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    codes = flat.astype(np.uint64) + np.uint64(1)
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    place = np.arange(len(codes)) - np.repeat(at, lengths)
    whole = np.add.reduceat(codes * powers(_BASE, int(lengths.max()))[place], at)
    ids, owners = [mix64(whole)], [np.arange(len(words))]
    for n in range(shortest, longest + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + codes[k:k + m]
        same = owner[:m] == owner[n - 1:]
        ids.append(mix64(h[same]))
        owners.append(owner[:m][same])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[order], np.arange(len(words)))
    return (np.concatenate(ids)[order] & np.uint64(buckets - 1)).astype(np.int64), starts
