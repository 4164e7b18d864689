"""Words of whole texts as 64-bit hashes, computed over Arrow buffers without a Python loop per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gatecrest.llm.common import string_buffers

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are handled at once; bounds the working memory, not the text.
SLICE = 1 << 18


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """hashes: of all words; offsets: the first word of each text; starts, ends: bytes of each word in data."""

    hashes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    sums: np.ndarray
    inverse: np.ndarray

    def prefixes(self, size: int) -> np.ndarray:
        """Hash of the first ``size`` bytes of each word."""
        ends = np.minimum(self.ends, self.starts + size)
        return mix((self.sums[ends] - self.sums[self.starts]) * self.inverse[self.starts] + np.uint64(size))


class Tokenizer:
    """Words are maximal runs of ASCII letters, digits, ``_`` and non-ASCII characters other than general punctuation, in lower case."""

    def __init__(self) -> None:
        self.word = np.zeros(256, bool)
        self.word[[*b"abcdefghijklmnopqrstuvwxyz0123456789_"]] = True
        self.word[128:] = True
        self.pow = self.inv = np.ones(0, np.uint64)

    def __call__(self, texts: pa.Array) -> Words:
        offsets, data = string_buffers(pc.utf8_lower(texts))
        n = len(data)
        if n > len(self.pow):
            self.pow, self.inv = powers(BASE, max(n, SLICE)), powers(INVERSE, max(n, SLICE))
        w = self.word[data]
        for lead, second in ((0xE2, (0x80, 0x81)), (0xC2, (0xA0, 0xAB, 0xBB))):  # general punctuation; no-break space, guillemets
            at = np.flatnonzero(data[:-1] == lead) if n else np.zeros(0, np.int64)
            at = at[np.isin(data[at + 1], second)]
            for k in range(3 if lead == 0xE2 else 2):
                w[at[at + k < n] + k] = False
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = w[:-1], w[1:]
        starts = np.flatnonzero(w & (~before | edge[:-1]))
        ends = np.flatnonzero(w & (~after | edge[1:])) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.pow[:n], out=sums[1:])
        h = mix((sums[ends] - sums[starts]) * self.inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return Words(h, np.searchsorted(starts, offsets), starts, ends, data, sums, self.inv)


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of words of each text, and the first of each text. A text of 1 to n - 1 words has one gram, of all its words."""
    count = np.diff(words.offsets)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    offsets = np.concatenate([[0], np.cumsum(grams)])
    doc = np.repeat(np.arange(len(count)), grams)
    at = words.offsets[:-1][doc] + np.arange(offsets[-1]) - offsets[:-1][doc]
    last = words.offsets[1:][doc] - 1
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        part = words.hashes[np.minimum(at + k, last)] if len(at) else h
        h = mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + np.where(at + k <= last, part, np.uint64(k)))
    return h, offsets
