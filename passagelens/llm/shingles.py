"""Hashed words and word shingles of a batch of texts, over whole columns of bytes at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SPACES = bytes(np.flatnonzero(_SPACE).tolist())
_PRIME = 0x9E3779B97F4A7C55
_INVERSE = pow(_PRIME, -1, 1 << 64)
#: Texts are hashed by so many bytes at a time; only a word that is longer is taken whole.
PIECE_BYTES = 4 << 20
BATCH_CHARS = 250_000


def batches(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of about BATCH_CHARS characters."""
    group = np.cumsum([0, *map(len, texts)])[:-1] // BATCH_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(texts)] if texts else []
    return (slice(a, b) for a, b in zip(cuts, cuts[1:]))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 64, n, np.uint64)


_BYTE_VALUES = numbers(1, 256)


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _cuts(data: bytes) -> Iterator[bytes]:
    """data in pieces of about PIECE_BYTES that end in white space, but for the last."""
    at = 0
    while len(data) - at > PIECE_BYTES:
        end = at + PIECE_BYTES
        while end < len(data) and data[end] not in _SPACES:
            end += 1
        yield data[at : end + 1]
        at = end + 1
    yield data[at:]


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of data, and where each begins."""
    raw = np.frombuffer(data.translate(_ASCII_LOWER) + b"\n", np.uint8)
    size = 1 << max(12, len(raw).bit_length())
    word = ~_SPACE[raw]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    edge = np.concatenate([[0], edge]) if word[0] else edge
    begin, end = edge[0::2], edge[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[raw] * _powers(_PRIME, size)[: len(raw)], out=sums[1:])
    return mixed((sums[end] - sums[begin]) * _powers(_INVERSE, size)[begin]), begin


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and the number of words of each text. Words stand between ASCII white space; A-Z counts as a-z."""
    encoded = [t.encode("utf-8") for t in texts]
    if sum(map(len, encoded)) > PIECE_BYTES:
        each = [np.concatenate([_hashed(part)[0] for part in _cuts(data)]) for data in encoded]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)
    hashes, begin = _hashed(b"\n".join(encoded))
    stops = np.cumsum([len(e) + 1 for e in encoded])
    upto = np.searchsorted(begin, stops)
    return hashes, np.diff(np.concatenate([[0], upto]))


def shingle_sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts, and where each text's begin (one more entry at the end)."""
    words, n_words = word_hashes(texts)
    first = np.concatenate([[0], np.cumsum(n_words)])
    factors = numbers(2, k)
    whole = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for j in range(k):
        whole += words[j : len(words) - k + 1 + j] * factors[j]
    whole = mixed(whole)
    out, sizes = [], np.zeros(len(texts), np.int64)
    for i, n in enumerate(n_words):
        if n >= k:
            own = np.sort(whole[first[i] : first[i] + n - k + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n:
            own = mixed(np.array([(words[first[i] : first[i + 1]] * factors[:n]).sum() + np.uint64(n)], np.uint64))
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])
