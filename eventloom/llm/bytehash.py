"""Vectorised hashing of words and byte windows over a buffer of many texts.

A text's bytes are mapped to random 64-bit values and summed with powers of an odd base
(arithmetic modulo 2**64), so that the hash of any span comes from two prefix sums.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20_240_131))
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n > 1 << 24:  # a giant text's powers aren't kept
            return have
        _powers[name] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * _power("up", BASE, len(data) + 1)[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans, before mixing; equal bytes of equal length give equal hashes."""
    return (sums[end] - sums[start]) * _power("down", BASE_INVERSE, len(sums))[start]


def gather(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, a space after each; where each starts (and the buffer's end)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return data, np.concatenate([[0], np.cumsum(lens)])


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, split at ASCII white space with A-Z lowered; where each text's words start (and their end)."""
    data, at = gather(texts)
    data = ASCII_LOWER[data]
    white = WHITE[data]
    before = np.concatenate([[True], white[:-1]])
    start = np.flatnonzero(before & ~white)
    end = np.flatnonzero(white & ~before)
    return mix(span_hash(prefix_sums(data), start, end)), np.searchsorted(start, at)


def shingles(hashes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of each text, in order, and the text of each; a text of fewer words is one run."""
    counts = np.diff(at)
    runs = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), runs)
    first = np.concatenate([[0], np.cumsum(runs)])[:-1]
    start = at[:-1][text] + (np.arange(len(text)) - first[text])
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    acc = np.zeros(len(text), np.uint64)
    short = counts[text]
    for k in range(n):
        part = padded[start + k]
        acc = acc * BASE + np.where(k < short, part, np.uint64(k + 1))
    return mix(acc + np.minimum(short, n).astype(np.uint64)), text


def chunks(sizes: list[int], most: int):
    """Slices of consecutive texts of about ``most`` bytes."""
    begin, total = 0, 0
    for k, size in enumerate(sizes):
        total += size
        if total >= most:
            yield begin, k + 1
            begin, total = k + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def slices(batches, rows: int = 512):
    """Arrow batches in slices, so that only a slice's texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
