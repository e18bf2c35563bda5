"""Word shingle sets of whole texts as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_SEED = 20240902
_BYTE = np.random.default_rng(_SEED).integers(0, 2**64, 256, dtype=np.uint64)
for _c in range(65, 91):  # A-Z count as a-z
    _BYTE[_c] = _BYTE[_c + 32]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 18
_POWERS = np.cumprod(np.full(4096, 0xD1342543DE82EF95, dtype=np.uint64))
_PLACES = np.zeros(0, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _at(n: int) -> np.ndarray:
    """A random number for each of at least the first ``n`` places of a word."""
    global _PLACES
    if n > len(_PLACES):
        _PLACES = mixed((np.arange(1 << n.bit_length(), dtype=np.uint64) + np.uint64(_SEED)) * _STEP)
    return _PLACES


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(1 << n.bit_length(), _POWERS[0], dtype=np.uint64))
    return _POWERS


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word between ASCII white space, A-Z as a-z, and the place where it starts.

    A byte and its place make one random number, and a word is their sum. (Sums of bytes times powers
    modulo 2 ** 64 meet for texts that alternate in a known way, whatever the base.)
    """
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) - np.repeat(before, sizes)
    own = _BYTE[raw[inside[1:-1]]] ^ _at(int(sizes.max()))[at]
    own = (own ^ (own >> np.uint64(32))) * _STEP
    own ^= own >> np.uint64(29)
    return mixed(np.add.reduceat(own, before) + sizes.astype(np.uint64) * _STEP), starts


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    total = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total += words[k : len(words) - width + 1 + k] * _powers(2 * width)[2 * k + 1]
    return mixed(total)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sets of a few texts, cut and hashed together."""
    words, starts = _words(np.frombuffer(b" ".join(texts), dtype=np.uint8))
    ends = np.cumsum([len(t) + 1 for t in texts])
    last = np.searchsorted(starts, ends)
    first = np.concatenate([[0], last[:-1]])
    every = _shingles(words, width) if len(words) >= width else words[:0]
    out = []
    for a, b in zip(first, last, strict=True):
        out.append(_distinct(every[a : b - width + 1] if b - a >= width else _shingles(words[a:b], b - a)) if b > a else words[:0])
    return out


def shingle_sets(texts: Iterable[str | None], width: int) -> Iterator[list[np.ndarray]]:
    """Distinct shingles of ``width`` words of each text, sorted, in lists of texts of about ``CHUNK`` bytes.

    Fewer words make one shingle, none make none.
    """
    held, size = [], 0
    for text in texts:
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= CHUNK:
            yield _sets(held, width)
            held, size = [], 0
    if held:
        yield _sets(held, width)
