"""Words of many texts at once, as numpy arrays of 64-bit hashes.

Texts are laid end to end as UTF-8 with a line feed between them.  A word is a
run of bytes of a given class; its hash is a polynomial of its bytes modulo
2**64, taken from running sums, so no Python code runs per word.  Two
different words share a hash with a probability of about 2**-64.
"""

from __future__ import annotations

import numpy as np

#: Bytes handled at once (a longer text is handled alone, whole).
CHUNK = 200_000
_STEP = 0xD1342543DE82EF95


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_power = {1: np.ones(1, dtype=np.uint64), pow(_STEP, -1, 1 << 64): np.ones(1, dtype=np.uint64)}


def _powers(n: int, step: int) -> np.ndarray:
    have = _power.get(step)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + 1), np.uint64(step), dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 10 * CHUNK:
            _power[step] = have
    return have[:n]


class Words:
    """The words of a list of texts (bytes): start, end, text number and hash of each."""

    def __init__(self, texts: list[bytes], outside: np.ndarray = _BLANK):
        self.n_texts = len(texts)
        self.raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        size = np.array([len(t) for t in texts], dtype=np.int64) + 1
        ends = np.cumsum(size)
        word = np.zeros(len(self.raw) + 1, dtype=np.int8)
        word[1:] = ~outside[self.raw]
        edge = np.diff(word)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.text = np.searchsorted(ends, self.start, side="right")
        self.counts = np.bincount(self.text, minlength=self.n_texts)
        sums = np.zeros(len(self.raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[_LOWER[self.raw]] * _powers(len(self.raw), _STEP), out=sums[1:])
        self._sums = sums

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """Hash of every word (A-Z lower-cased), or of its first ``longest`` bytes."""
        end = self.end if longest is None else np.minimum(self.end, self.start + longest)
        inverse = _powers(len(self.raw) + 1, pow(_STEP, -1, 1 << 64))
        h = (self._sums[end] - self._sums[self.start]) * inverse[self.start]
        return mix(h ^ ((end - self.start).astype(np.uint64) << np.uint64(40)))


def runs(texts: list[bytes], chunk: int = CHUNK):
    """Cut a list of texts into consecutive lists of at most ``chunk`` bytes (or one text)."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > chunk:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by sorting, which is faster here than numpy's hashing)."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def ngrams(h: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n consecutive values within one text, and their text numbers."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=text.dtype)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(_STEP) + h[k:k + m])
    within = text[:m] == text[n - 1:]
    return out[within], text[:m][within]
