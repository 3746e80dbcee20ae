"""Counts of very many 64-bit keys, shuffled as packed arrays.

Keys are dealt to 2**bits segments by their highest bits.  A task counts the
keys of a block of text, and ships per segment one row with the sorted keys and
their counts as arrays, which takes a fraction of what single rows take.  There
are so many segments that each stands for about ``SEGMENT_TEXT`` bytes of text,
whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

SEGMENT_TEXT = 8 << 20
LEAST_BITS = 5


def text_bytes(texts: DataFrame, text_col: str = "text") -> int:
    return texts.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def segment_bits(n_bytes: int) -> int:
    """So many bits that 2**bits segments hold at most ``SEGMENT_TEXT`` bytes of text each (about)."""
    return max(LEAST_BITS, int(np.ceil(np.log2(max(1, n_bytes / SEGMENT_TEXT)))))


def tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of several tallies and their summed counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, dtype=np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def by_segment(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The segments that sorted keys fall into, and where each one's keys lie."""
    own = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else []
    for a, b in zip(edges, [*edges[1:], len(own)]):
        yield int(own[a]), slice(a, b)


def low32(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits of a key below those that name its segment."""
    return ((keys >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")
