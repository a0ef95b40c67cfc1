"""Words of texts as numbers: split at ASCII white space, hashed many texts at a time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Bytes hashed at a time; a longer text is hashed by itself.
CHUNK = 1_000_000

_U = np.uint64
_random = np.random.default_rng(13)
_LETTER = _random.integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def scramble(x: np.ndarray) -> np.ndarray:
    """Mix the bits of 64-bit numbers, one to one."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


def word_hashes(texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and the bounds of each text (one more than texts)."""
    hashes, counts, i = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while i < len(texts):
        group, size = [], 0
        while i < len(texts) and (not group or size + len(texts[i] or b"") < CHUNK):
            group.append(texts[i] or b"")
            size += len(group[-1])
            i += 1
        found, n = _hashed(group)
        hashes.append(found)
        counts.append(n)
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)


def _hashed(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b" ".join([b"", *group, b""]), np.uint8)
    space = _SPACE[flat]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    # A word's bytes times powers of the base, summed, and shifted back to the word's start.
    total = np.concatenate([[_U(0)], np.cumsum(_LETTER[flat] * np.cumprod(np.full(len(flat), _BASE, np.uint64)))])
    back = np.cumprod(np.full(len(flat), _BACK, np.uint64))[starts]
    found = scramble((total[ends] - total[starts]) * back + (ends - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in group)]))
    return found, np.diff(bounds)


def window_hashes(words: np.ndarray, n: int, salt: int = 3) -> np.ndarray:
    """Hash of the ``n`` words from each position on; positions with fewer words after them are left out."""
    m = max(0, len(words) - n + 1)
    run = words[:m].copy()
    for k in range(1, n):
        run = scramble(run * _U(2 * salt + 1) + words[k : k + m])
    return run
