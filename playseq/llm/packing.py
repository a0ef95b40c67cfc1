"""Hashes of a batch that have to meet those of all other batches, packed for the journey.

A batch sends each distinct hash once, cut into ranges; within a range, hashes are sorted 32-bit numbers of which the
compressed differences travel, two to three bytes each. A range's task answers each batch with one bit for each of its
hashes. What one hash brings to a task is therefore bounded by the number of batches, however often it occurs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
LOW = _U(0xFFFFFFFF)


def range_keys(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """For 64-bit hashes: the range in the upper half, and their lower 32 bits. Different hashes may get one key."""
    return (((hashes >> _U(32)) * _U(ranges)) >> _U(32) << _U(32)) | (hashes & LOW)


def by_range(keys: np.ndarray) -> list[tuple[int, slice]]:
    """Ranges that occur, and where, in sorted keys."""
    found, starts = np.unique(keys >> _U(32), return_index=True)
    return [(int(r), slice(a, b)) for r, a, b in zip(found, starts, [*starts[1:], len(keys)])]


def firsts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each distinct key starts."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def packed(numbers: np.ndarray, *flags: np.ndarray) -> bytes:
    """Rising 32-bit numbers as compressed planes of their differences' bytes, then one bit per number for each flag."""
    steps = np.diff(numbers, prepend=np.uint32(0)).astype("<u4")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes() + b"".join(np.packbits(f).tobytes() for f in flags), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, flags: int) -> tuple[np.ndarray, list[np.ndarray]]:
    bits = -(-n // 8)
    raw = np.frombuffer(pa.decompress(data, decompressed_size=4 * n + flags * bits, codec="zstd", asbytes=True), np.uint8)
    steps = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4").ravel()
    marks = [np.unpackbits(raw[4 * n + i * bits : 4 * n + (i + 1) * bits], count=n).astype(bool) for i in range(flags)]
    return np.cumsum(steps, dtype=np.uint32), marks


def seen_again(block: pa.Table, flags: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Of a range's rows (``n``, ``packed``): for each distinct number whether it comes from several rows, the ``flags`` of
    any of them, and the order and starts of the distinct ones among all numbers."""
    read = [unpacked(p, n, flags) for p, n in zip(block.column("packed").to_pylist(), block.column("n").to_pylist())]
    number = np.concatenate([r[0] for r in read])
    order = np.argsort(number, kind="stable")
    first = firsts(number[order])
    many = np.diff(np.append(first, len(order))) > 1
    return many, [np.logical_or.reduceat(np.concatenate([r[1][i] for r in read])[order], first) for i in range(flags)], order, first


def spread(values: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A value of each distinct number, given to all places it has."""
    out = np.zeros(len(order), values.dtype)
    out[order] = np.repeat(values, np.diff(np.append(first, len(order))))
    return out


ANSWERS = "batch string, range long, bits binary"


def answers(block: pa.Table, answer: np.ndarray) -> pa.Table:
    """One row of bits for each batch of a range that has any."""
    ends = np.cumsum(sizes := block.column("n").to_pylist())
    bits = [answer[e - n : e] for e, n in zip(ends, sizes)]
    packed_bits = pa.array([pa.compress(np.packbits(b).tobytes(), codec="zstd", asbytes=True) for b in bits], pa.binary())
    made = pa.table([block.column("batch"), block.column("range"), packed_bits], names=["batch", "range", "bits"])
    return made.filter(pa.array([bool(b.any()) for b in bits]))


def answered(rows: pa.Table, parts: list[tuple[int, slice]], n: int) -> np.ndarray:
    """The answers of all ranges as one mask over a batch's sorted distinct hashes."""
    known, mask = dict(zip(rows.column("range").to_pylist(), rows.column("bits").to_pylist())), np.zeros(n, bool)
    for r, where in parts:
        if r in known:
            size = where.stop - where.start
            raw = pa.decompress(known[r], decompressed_size=-(-size // 8), codec="zstd", asbytes=True)
            mask[where] = np.unpackbits(np.frombuffer(raw, np.uint8), count=size).astype(bool)
    return mask
