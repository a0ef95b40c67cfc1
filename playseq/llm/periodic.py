"""Periodic runs of words: seed and extend on diagonals.

A stretch with smallest period q and at least four periods agrees with itself, shifted by the lag q, over at least 3q
words. So for lags from 2^j to 2^(j+1) - 1, grams of 3 x 2^j words are the seeds: every run holds one at its start and q
words later. Such a gram is at least as long as the lag, so within a run it recurs after exactly q words and not before;
the occurrence pairs of a gram that matter are therefore those of neighbours, and each gram position is in two of them at
most. (At lag 1, runs have six words at least, and seeds five.) Pairs are taken in the order of their positions; a table
holds for each lag how far extensions have covered its diagonal, and pairs below are not extended again.

Grams are numbered by doubling, exactly, within each document; only positions whose shorter grams recur are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from playseq.llm.common import map_text

#: Least words of a run, and least number of periods.
LEAST, PERIODS = 6, 4
#: Words looked at together; a longer text is looked at by itself.
GROUP = 200_000


def _agreeing(left: np.ndarray, right: np.ndarray) -> int:
    """How many words agree from the start on."""
    done, step, most = 0, 32, min(len(left), len(right))
    while done < most:
        end = min(most, done + step)
        differ = left[done:end] != right[done:end]
        if differ.any():
            return done + int(differ.argmax())
        done, step = end, step * 2
    return done


def _grams(first: np.ndarray, offset: int, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the grams made of ``first`` and, ``offset`` words on, ``second`` (-1: occurs once), and all pairs of
    neighbouring occurrences, by position."""
    n = len(first)
    number = np.full(n, -1, np.int64)
    none = np.zeros(0, np.int64)
    if n <= offset:
        return number, none, none
    at = np.flatnonzero((first[: n - offset] >= 0) & (second[offset:] >= 0))
    if not len(at):
        return number, none, none
    key = first[at] * n + second[at + offset]
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    same = key[1:] == key[:-1]
    often = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    named = np.cumsum(np.concatenate([[True], ~same])) - 1
    number[at[often]] = named[often]
    return number, at[:-1][same], at[1:][same]


def seeds(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each band of lags: length of its grams, and positions and lags of their neighbouring occurrences."""
    _, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
    one = np.where(counts[inverse] > 1, inverse, -1).astype(np.int64)
    two, *_ = _grams(one, 1, one)
    four, *_ = _grams(two, 2, two)
    _, a, b = _grams(four, 4, one)
    near = b - a == 1
    yield LEAST - 1, a[near], b[near] - a[near]
    low, half, whole = 2, two, four
    while (whole >= 0).any():
        _, a, b = _grams(whole, 2 * low, half)
        near = (b - a >= low) & (b - a < 2 * low)
        yield 3 * low, a[near], b[near] - a[near]
        low, half, whole = 2 * low, whole, _grams(whole, 2 * low, whole)[0]


def find_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of numbers, by start, then period."""
    found, covered = [], {}
    for size, at, lag in seeds(codes):
        order = np.lexsort((lag, at))
        for i, q in zip(at[order].tolist(), lag[order].tolist()):
            if i < covered.get(q, -1):
                continue
            end = i + size + _agreeing(codes[i + size :], codes[i + size + q :])
            start = i - _agreeing(codes[:i][::-1], codes[: i + q][::-1]) if i else 0
            covered[q] = end
            if end - start + q >= max(LEAST, PERIODS * q):
                found.append((start, end - start + q, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def best_run(runs: Sequence[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact quotient of length and period; of equal ones the first by start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _collapsed(words: list[bytes], runs: Sequence[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period."""
    if not runs:
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    kept = np.cumsum(steps[:-1]) == 0
    return b" ".join([w for w, k in zip(words, kept.tolist()) if k])


def _analysed(texts: list[bytes | None]) -> list[list]:
    runs_out, best_out, collapsed_out, i = [], [], [], 0
    while i < len(texts):
        group, codes, bounds, seen = [], [], [0], 0
        while i < len(texts) and (not group or bounds[-1] < GROUP):
            words = (texts[i] or b"").split()
            own: dict[bytes, int] = {}
            codes += [own.setdefault(w, seen + len(own)) for w in words]
            seen += len(own)
            group.append(words)
            bounds.append(len(codes))
            i += 1
        owned: list[list] = [[] for _ in group]
        found = find_runs(np.array(codes, np.int64))
        where = np.searchsorted(bounds, [r[0] for r in found], side="right") - 1
        for k, (start, length, period) in zip(where.tolist(), found):
            owned[k].append((start - bounds[k], length, period))
        for words, runs in zip(group, owned):
            runs_out.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
            best = best_run(runs)
            best_out.append(best and dict(zip(("start", "length", "period"), best)))
            collapsed_out.append(_collapsed(words, runs).decode())
    return [runs_out, best_out, collapsed_out]


RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
FIELDS = [T.StructField("runs", T.ArrayType(RUN)), T.StructField("best", RUN), T.StructField("collapsed", T.StringType())]


def periodic_runs(df: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, then ``runs``, ``best`` and ``collapsed``.

    The words of the whole text are split at ASCII white space and numbered from 0. ``runs`` are all stretches with
    smallest period q and at least max(6, 4q) words that no neighbouring word extends, by start, then period; ``best`` is
    the one with the greatest length / period (ties: smallest start, then period; null without runs); ``collapsed`` are
    the words that no run holds after its first q words, joined by single spaces. Null and empty texts have no words: no
    runs, null, an empty text. Rows are independent of each other, so repeated rows and null ids need no care. Result
    columns replace kept columns of their names. A text's work is about n log(n) of its words, whatever repeats in it.
    """
    return map_text(df, list(keep), text, FIELDS, lambda: _analysed)
