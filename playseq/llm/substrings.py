"""Exact repeated passages across documents, by fixed-block anchors.

Documents are cut into non-overlapping reference blocks of b words. Any passage of 2b - 1 words holds a whole block, so
two documents that share a passage of ``window`` >= 2b - 1 words also share a reference block of one with a rolling window
of the other, whatever their alignment. Every rolling window of b words is probed against the reference blocks; where
it hits one of another document, both places are anchors. Anchors are extended by the words around them to all passages
of ``window`` words that hold them, and overlapping passages of a document merge into its maximal repeats. Places are
extended in classes of equal passages, each known by its smallest document, not in pairs: a block that m documents share
has m places, not m^2 pairs.

Texts are handled in batches of bounded size. To probe, a batch sends the distinct hashes of its windows, packed (see
``packing``); a range's task sees which of them meet, and answers each batch with one bit for each of its hashes. So about
two bytes travel for a word. Passages around anchors travel in the same way with longer hashes, and the answer to each is
whether a smaller document elsewhere holds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playseq.llm.common import brief_shuffles, stored
from playseq.llm.packing import ANSWERS, LOW, answered, answers, by_range, firsts, packed, range_keys, seen_again, spread
from playseq.llm.words import scramble, window_hashes, word_hashes

WINDOW = 13
#: Bytes of text in a batch (a longer text is one by itself), and for each range of hashes.
BATCH_BYTES, RANGE_BYTES = 8_000_000, 16_000_000

_U = np.uint64


def block_words(window: int) -> int:
    """The longest block of which every window holds an aligned one."""
    return (window + 1) // 2


@dataclass
class Probes:
    """The rolling windows of a batch: ``at`` (places), ``order`` (by hash), ``first`` (first of each distinct hash)."""

    words: np.ndarray
    bounds: np.ndarray
    at: np.ndarray
    order: np.ndarray
    first: np.ndarray
    key: np.ndarray
    aligned: np.ndarray
    shared: np.ndarray


def probes(texts: list[bytes | None], window: int, ranges: int) -> Probes:
    """``key`` is the range of a distinct hash, and its lower 32 bits; ``aligned``: a reference block has it; ``shared``:
    more than one text of the batch does."""
    block = block_words(window)
    words, bounds = word_hashes(texts)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(words)) - bounds[:-1][owner]
    at = np.flatnonzero((place + block <= sizes[owner]) & (sizes[owner] >= window))
    h = window_hashes(words, block)[at] if len(at) else np.zeros(0, np.uint64)
    key = range_keys(h, ranges)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = firsts(key)
    if not len(first):
        none = np.zeros(0, bool)
        return Probes(words, bounds, at, order, first, key, none, none)
    aligned = np.logical_or.reduceat((place[at] % block == 0)[order], first)
    whose = owner[at][order]
    shared = np.minimum.reduceat(whose, first) != np.maximum.reduceat(whose, first)
    return Probes(words, bounds, at, order, first, key[first], aligned, shared)


def _meet(block: pa.Table) -> pa.Table:
    """For each batch of a range: which of its hashes are in another text too, and in a reference block."""
    many, (aligned, shared), order, first = seen_again(block, 2)
    return answers(block, spread(aligned & (many | shared), order, first))


@dataclass
class Passages:
    """Extended anchors of a batch: words they start at, rank of their document's id in the batch, and classes of equal ones."""

    at: np.ndarray
    rank: np.ndarray
    order: np.ndarray
    first: np.ndarray
    key: np.ndarray
    more: np.ndarray
    least: np.ndarray


def passages(found: Probes, live: np.ndarray, ranks: np.ndarray, window: int, ranges: int) -> Passages:
    """All windows that hold a live anchor. ``ranks``: of the documents' ids, -1 for null ids (they have no passages)."""
    block, n = block_words(window), len(found.words)
    hit = np.zeros(n + 1, np.int64)
    mask = np.zeros(len(found.at), bool)
    mask[found.order] = np.repeat(live, np.diff(np.append(found.first, len(found.order))))
    hit[1:][found.at[mask]] = 1
    hits = np.cumsum(hit)
    sizes = np.diff(found.bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    m = max(0, n - window + 1)
    start = np.arange(m)
    own = owner[:m]
    fits = (start + window <= found.bounds[1:][own]) & (ranks[own] >= 0)
    at = np.flatnonzero(fits & (hits[np.minimum(start + window - block + 1, n)] > hits[start])) if m else np.zeros(0, np.int64)
    # Hashes of these windows alone, word by word.
    h, g = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for k in range(window):
        w = found.words[at + k]
        h, g = scramble(h * _U(11) + w), scramble(g * _U(29) + (w ^ _U(0x5851F42D4C957F2D)))
    rank = ranks[owner[at]]
    top = ((h >> _U(32)) * _U(ranges)) >> _U(32)
    order = np.lexsort((rank, g, h, top))
    h, g, top = h[order], g[order], top[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])) if len(at) else np.zeros(0, np.int64)
    return Passages(at, rank, order, first, h[first], g[first], rank[order][first])


def _smaller(block: pa.Table) -> pa.Table:
    """For each batch of a range: of which of its passages a smaller document is elsewhere."""
    h = np.concatenate([np.frombuffer(x, np.uint64) for x in block.column("hashes").to_pylist()])
    g = np.concatenate([np.frombuffer(x, np.uint32) for x in block.column("more").to_pylist()])
    ids = block.column("ids").combine_chunks().flatten()
    rank = pc.rank(ids, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
    order = np.lexsort((rank, g, h))
    first = np.flatnonzero(np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])]))
    answer = np.zeros(len(h), bool)
    answer[order] = rank[order] > np.repeat(rank[order][first], np.diff(np.append(first, len(order))))
    return answers(block, answer)


def _ranks(ids: pa.Array) -> np.ndarray:
    """Dense ranks of the ids from 0; -1 for null."""
    if not len(ids):
        return np.zeros(0, np.int64)
    rank = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64) - 1
    return np.where(ids.is_null().to_numpy(zero_copy_only=False), -1, rank)


def _batched(window: int, ranges: int, kind: pa.DataType):
    """Cut documents into batches; give their rows, and the packed hashes of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for whole in batches:
            at = 0
            sizes = pc.fill_null(pc.binary_length(whole.column(1).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
            while at < whole.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), BATCH_BYTES, side="right")))
                rows = whole.slice(at, n)
                at, number = at + n, number + 1
                name, texts = f"{part}-{number}", rows.column(1).cast(pa.large_binary()).to_pylist()
                known = rows.column(0).is_valid().to_pylist()
                found = probes([t if k else None for t, k in zip(texts, known)], window, ranges)
                parts = by_range(found.key)
                null = lambda t, n: pa.nulls(n, t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * rows.num_rows), rows.column(0), rows.column(1), null(pa.int64(), rows.num_rows), null(pa.int32(), rows.num_rows), null(pa.binary(), rows.num_rows)],
                    names=["batch", "id", "text", "range", "n", "packed"],
                )
                data = [packed((found.key[w] & LOW).astype(np.uint32), found.aligned[w], found.shared[w]) for _, w in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(parts), pa.string()), null(kind, len(parts)), null(rows.column(1).type, len(parts)), pa.array([r for r, _ in parts], pa.int64()), pa.array([w.stop - w.start for _, w in parts], pa.int32()), pa.array(data, pa.binary())],
                    names=["batch", "id", "text", "range", "n", "packed"],
                )

    return run


def _again(rows: pa.Table, live: pa.Table, window: int, ranges: int) -> tuple[list[bytes | None], Probes, Passages, list[tuple[int, slice]]]:
    """A batch's rows with the answers of the first round: its extended anchors."""
    texts = rows.column("text").cast(pa.large_binary()).to_pylist()
    ids = rows.column("id").combine_chunks()
    ranks = _ranks(ids)
    found = probes([t if r >= 0 else None for t, r in zip(texts, ranks)], window, ranges)
    mask = answered(live, by_range(found.key), len(found.key))
    made = passages(found, mask, ranks, window, ranges)
    return texts, found, made, by_range(range_keys(made.key, ranges))


def _extended(window: int, ranges: int):
    def run(rows: pa.Table, live: pa.Table) -> pa.Table:
        _, _, made, parts = _again(rows, live, window, ranges)
        ids, ranks = rows.column("id").combine_chunks(), _ranks(rows.column("id").combine_chunks())
        example = np.zeros(int(ranks.max(initial=-1)) + 1, np.int64)
        example[ranks[ranks >= 0]] = np.flatnonzero(ranks >= 0)
        holder = ids.take(pa.array(example[made.least]))
        name = rows.column("batch")[0].as_py() if rows.num_rows else None
        offsets = pa.array([*(w.start for _, w in parts), len(made.key)], pa.int32())
        return pa.table(
            [
                pa.array([name] * len(parts), pa.string()),
                pa.array([r for r, _ in parts], pa.int64()),
                pa.array([w.stop - w.start for _, w in parts], pa.int32()),
                pa.array([made.key[w].tobytes() for _, w in parts], pa.binary()),
                pa.array([(made.more[w] & LOW).astype(np.uint32).tobytes() for _, w in parts], pa.binary()),
                pa.ListArray.from_arrays(offsets, holder),
            ],
            names=["batch", "range", "n", "hashes", "more", "ids"],
        )

    return run


def _removed(window: int, ranges: int):
    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        first = pc.equal(told.column("round"), 1)
        texts, found, made, parts = _again(rows, told.filter(first), window, ranges)
        elsewhere = answered(told.filter(pc.invert(first)), parts, len(made.key))
        counts = np.diff(np.append(made.first, len(made.order)))
        gone = np.zeros(len(made.at), bool)
        gone[made.order] = np.repeat(elsewhere, counts) | (made.rank[made.order] > np.repeat(made.least, counts))
        steps = np.zeros(len(found.words) + 1, np.int64)
        np.add.at(steps, made.at[gone], 1)
        np.add.at(steps, made.at[gone] + window, -1)
        off = np.cumsum(steps[:-1]) > 0
        n_words, n_removed, spans, kept = [], [], [], []
        for i, text in enumerate(texts):
            words = (text or b"").split()
            own = off[found.bounds[i] : found.bounds[i + 1]]
            n_words.append(len(words))
            n_removed.append(int(own.sum()))
            if not n_removed[-1]:
                spans.append([])
                kept.append(b" ".join(words).decode())
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]]).astype(np.int8)))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
            kept.append(b" ".join([w for w, o in zip(words, own.tolist()) if not o]).decode())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([rows.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "removed", "kept"])

    return run


def remove_repeats(documents: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """For each row of ``documents`` (doc_id, text): doc_id, n_words, n_removed, removed, kept.

    Words are split at ASCII white space and compared unchanged, over whole texts. ``removed`` are the maximal stretches
    (start, end) of words covered by windows of ``window`` words that also start in a document with a smaller doc_id;
    ``kept`` are all other words, joined by single spaces. Windows are judged on the input. Null and empty texts have no
    words. A row with a null doc_id loses nothing and takes nothing from others. Rows that repeat a doc_id do not count
    against each other, each against all smaller ids. Other columns are not read. Windows are compared by 96-bit hashes.
    """
    spark = documents.sparkSession
    kind = dict(documents.dtypes)["doc_id"]
    rows = documents.select(F.col("doc_id").alias("id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-total // RANGE_BYTES))
    with brief_shuffles(spark):
        arrow = spark.createDataFrame([], f"id {kind}").toArrow().schema.field("id").type
        base = stored(rows.mapInArrow(_batched(window, ranges, arrow), f"batch string, id {kind}, text string, range long, n int, packed binary"), "batches")
        texts = base.where("range is null").select("batch", "id", "text")
        probed = base.where("range is not null").select("batch", "range", "n", "packed")
        live = stored(probed.groupBy("range").applyInArrow(_meet, ANSWERS), "anchors")
        extended = texts.groupBy("batch").cogroup(live.groupBy("batch")).applyInArrow(_extended(window, ranges), f"batch string, range long, n int, hashes binary, more binary, ids array<{kind}>")
        classes = stored(extended, "passages")
        smaller = stored(classes.groupBy("range").applyInArrow(_smaller, ANSWERS), "smaller")
    told = live.withColumn("round", F.lit(1)).union(smaller.withColumn("round", F.lit(2)))
    removed = texts.groupBy("batch").cogroup(told.groupBy("batch"))
    return removed.applyInArrow(_removed(window, ranges), f"doc_id {kind}, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string")
