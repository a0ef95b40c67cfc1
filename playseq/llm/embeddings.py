"""Near-duplicate vectors by an exact metric range join.

On unit vectors, cosine >= c is the range query |x - y| <= r with r = sqrt(2 - 2c). Pivots partition the vectors into
cells by the nearest pivot. By the triangle inequality a vector x of cell p can only be in range of a vector of cell q
if the distance of x to the plane between p and q, (|x-q|^2 - |x-p|^2) / (2 |p-q|), is at most r, and if |x-q| is at most
the radius of q plus r; only to such cells is it replicated. Cells are joined independently of each other. A cell with
more rows than a block, as of a hot group of near copies, is joined block by block.

A task reports the links of its block pair as counts per vector and a spanning forest, never as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playseq.llm.components import components
from playseq.operators.storage import written

THRESHOLD = 0.9
#: Most pivots (they are sent to every task), vectors they are chosen from, and rows of a block.
PIVOTS, PIVOT_SAMPLE, BLOCK = 1024, 4096, 4096
#: Single precision finds candidates; nearer the threshold than this, double precision decides.
BAND = 1e-5


def unit(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def choose_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first: each pivot is the sampled vector farthest from those before, so dense groups share few pivots."""
    if most <= 0 or not len(sample):
        return sample[:0]
    chosen, far = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(most, len(sample)):
        nxt = int(far.argmax())
        if far[nxt] <= 1e-9:
            break
        chosen.append(nxt)
        far = np.minimum(far, np.linalg.norm(sample - sample[nxt], axis=1))
    return sample[chosen]


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _forest(mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the bipartite graph ``mask`` between ids ``left`` and ``right``, by search."""
    edges: list[tuple[int, int]] = []
    seen_rows, seen_columns = np.zeros(len(left), bool), np.zeros(len(right), bool)
    for start in np.flatnonzero(mask.any(axis=1)):
        if seen_rows[start]:
            continue
        seen_rows[start] = True
        rows = [start]
        while rows:
            row = rows.pop()
            fresh = np.flatnonzero(mask[row] & ~seen_columns)
            seen_columns[fresh] = True
            edges.extend((int(left[row]), int(right[c])) for c in fresh)
            for c in fresh:
                more = np.flatnonzero(mask[:, c] & ~seen_rows)
                seen_rows[more] = True
                edges.extend((int(left[m]), int(right[c])) for m in more)
                rows.extend(more.tolist())
            if seen_rows.all():
                break
    return edges


def _linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Mask of pairs with cosine >= threshold; ``a``, ``b`` are raw vectors, and the decision is in double precision."""
    ua, ub = unit(a), unit(b)
    cosine = ua.astype(np.float32) @ ub.astype(np.float32).T
    mask = cosine >= threshold
    rows, columns = np.nonzero(np.abs(cosine - np.float32(threshold)) <= BAND)
    for i in range(0, len(rows), 100_000):
        r, c = rows[i : i + 100_000], columns[i : i + 100_000]
        mask[r, c] = np.einsum("ij,ij->i", ua[r], ub[c]) >= threshold
    return mask


def block_links(first: tuple[np.ndarray, np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray, np.ndarray] | None, threshold: float, strip: int = 1024):
    """Links of two blocks of (ids, copies, vectors), or within the first: counts per id and a spanning forest."""
    ids, copies, vectors = first
    own = second is None
    other_ids, other_copies, other = first if own else second
    counts, other_counts, edges = np.zeros(len(ids), np.int64), np.zeros(len(other_ids), np.int64), []
    for i in range(0, len(ids), strip):
        mask = _linked(vectors[i : i + strip], other, threshold)
        if own:
            rows = np.arange(len(mask))
            mask[rows, rows + i] = False
        counts[i : i + strip] += mask @ other_copies if mask.any() else 0
        if not mask.any():
            continue
        if not own:
            other_counts += copies[i : i + strip] @ mask
        edges += _forest(mask, ids[i : i + strip], other_ids)
    return counts, other_counts, edges


RESULT = "id long, links long, other long"


def _join_cell(threshold: float):
    def run(key, data):
        ids = data.column("id").to_numpy()
        copies = data.column("copies").to_numpy()
        part = data.column("part").to_numpy()
        vectors = _matrix(data.column("vector"))
        side = lambda k: (ids[part == k], copies[part == k], vectors[part == k])
        first, second = side(0), None if key[3].as_py() == "own" else side(1)
        counts, other, edges = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        if len(first[0]) and (second is None or len(second[0])):
            counts, other, edges = block_links(first, second, threshold)
        who = np.concatenate([first[0][: len(counts)], second[0][: len(other)] if second is not None else np.zeros(0, np.int64), np.array([e[0] for e in edges], np.int64)])
        links = np.concatenate([counts, other if second is not None else np.zeros(0, np.int64), np.zeros(len(edges), np.int64)])
        far = pa.array([None] * (len(who) - len(edges)) + [e[1] for e in edges], pa.int64())
        made = pa.table([pa.array(who, pa.int64()), pa.array(links, pa.int64()), far], names=["id", "links", "other"])
        return made.filter(pc.or_(pc.greater(made["links"], 0), pc.is_valid(made["other"])))

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """For each row of ``embeddings`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Two rows link if the cosine of their vectors, in double precision, is at least ``threshold``. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing; so do vectors of different lengths. Rows with
    equal vectors are joined as one with their number. A null vec_id is a row of its own that links with nothing. Rows
    that repeat a vec_id with equal vectors count each other; different vectors under one vec_id are one vertex, whose
    links add up. Other columns are not read.
    """
    spark = embeddings.sparkSession
    kind = "float" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = embeddings.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("vector"))
    sound = F.coalesce(F.size("vector") > 0, F.lit(False)) & ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vector", lambda v: v != 0)
    good = rows.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    # Equal vectors: one row with the smallest id and the number of copies. -0.0 and 0.0 are the same component.
    vector = F.transform("vector", lambda v: v + F.lit(0.0).cast(kind))
    same = written(good.withColumn("vector", vector).groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "vectors")
    numbers = {r[0]: r[1] for r in same.groupBy(F.size("vector").alias("d")).count().collect()}
    hashed = F.xxhash64("id", "vector")

    pivots: dict[int, np.ndarray] = {}
    for d, n in numbers.items():
        share = min(1_000_000, -(-1_500_000 * PIVOT_SAMPLE // n))
        drawn = same.where((F.size("vector") == d) & (F.pmod(hashed, F.lit(1_000_000)) < share)).select(hashed.alias("h"), "vector").orderBy("h").limit(PIVOT_SAMPLE).collect()
        pivots[d] = choose_pivots(unit(np.array([r["vector"] for r in drawn]).reshape(len(drawn), d)), min(PIVOTS, -(-n // block))) if drawn else np.zeros((0, d))
    shared = spark.sparkContext.broadcast(pivots)
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-9

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cell and distance to its pivot."""
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            cell, far = np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                if len(p := shared.value.get(int(d), ())):
                    x = unit(_matrix(batch.column(1).take(pa.array(at))))
                    cosine = x @ p.T
                    cell[at] = cosine.argmax(axis=1)
                    far[at] = np.sqrt(np.maximum(0, 2 - 2 * cosine.max(axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(cell), pa.array(far)], names=["id", "vector", "size", "copies", "cell", "far"])

    typed = same.select(F.col("id").cast("long"), "vector", F.size("vector").alias("size"), "copies")
    cells = written(typed.mapInArrow(near, f"id long, vector array<{kind}>, size int, copies long, cell long, far double"), "cells")
    radius = {(r["size"], r["cell"]): r["r"] for r in cells.groupBy("size", "cell").agg(F.max("far").alias("r")).collect()}

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Later cells that a vector may have partners in; pairs of two cells meet in the later one."""
        for batch in batches:
            sizes, cell = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            goals: list[list[int]] = [[] for _ in range(len(sizes))]
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                p = shared.value.get(int(d), ())
                if len(p) < 2:
                    continue
                x = unit(_matrix(batch.column(0).take(pa.array(at))))
                cosine = x @ p.T
                own = cosine[np.arange(len(at)), cell[at]]
                gap = np.sqrt(np.maximum(1e-30, 2 - 2 * (p @ p.T)))[cell[at]]
                plane = (own[:, None] - cosine) / gap
                most = np.array([radius.get((int(d), q), -np.inf) for q in range(len(p))])
                there = (plane <= reach) & (np.sqrt(np.maximum(0, 2 - 2 * cosine)) <= most + reach) & (np.arange(len(p)) > cell[at][:, None])
                for i, row in zip(at, there):
                    goals[i] = np.flatnonzero(row).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(goals, pa.list_(pa.int64()))], names=["vector", "size", "cell", "id", "copies", "goals"])

    spread = cells.select("vector", "size", "cell", "id", "copies").mapInArrow(replicate, f"vector array<{kind}>, size int, cell long, id long, copies long, goals array<long>")
    members = written(
        spread.select("size", F.explode(F.concat(F.array(F.struct(F.col("cell").alias("cell"), F.lit(True).alias("own"))), F.transform("goals", lambda g: F.struct(g.alias("cell"), F.lit(False).alias("own"))))).alias("m"), "id", "copies", "vector").select("size", "m.*", "id", "copies", "vector"),
        "members",
    )
    # Rows of each cell, at most one row for each pivot and length: blocks follow from their number.
    sizes = members.groupBy("size", "cell").agg(F.count_if("own").alias("n_own"), F.count_if(~F.col("own")).alias("n_far"))
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    placed = members.join(F.broadcast(sizes.select("size", "cell", blocks("n_own").alias("own_blocks"), blocks("n_far").alias("far_blocks"))), ["size", "cell"])
    placed = placed.withColumn("b", F.pmod(F.xxhash64("id", "vector"), F.when(F.col("own"), F.col("own_blocks")).otherwise(F.col("far_blocks"))).cast("int"))
    pair = lambda i, j, kind, part: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(kind).alias("kind"), F.lit(part).alias("part"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    b, own_blocks, far_blocks = F.col("b"), F.col("own_blocks"), F.col("far_blocks")
    own_tasks = F.concat(
        F.array(pair(b, b, "own", 0)),
        F.transform(F.filter(upto(own_blocks), lambda k: k > b), lambda k: pair(b, k, "two", 0)),
        F.transform(F.filter(upto(own_blocks), lambda k: k < b), lambda k: pair(k, b, "two", 1)),
        F.transform(upto(far_blocks), lambda k: pair(b, k, "far", 0)),
    )
    tasks = F.when(F.col("own"), own_tasks).otherwise(F.transform(upto(own_blocks), lambda k: pair(k, b, "far", 1)))
    dealt = placed.select("size", "cell", F.explode(tasks).alias("t"), "id", "copies", "vector").select("size", "cell", "t.*", "id", "copies", "vector")
    dealt = dealt.select(F.concat_ws("/", "size", "cell").alias("place"), "i", "j", "kind", "part", "id", "copies", "vector")
    found = written(dealt.groupBy("place", "i", "j", "kind").applyInArrow(_join_cell(threshold), RESULT), "links")

    links = found.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    reached = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    classes = same.select("vector", "id", "copies").join(links, "id", "left").join(reached.withColumnRenamed("node", "id"), "id", "left")
    classes = classes.select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    known = good.withColumn("vector", vector).join(classes, "vector").select("vec_id", "n_links", "component_id")
    rest = rows.where(~(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = known.union(rest)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
