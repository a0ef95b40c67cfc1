"""Exact Jaccard join of word n-gram sets by partitioning the universe of n-grams.

Two sets of sizes s and t with Jaccard similarity of at least c differ in at most (s + t)(1 - c)/(1 + c) elements. Sizes
are cut into bands. For the pairs whose larger set lies in a band, the universe is hashed into segments, and each segment
is allotted 0, 1 or 2 units, more units in all than elements may differ. By the pigeonhole principle, some segment then
differs in fewer elements than its units: with one unit it is equal in both sets, with two it is equal after deleting
at most one element. So sets are indexed by their segments' subsets (one unit) and these with their one-deletion
neighbourhoods (two units). A cost model over a sample allots the units; it changes the work, never the result.
Small segments are often empty, and all sets with an empty segment would share its key. So a band may have spare segments
of one unit: with e of them at least e + 1 segments are equal, and a set of at most e empty ones needs no keys for these.

Sets with equal elements are one class and joined as one. Most keys belong to one class only, so the keys of each batch of
documents are first probed packed (see ``packing``), and only those that another one has too become rows. Keys met by two
classes give their pair. In a key met by more, all are paired with one hub, the class that meets others most often; what
these links leave in different components is paired then, if parity sketches (lower bounds of the difference) allow it.
Every pair is verified on the sets. Classes that hold one doc_id are linked through it, as the id is one vertex.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playseq.llm.common import brief_shuffles, release_memory, small_batches
from playseq.llm.components import stars
from playseq.llm.packing import ANSWERS, LOW, answered, answers, by_range, firsts, packed, range_keys, seen_again, spread
from playseq.operators.storage import written

#: Words of a shingle, and the similarity as a percentage.
WORDS, PERCENT = 3, 90
#: Ratio of the largest to the smallest size in a band.
BAND = 1.2
#: Texts the cost model looks at, and the most characters of one of them.
SAMPLE, SAMPLE_CHARS = 2000, 50_000
#: Ids that may be sent to every task: 8 bytes each.
SMALL = 1_000_000
#: 64-bit words of the parity sketch, and least ones of the finer one that what passes it has to pass.
SKETCH, FINE = 8, 32
#: Bytes hashed, and rows answered, at a time.
CHUNK, ROWS = 1_000_000, 500
#: Index keys of a batch (of one document at least), and of a range in which keys are probed.
BATCH_KEYS, RANGE_KEYS = 500_000, 2_000_000
#: Partners of a hub that are verified in one task.
PARTNERS = 200


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


_U = np.uint64
_random = np.random.default_rng(20)
_BYTES = _random.integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers, one to one."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: Sequence[bytes | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles. A text of fewer words is one shingle; without any, none."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        group, size = [], 0
        while i < len(texts) and (not group or size + len(texts[i] or b"") < CHUNK):
            group.append((texts[i] or b"").lower())
            size += len(group[-1])
            i += 1
        out += _sets(group, words)
    return out


def _sets(group: list[bytes], words: int) -> list[np.ndarray]:
    flat = np.frombuffer(b" ".join([b"", *group, b""]), np.uint8)
    space = _SPACE[flat]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    # Hash of a word: sum of its bytes' numbers times powers of the base, shifted to its start.
    n = len(flat)
    powers = np.cumprod(np.full(n, _BASE, np.uint64))
    total = np.concatenate([[_U(0)], np.cumsum(_BYTES[flat] * powers)])
    inverse = np.cumprod(np.full(n, _INVERSE, np.uint64))
    word = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in group)]))
    run = word.copy()
    # Without words[k:] no text of the group has a shingle of so many words.
    for k in range(1, min(words, len(word))):
        run[: len(word) - k] = mix(run[: len(word) - k] * _U(3) + word[k:])
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= words:
            out.append(np.unique(run[a : b - words + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for w in word[a:b]:
                whole = mix(whole * _U(5) + w)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def most_different(total: int, percent: int = PERCENT) -> int:
    """Most elements in which two sets of ``total`` elements together may differ."""
    return total * (100 - percent) // (100 + percent)


@dataclass
class Scheme:
    """Segments of one band of sizes, the units of each, and how many are spare (if any, all have one unit)."""

    low: int
    high: int
    units: np.ndarray
    spare: int = 0


class Index:
    """Schemes of all bands up to the largest size."""

    def __init__(self, largest: int, percent: int = PERCENT):
        self.percent, self.schemes, low = percent, [], 1
        while low <= largest:
            high = max(low, int(low * max(BAND, 100 / percent + 0.01)))
            while most_different(2 * (high + 1), percent) == 0:
                high += 1
            need = most_different(2 * high, percent) + 1
            spare = spare_segments(need, low * percent / 100)
            self.schemes.append(Scheme(low, high, np.ones(need + spare, np.int64), spare))
            low = high + 1
        self.lows = np.array([s.low for s in self.schemes])

    def bands(self, size: int) -> list[int]:
        """A set's own band, and the next one if a set there can be similar."""
        own = int(np.searchsorted(self.lows, size, side="right")) - 1
        if own + 1 < len(self.schemes) and size * 100 >= self.percent * self.schemes[own + 1].low:
            return [own, own + 1]
        return [own]

    def keys(self, elements: np.ndarray) -> np.ndarray:
        if not len(elements):
            return np.zeros(0, np.int64)
        found = [k for band in self.bands(len(elements)) for k in segment_keys(elements, band, self.schemes[band].units, self.schemes[band].spare)]
        return np.unique(np.concatenate(found)).view(np.int64)

    def fit(self, sets: Sequence[np.ndarray], rows: int) -> None:
        """Allot the units of each band by cost: index rows, and pairs expected among ``rows`` sets."""
        members: list[list[np.ndarray]] = [[] for _ in self.schemes]
        for s in sets:
            for band in self.bands(len(s)) if len(s) else ():
                members[band].append(s)
        for band, own in enumerate(members):
            if len(own) >= 20:
                scale = rows / max(1, len(sets))
                need = most_different(2 * self.schemes[band].high, self.percent) + 1
                options = [(*allot(own, band, need, need + more, scale), 0) for more in sorted({0, 1, 2, need // 8})]
                options.append((*allot(own, band, need, -(-need // 2), scale), 0))
                most = len(self.schemes[band].units) - need
                for spare in sorted({most // 4, most // 2, most} - {0}):
                    options.append((spared_cost(own, band, need + spare, spare, scale), np.ones(need + spare, np.int64), spare))
                _, self.schemes[band].units, self.schemes[band].spare = min(options, key=lambda o: o[0])


def _parts(elements: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segment of each element, its two 32-bit halves, and the halves' sums by segment (exact in double precision)."""
    segment = ((elements >> _U(17)) % _U(segments)).astype(np.int64)
    scrambled = mix(elements ^ _U(0xA5A5A5A5A5A5A5A5))
    low, high = (scrambled & _U(0xFFFFFFFF)).astype(np.float64), (scrambled >> _U(32)).astype(np.float64)
    return segment, low, high, np.bincount(segment, low, segments), np.bincount(segment, high, segments)


def _key(low: np.ndarray, high: np.ndarray, segment: np.ndarray, band: int) -> np.ndarray:
    subset = mix(low.astype(np.uint64) + mix(high.astype(np.uint64)))
    return mix(subset + mix(segment.astype(np.uint64) * _U(0x10001) + _U(band << 40)))


def spare_segments(need: int, size: float) -> int:
    """Spare segments that leave few sets of ``size`` elements with more empty ones (mean plus four deviations)."""
    for spare in range(need):
        mean = (need + spare) * np.exp(-size / (need + spare))
        if mean < 0.01 or spare >= mean + 4 * np.sqrt(mean):
            return spare
    return 0


def segment_keys(elements: np.ndarray, band: int, units: np.ndarray, spare: int = 0) -> list[np.ndarray]:
    """Keys of the segments with units, and of the one-deletion neighbours of those with two.

    Empty segments have no keys if there are at most ``spare`` of them (then all units are one).
    """
    segment, low, high, lows, highs = _parts(elements, len(units))
    at = np.flatnonzero(units > 0)
    if spare:
        filled = np.bincount(segment, minlength=len(units)) > 0
        if np.count_nonzero(~filled) <= spare:
            at = np.flatnonzero(filled)
    out = [_key(lows[at], highs[at], at, band)]
    two = np.flatnonzero(units[segment] == 2)
    if len(two):
        own = segment[two]
        out.append(_key(lows[own] - low[two], highs[own] - high[two], own, band))
    return out


def spared_cost(sets: Sequence[np.ndarray], band: int, segments: int, spare: int, scale: float, pair_cost: float = 5.0) -> float:
    """Cost, as in ``allot``, of segments of one unit of which some are spare."""
    keys = np.concatenate([segment_keys(s, band, np.ones(segments, np.int64), spare)[0] for s in sets])
    n = np.unique(keys, return_counts=True)[1]
    return float(len(keys) + pair_cost * 2 * (n * (n - 1) / 2).sum() * scale) / len(sets)


def allot(sets: Sequence[np.ndarray], band: int, need: int, segments: int, scale: float, pair_cost: float = 5.0) -> tuple[float, np.ndarray]:
    """Cheapest units found for a number of segments, with at least ``need`` units in all, and their cost.

    Start with one unit each; while there are too few, raise the cheapest segments to two; while there are too many, drop
    the dearest; then trade a dear segment's unit for a second unit elsewhere as long as that is cheaper.
    """
    rows = {1: np.ones(segments), 2: np.ones(segments)}
    keys: dict[int, list] = {1: [], 2: []}
    for s in sets:
        ones, twos = segment_keys(s, band, np.ones(segments, np.int64)), segment_keys(s, band, np.full(segments, 2))
        own = _parts(s, segments)[0]
        rows[2] += np.bincount(own, minlength=segments) / len(sets)
        keys[1].append((np.arange(segments), ones[0]))
        keys[2].append((np.concatenate([np.arange(segments), own]), np.concatenate(twos)))
    cost = {}
    for u in (1, 2):
        where, key = np.concatenate([k[0] for k in keys[u]]), np.concatenate([k[1] for k in keys[u]])
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        pairs = np.bincount(where[first], n * (n - 1) / 2, segments)
        cost[u] = rows[u] + pair_cost * 2 * pairs / len(sets) * scale
    units = np.ones(segments, np.int64)
    more = cost[2] - cost[1]
    if segments < need:
        units[np.argsort(more, kind="stable")[: need - segments]] = 2
    else:
        units[np.argsort(-cost[1], kind="stable")[: segments - need]] = 0
    ones = np.flatnonzero(units == 1)
    cheap, dear = ones[np.argsort(more[ones], kind="stable")], ones[np.argsort(-cost[1][ones], kind="stable")]
    for i, j in zip(cheap, dear):
        if units[i] == 1 and units[j] == 1 and i != j and more[i] < cost[1][j]:
            units[i], units[j] = 2, 0
        else:
            break
    return float(sum(cost[u][units == u].sum() for u in (1, 2))), units


def sketch(elements: np.ndarray) -> np.ndarray:
    """Parity of the number of elements in each of a power of two of cells, 64 x FINE and the number of elements at least.

    Differing bits are at most differing elements, and stay so when cells are added up (``folded``).
    """
    cells = max(64 * FINE, 1 << max(0, len(elements) - 1).bit_length())
    odd = np.bincount((elements & _U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(bool))


def folded(sketch: bytes, size: int = SKETCH) -> np.ndarray:
    """The same with 64 x ``size`` cells, as longs."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.int64).reshape(-1, size))


def _fingerprint(elements: np.ndarray) -> tuple[int, int]:
    """Two sums over the whole set, scrambled differently."""
    a = mix(elements + _U(0x1234567)).sum(dtype=np.uint64)
    b = mix(elements ^ _U(0x7F4A7C159E3779B9)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _sent(df: DataFrame, size: int) -> DataFrame:
    """``df`` as the side of a join that goes to every task if ``size`` is small."""
    return F.broadcast(df) if size <= SMALL else df


def _only(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is in ``ids`` (read twice): sent to every task if counted and small, else joined by shuffle."""
    ids = ids.select(F.col(ids.columns[0]).alias(column))
    return df.join(_sent(ids, ids.count()), column, "left_semi")


def _similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _sketches_allow(a: str, b: str, percent: int) -> Column:
    differ = sum(F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH))
    return differ * (100 + percent) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - percent)


def _indexed(shared, words: int, ranges: int):
    """Sets, index keys and fingerprints of documents by batch; and the packed keys of each batch."""
    names = ["batch", "doc_id", "n", "f", "g", "sketch", "keys", "range", "m", "packed"]

    def emit(name: str, ids: pa.Array, rows: list[tuple], keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        null = lambda t, n: pa.nulls(n, t)
        count = len(rows)
        sizes, prints, sketches = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name] * count),
                ids,
                pa.array(sizes, pa.int64()),
                pa.array([p[0] for p in prints], pa.int64()),
                pa.array([p[1] for p in prints], pa.int64()),
                pa.array([s.tobytes() for s in sketches], pa.binary()),
                pa.array([k.tobytes() for k in keys], pa.binary()),
                null(pa.int64(), count),
                null(pa.int32(), count),
                null(pa.binary(), count),
            ],
            names=names,
        )
        owner = np.repeat(np.arange(count), [len(k) for k in keys])
        probe = range_keys(np.concatenate(keys).view(np.uint64), ranges) if count else np.zeros(0, np.uint64)
        order = np.argsort(probe, kind="stable")
        first = firsts(probe[order])
        if not len(first):
            return
        own, whose = probe[order][first], owner[order]
        # Of rows with one fingerprint, the last that has the key stands for all.
        _, alike = np.unique(np.array([p[0] for p in prints]), return_inverse=True)
        again = np.minimum.reduceat(alike[whose], first) != np.maximum.reduceat(alike[whose], first)
        parts = by_range(own)
        data = [packed((own[w] & LOW).astype(np.uint32), again[w]) for _, w in parts]
        k = len(parts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name] * k),
                null(ids.type, k),
                null(pa.int64(), k),
                null(pa.int64(), k),
                null(pa.int64(), k),
                null(pa.binary(), k),
                null(pa.binary(), k),
                pa.array([r for r, _ in parts], pa.int64()),
                pa.array([w.stop - w.start for _, w in parts], pa.int32()),
                pa.array(data, pa.binary()),
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        known, part, number = shared.value, TaskContext.get().partitionId(), 0
        ids, rows, keys, held = [], [], [], 0

        def batch() -> Iterator[pa.RecordBatch]:
            yield from emit(f"{part}-{number}", pa.concat_arrays(ids), rows, keys)

        for piece in _slices(batches):
            for s, i in zip(shingle_sets(piece.column(1).cast(pa.binary()).to_pylist(), words), range(piece.num_rows)):
                if held >= BATCH_KEYS:
                    yield from batch()
                    ids, rows, keys, held, number = [], [], [], 0, number + 1
                ids.append(piece.column(0).slice(i, 1))
                rows.append((len(s), _fingerprint(s), sketch(s)))
                keys.append(known.keys(s))
                held += len(keys[-1])
        if rows:
            yield from batch()
        ids, rows, keys = [], [], []
        release_memory()

    return run


def _seen(block: pa.Table) -> pa.Table:
    """For each batch of a range: which of its keys another set has too."""
    many, (again,), order, first = seen_again(block, 1)
    return answers(block, spread(many | again, order, first))


def _alive(ranges: int):
    """Of a batch's sets, those that stand for a class, with the keys that another set has too."""

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.int64) for k in rows.column("keys").to_pylist()]
        every = np.concatenate([*keys, np.zeros(0, np.int64)])
        probe = range_keys(every.view(np.uint64), ranges)
        order = np.argsort(probe, kind="stable")
        first = firsts(probe[order])
        own = probe[order][first]
        live = spread(answered(told.filter(pc.is_valid(told.column("range"))), by_range(own) if len(own) else [], len(own)), order, first)
        ends = np.cumsum([len(k) for k in keys])
        names = told.filter(pc.is_valid(told.column("v")))
        known = {(f, g, n): v for f, g, n, v in zip(*(names.column(c).to_pylist() for c in ("f", "g", "n", "v")))}
        out: list[tuple] = []
        for i, of in enumerate(zip(*(rows.column(c).to_pylist() for c in ("f", "g", "n")))):
            # A class is taken from the first of its rows.
            v = known.pop(of, None)
            if v is not None:
                out.append((v, of[2], i, keys[i][live[ends[i] - len(keys[i]) : ends[i]]]))
        fine = [rows.column("sketch")[o[2]].as_py() for o in out]
        values = [[o[0] for o in out], [o[1] for o in out], [folded(s) for s in fine], fine, [o[3] for o in out]]
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
        made = pa.table([pa.array(v, t) for v, t in zip(values, types)], names=["id", "n", "sketch", "fine", "keys"])
        release_memory()
        return made

    return run


def _finely_allowed(pairs: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """Pairs that the finer sketches allow too; there are few left of those that share keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            differ = np.zeros(len(total), np.int64)
            for i, (left, right) in enumerate(zip(batch.column(3).to_pylist(), batch.column(5).to_pylist())):
                size = min(len(left), len(right)) // 8
                differ[i] = np.bitwise_count((folded(left, size) ^ folded(right, size)).view(np.uint64)).sum()
            fit = differ * (100 + percent) <= total * (100 - percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(fit))

    sides = [vertices.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("fine").alias(f"fine{x}")) for x in ("a", "b")]
    joined = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "na", "finea", "nb", "fineb")
    return joined.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, classes: DataFrame, documents: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of classes whose sets are similar. ``pairs``: a written table of distinct pairs.

    The texts of these classes are read again. The partners of a class are dealt into groups, and each group meets
    the one set of its class in a task, so no pair carries two sets.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = written(classes.join(_sent(ids, 2 * pairs.count()), "id", "left_semi").select("id", "doc_id", "f", "g", "n"), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple] = set()
        for batch in _slices(batches):
            made = shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), words)
            prints = [_fingerprint(s) for s in made]
            rows = pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([p[i] for p in prints], pa.int64()) for i in (0, 1)), pa.array([len(s) for s in made], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())],
                names=["doc_id", "f", "g", "n", "elements"],
            )
            # A task gives a set once, however often its row is repeated.
            fresh = []
            for name in zip(batch.column(0).to_pylist(), prints):
                fresh.append(name not in given)
                given.add(name)
            yield rows.filter(pa.array(fresh, pa.bool_()))
        release_memory()

    few = wanted.count()
    texts = documents.where("doc_id is not null and text is not null").join(_sent(wanted.select("doc_id"), few), "doc_id", "left_semi")
    made = texts.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, f long, g long, n long, elements binary")
    # Five columns for each wanted class, so fewer of them are sent to every task.
    known = _sent(wanted, 5 * few)
    sets = written(made.join(known, ["doc_id", "f", "g", "n"]).select("id", F.monotonically_increasing_id().alias("row"), "elements"), "sets")
    # Rows that repeat an id with one text give one set for each task that reads some of them; one is taken.
    repeated = sets.groupBy("id").agg(F.min("row").alias("row"), F.count("*").alias("n")).where("n > 1").select("id", "row")
    if not repeated.isEmpty():
        repeated = written(repeated, "repeated")
        once = sets.join(repeated.select("id"), "id", "left_anti").select("id", "elements")
        sets = once.union(sets.join(repeated, ["id", "row"], "left_semi").select("id", "elements"))

    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("groups"))
    dealt = pairs.join(groups, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("part"))
    # Both sides come from the same tables, so columns get names of their own.
    partners = dealt.join(sets.select(F.col("id").alias("b"), F.col("elements").alias("theirs")), "b").select(F.col("a").alias("hub"), "part", "b", "theirs")
    hubs = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group")).join(sets.select(F.col("id").alias("a"), F.col("elements").alias("own")), "a")

    def meet(hub: pa.Table, others: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if hub.num_rows:
            own, a = np.frombuffer(hub.column("own")[0].as_py(), np.uint64), hub.column("a")[0].as_py()
            for b, elements in zip(others.column("b").to_pylist(), others.column("theirs")):
                other = np.frombuffer(elements.as_py(), np.uint64)
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                common = int((own[at] == other).sum())
                if common * 100 >= (len(own) + len(other) - common) * percent:
                    found.append((a, b))
        return pa.table([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return hubs.groupBy("a", "group").cogroup(partners.groupBy("hub", "part")).applyInArrow(meet, "a long, b long")


def _across(inside: DataFrame, info: DataFrame, keys: int, percent: int) -> DataFrame:
    """Distinct pairs of a member that is outside its hub's component and any other member of the key, of another component.

    ``keys``: number of keys with members outside.
    """
    outside = inside.where("out").select("key", "id", "component").join(info, "id")
    others = inside.join(_sent(inside.where("out").select("key").distinct(), keys), "key", "left_semi").join(info, "id")
    pair = (
        outside.alias("x")
        .join(others.alias("y"), F.col("x.key") == F.col("y.key"))
        .where(
            (F.col("x.component") != F.col("y.component"))
            & (~F.col("y.out") | (F.col("x.id") < F.col("y.id")))
            & _similar_sizes(F.col("x.n"), F.col("y.n"), percent)
            & _sketches_allow("x", "y", percent)
        )
    )
    return pair.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def near_duplicates(documents: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """For each row of ``documents`` (doc_id, text): doc_id, n_shingles and component_id.

    A text's set are its distinct shingles of ``words`` words (lower-cased A-Z, split at white space); with fewer words,
    the whole as one. Two rows link if 100 x intersection >= ``percent`` x union; component_id is the smallest doc_id
    reachable by links. Null texts and texts without words have empty sets and link with nothing. A row with a null
    doc_id links with nothing and has a null component. Rows that repeat a doc_id are one vertex. Other columns are not
    read. Shingles are compared by 64-bit hashes (a wrong match within a pair has a chance below 1e-10).
    """
    with brief_shuffles(documents.sparkSession), small_batches(documents.sparkSession):
        return _near_duplicates(documents, words, percent)


def _near_duplicates(documents: DataFrame, words: int, percent: int) -> DataFrame:
    spark = documents.sparkSession
    rows = documents.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    size = rows.agg(F.count("*"), F.max(F.octet_length("text"))).first()
    index = Index((size[1] or 1) // 2 + 2, percent)
    few = rows.where((F.length("text") <= SAMPLE_CHARS) & (F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < min(1_000_000, -(-1_500_000 * SAMPLE // max(1, size[0])))))
    drawn = few.select(F.xxhash64("text").alias("h"), "text").orderBy("h", "text").limit(SAMPLE).collect()
    sample = shingle_sets(sorted({r["text"].encode() for r in drawn}), words)
    index.fit(sample, size[0])
    # Ranges for about as many keys as the sample lets expect; another number changes their sizes only.
    ranges = max(1, -(-int(sum(len(index.keys(s)) for s in sample) / max(1, len(sample)) * size[0]) // RANGE_KEYS))
    shared = spark.sparkContext.broadcast(index)

    fields = f"batch string, doc_id {kind}, n long, f long, g long, sketch binary, keys binary, range long, m int, packed binary"
    base = written(rows.mapInArrow(_indexed(shared, words, ranges), fields), "shingles")
    shared.unpersist()
    sets = base.where("range is null").select("batch", "doc_id", "n", "f", "g")
    # Equal sets are one class, with the smallest of its ids. Copies collapse before they are shuffled.
    full = sets.where("n > 0 and doc_id is not null")
    classes = full.groupBy("f", "g", "n").agg(F.min(F.struct("doc_id", "batch")).alias("least")).select(F.monotonically_increasing_id().alias("id"), "f", "g", "n", "least.*")
    classes = written(classes, "classes")
    seen = base.where("range is not null").select("batch", "range", F.col("m").alias("n"), "packed").groupBy("range").applyInArrow(_seen, ANSWERS)
    nothing = [F.lit(None).cast("long").alias(c) for c in ("f", "g", "n", "v")]
    named = classes.select("batch", F.lit(None).cast("long").alias("range"), F.lit(None).cast("binary").alias("bits"), "f", "g", "n", F.col("id").alias("v"))
    told = written(seen.select("batch", "range", "bits", *nothing).union(named), "told")
    able = base.where("range is null and n > 0 and doc_id is not null").select("batch", "f", "g", "n", "sketch", "keys")
    vertices = able.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_alive(ranges), "id long, n long, sketch array<long>, fine binary, keys array<long>")
    vertices = written(vertices, "vertices")
    info = vertices.select("id", "n", "sketch")
    keyed = vertices.select("id", F.explode("keys").alias("key"))
    counted = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("a"), F.max("id").alias("b")).where("m > 1")
    counted = written(counted, "keys")

    # Keys of more than two classes: their members, and the hub of each.
    members = written(_only(keyed, counted.where("m > 2").select("key"), "key"), "members")
    often = members.groupBy("id").agg(F.count("*").alias("often"))
    hubs = members.join(often, "id").groupBy("key").agg(F.min_by("id", F.struct(-F.col("often"), "id")).alias("hub"))
    tied = written(members.join(hubs, "key"), "hubs")

    def candidates(found: DataFrame) -> DataFrame:
        """Distinct pairs that sizes and sketches allow."""
        found = found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        left, right = (info.select(F.col("id").alias(x), F.struct("n", "sketch").alias(y)) for x, y in (("a", "x"), ("b", "y")))
        joined = found.join(left, "a").join(right, "b")
        return joined.where(_similar_sizes(F.col("x.n"), F.col("y.n"), percent) & _sketches_allow("x", "y", percent)).select("a", "b")

    first = written(candidates(counted.where("m = 2").select("a", "b").union(tied.select(F.col("id").alias("a"), F.col("hub").alias("b")))), "pairs")
    links = written(_verified(written(_finely_allowed(first, vertices, percent), "likely"), classes, documents, words, percent), "links")

    # Classes that hold one id are linked through it.
    placed = full.select("doc_id", "f", "g", "n").distinct()
    repeated = placed.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.isEmpty():
        repeated = written(repeated, "repeated")
        own = written(_only(placed, repeated, "doc_id").join(classes.select("id", "f", "g", "n"), ["f", "g", "n"]).select("doc_id", "id"), "own")
        links = written(links.union(own.join(own.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").where("a <> id").select("a", F.col("id").alias("b"))), "links")

    # Members of a key that are not in its hub's component yet meet all other members of the key.
    final = reached = stars(links)
    inside = tied.join(reached.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "hub", F.coalesce("component", "id").alias("component"))
    inside = inside.join(reached.select(F.col("node").alias("hub"), F.col("component").alias("hub_component")), "hub", "left")
    inside = written(inside.withColumn("out", F.col("component") != F.coalesce("hub_component", "hub")).where("id <> hub").select("key", "id", "component", "out"), "inside")
    # The driver keeps something of each query, so those of this pass run only if they have rows.
    open_keys = inside.where("out").select("key").distinct().count()
    if open_keys:
        likely = written(_finely_allowed(_across(inside, info, open_keys, percent).join(first, ["a", "b"], "left_anti"), vertices, percent), "likely")
        if not likely.isEmpty():
            later = _verified(likely, classes, documents, words, percent)
            final = stars(written(reached.select(F.col("node").alias("a"), F.col("component").alias("b")).union(later), "links"))

    joined = classes.join(final.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = written(joined.join(least, "component").select("f", "g", "n", "component_id"), "named")
    known = full.select("doc_id", "n", "f", "g").join(named, ["f", "g", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = sets.where("not (n > 0 and doc_id is not null)").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return known.union(rest)
