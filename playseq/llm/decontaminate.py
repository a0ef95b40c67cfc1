"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark texts.

Texts are normalised to words, and the automaton's patterns are runs of consecutive item words. Its nodes look for a
letter among their children one by one, so words are not letters themselves: each word of the benchmark's vocabulary is
spelled as a fixed number of digits of a small base, and matches that end within a word are passed over. Each document
is scanned once. Word positions of hits are mapped back to character offsets of the original text.
"""

from __future__ import annotations

from collections.abc import Sequence

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playseq.llm.common import map_text, release_memory
from playseq.operators.storage import written

#: Consecutive item words that make a window.
WINDOW = 10
#: Benchmark text, in bytes, that one automaton (and one broadcast) may hold; a larger benchmark is scanned in blocks.
#: Each task builds the automaton, which takes many times as much memory as its text.
BLOCK_BYTES = 1_500_000
#: Most digits' values, so most children of a node.
BASE = 256

# Words are runs of 0-9, a-z, A-Z and everything beyond ASCII; A-Z is lower-cased. In UTF-8 this is a table of bytes.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def windows(text: bytes | None, size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Runs of ``size`` words; a shorter text is one run; a text without words has none."""
    item = words(text)
    if len(item) <= size:
        return [tuple(item)] if item else []
    return [tuple(item[i : i + size]) for i in range(len(item) - size + 1)]


def spelled(number: int, digits: int) -> str:
    """``number`` in ``digits`` letters of an alphabet of BASE."""
    return "".join(chr(33 + number // BASE**i % BASE) for i in range(digits))


class Automaton:
    """Scans word lists for the windows of items. ``items``: pairs of id (or None) and text as UTF-8."""

    def __init__(self, items: Sequence[tuple[str | None, bytes | None]], size: int = WINDOW):
        self.codes: dict[bytes, str] = dict.fromkeys(w for _, text in items for w in words(text))
        self.digits = 1
        while BASE**self.digits <= len(self.codes):
            self.digits += 1
        # Number 0 is left to the words of documents that no item has.
        self.codes = {w: spelled(i, self.digits) for i, w in enumerate(self.codes, 1)}
        self.unknown = spelled(0, self.digits)
        owners: dict[str, frozenset[str]] = {}
        for item, text in items:
            # One set for all windows of an item, where no other item has them.
            mine = frozenset([item] if item is not None else [])
            for window in windows(text, size):
                key = "".join([self.codes[w] for w in window])
                had = owners.get(key)
                owners[key] = mine if had is None else had if mine <= had else had | mine
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_STRING)
        self.empty = not owners
        while owners:
            key, who = owners.popitem()
            self.tree.add_word(key, (len(key) // self.digits, who))
        if not self.empty:
            self.tree.make_automaton()

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of hit words (first, one past the last) and the ids of the items found."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if self.empty or not found:
            return spans, items
        known, unknown, digits = self.codes.get, self.unknown, self.digits
        for at, (size, who) in self.tree.iter("".join([known(w, unknown) for w in found])):
            end, part = divmod(at + 1, digits)
            if part:
                continue
            items |= who
            start = end - size
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, end))
        return spans, items


def offsets(text: bytes, spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in ``text`` of spans of words."""
    if not spans:
        return []
    folded, at, bounds, wanted = text.translate(_FOLD), 0, {}, {i for s in spans for i in (s[0], s[1] - 1)}
    for i, word in enumerate(folded.split()):
        at = folded.index(word, at)
        if i in wanted:
            bounds[i] = (at, at + len(word))
        at += len(word)
    chars = lambda n: len(text[:n].decode(errors="replace"))
    return [(chars(bounds[a][0]), chars(bounds[b - 1][1])) for a, b in spans]


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("_words", _SPANS),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", _SPANS),
]


def _scan_block(documents: DataFrame, keep: Sequence[str], items: list[tuple[str | None, bytes | None]], size: int, earlier: bool) -> DataFrame:
    """One pass over the texts with the automaton of ``items``; ``earlier`` columns of a former pass are merged in."""
    shared = documents.sparkSession.sparkContext.broadcast(items)
    carried = ["_words", "items"] if earlier else []

    def make():
        release_memory()
        automaton = Automaton(shared.value, size)

        def work(texts):
            out = [[], [], [], []]
            for text in texts:
                found = words(text)
                spans, who = automaton.scan(found)
                out[0].append(len(found))
                out[1].append([{"start": a, "end": b} for a, b in spans])
                out[2].append(sorted(who))
                out[3].append([{"start": a, "end": b} for a, b in offsets(text or b"", spans)])
            return out

        return work

    if not earlier:
        return map_text(documents, keep, "text", FIELDS, make)
    held = documents.select(*keep, *[F.col(c).alias(f"_had{c}") for c in (*carried, "spans")])
    done = map_text(held, [*held.columns], "text", FIELDS, make)
    merged = {c: F.array_sort(F.array_distinct(F.concat(f"_had{c}", c))) for c in (*carried, "spans")}
    return done.withColumns(merged).drop(*[f"_had{c}" for c in merged])


def _joined() -> dict[str, Column]:
    """Spans of several blocks that touch or overlap in words as one, as a scan for all items at once gives them.

    Both arrays are sorted and distinct, and the offsets follow from the words, so they go together.
    """
    pairs = F.zip_with("_words", "spans", lambda w, c: F.struct(w.alias("w"), c.alias("c")))
    both = lambda a, b: F.struct(a["start"].alias("start"), F.greatest(a["end"], b["end"]).alias("end"))

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(both(last["w"], x["w"]).alias("w"), both(last["c"], x["c"]).alias("c"))))
        return F.when((F.size(acc) > 0) & (last["w"]["end"] >= x["w"]["start"]), grown).otherwise(F.concat(acc, F.array(x)))

    span = "struct<start:int,end:int>"
    made = F.aggregate(pairs, F.array().cast(f"array<struct<w:{span},c:{span}>>"), step)
    return {"_words": F.transform(made, lambda s: s["w"]), "spans": F.transform(made, lambda s: s["c"])}


def find_contamination(documents: DataFrame, benchmark: DataFrame, *, keep: Sequence[str] = ("doc_id",), window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Mark the words of ``documents`` that lie in any window of ``benchmark`` (item_id, text).

    Returns the columns ``keep`` and n_words, n_hit, n_items, items_sha256, items (ids as text, sorted), spans (character
    offsets of hit passages in the original text) and contaminated. A kept column that has the name of a result is replaced.

    Null or empty texts have no words and no hits. An item without words is never found; of an item with a null id the
    words are hit, but no id is listed. Items with one id count once. With an empty benchmark nothing is hit.

    The benchmark is collected in blocks of about ``block_bytes`` (one block, unless it is very large), each broadcast and
    scanned for in turn; the results of blocks are merged per row.
    """
    keep = [c for c in dict.fromkeys(keep) if c not in {"n_words", "n_hit", "n_items", "items_sha256", "items", "spans", "contaminated"}]
    # Ids as text are distinct rows first: copies of items need not be shipped.
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null").distinct()
    blocks = max(1, -(-int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    result = documents.select(*dict.fromkeys([*keep, "text"]))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        if block:
            result = written(result, "scanned")
        carry = [*keep, "text"] if blocks > 1 and "text" not in keep else keep
        result = _scan_block(result, carry, [(r[0], bytes(r[1])) for r in rows], window, block > 0)
    if blocks > 1:
        result = result.withColumns(_joined())
    # Words hit: the union of the blocks' spans, which may overlap.
    merged = F.aggregate(
        F.array_sort("_words"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("last")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["last"]), F.lit(0))).alias("n"), F.greatest(acc["last"], s["end"]).alias("last")),
        lambda acc: acc["n"].cast("long"),
    )
    return result.select(
        *keep,
        "n_words",
        merged.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "items",
        "spans",
        (merged > 0).alias("contaminated"),
    )
