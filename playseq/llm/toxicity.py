"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, accents off, letters of other scripts that look like Latin ones and digits written
for letters replaced. The lexicon holds words and beginnings of words that labelled toxic texts prefer, with their log
odds as weights; exception phrases, learned from clean texts, cancel the hits inside them. The weights found, normalised
by the text's length, give the score through a logistic function fitted to the labels.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playseq.llm.common import held_out, map_text

#: Most labelled texts of either class that are learned from.
TOXIC_ROWS, CLEAN_ROWS = 2500, 10_000
#: Lengths of the beginnings of words that may enter the lexicon, beside whole words.
PREFIXES = (4, 5, 6)
#: Least log odds of an entry, and most entries.
LEAST_WEIGHT, MOST_ENTRIES = 3.0, 20_000
#: Least likelihood ratio statistic of an entry against chance; many possible entries are tested.
LEAST_RATIO = 24.0

# Letters of other scripts that look like a Latin letter once accents are off, by that letter.
LOOKALIKES = {
    "a": "аɑα", "b": "βьв", "c": "ϲс", "d": "ԁ", "e": "еε", "g": "ɡ", "h": "հһ", "i": "іι", "j": "ј", "k": "κк", "l": "ⅼӏ", "m": "м", "n": "пո",
    "o": "оοσ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ѵν", "w": "ωш", "x": "хχ", "y": "уγʏ", "z": "ᴢ",
}
# Characters written for letters inside words; l and 1 share a sign with i.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _tables() -> tuple[dict[int, str], dict[int, str]]:
    letters = {ord(a): b for b, like in LOOKALIKES.items() for a in like}
    return letters, {ord(a): b for a, b in SIGNS.items()}


_LETTERS, _SIGNS = _tables()
_MARKS = re.compile("[̀-ͯ​-‍﻿]+")
# Signs count as letters if a letter follows, in the same run.
_SIGNED = re.compile(r"[013457@$]+(?=[a-z])")
_BREAKS = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Folded words, each between single spaces, with a space at either end."""
    low = text.lower()
    if not low.isascii():
        low = _MARKS.sub("", unicodedata.normalize("NFKD", low)).translate(_LETTERS)
    low = _SIGNED.sub(lambda m: m.group().translate(_SIGNS), low)
    return f" {' '.join(_BREAKS.sub(' ', low).replace('l', 'i').split())} "


def entries(words: Iterable[str]) -> set[str]:
    """Possible lexicon entries of a text, as patterns: a whole word ends with a space."""
    out = set()
    for w in set(words):
        if w.isalpha() and len(w) < 40:
            out.add(f" {w} ")
            out.update(f" {w[:n]}" for n in PREFIXES if len(w) > n)
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: Sequence[str] = ()
    coefficients: Sequence[float] = (-3.0, 1.0, 0.0, 0.0)
    _tree: object = field(default=None, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": list(self.exceptions), "coefficients": list(self.coefficients), "_tree": None}

    @property
    def tree(self):
        if self._tree is None:
            self._tree = ahocorasick.Automaton()
            for pattern, weight in self.weights.items():
                self._tree.add_word(pattern, (len(pattern), weight))
            for phrase in self.exceptions:
                self._tree.add_word(f" {phrase} ", (len(phrase) + 2, None))
            if len(self._tree):
                self._tree.make_automaton()
        return self._tree

    def hits(self, folded: str) -> dict[int, float]:
        """Largest weight found at each start of a word, without words inside exception phrases."""
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if not len(self.tree):
            return found
        for end, (size, weight) in self.tree.iter(folded):
            start = end + 1 - size
            if weight is None:
                spared.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        # Matches come by their ends; exception phrases by their starts, and words within the farthest end so far, go in one pass.
        spared.sort()
        nth, end = 0, -1
        for at in sorted(found) if spared else ():
            while nth < len(spared) and spared[nth][0] <= at:
                end = max(end, spared[nth][1])
                nth += 1
            if at < end:
                del found[at]
        return found

    def features(self, folded: str) -> list[float]:
        # A word that is repeated counts once.
        found = {folded[start : folded.find(" ", start + 1)]: weight for start, weight in self.hits(folded).items()}
        total = sum(found.values())
        words = folded.count(" ") - 1
        return [1.0, float(np.log1p(total)), float(np.log1p(1000 * total / max(words, 20))), float(np.log1p(len(found)))]

    def score(self, folded: str) -> float:
        z = float(np.dot(self.features(folded), self.coefficients))
        return 1 / (1 + float(np.exp(-max(-30.0, min(30.0, z)))))


def _decoded(text: bytes | None) -> str:
    return (text or b"").decode(errors="replace")


def _counts(rows: DataFrame, keys) -> DataFrame:
    """Texts of either label that hold each key; ``keys`` gives the keys of a folded text. Tasks add up first."""

    def run(batches):
        import pyarrow as pa

        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def full():
            for label, counter in counts.items():
                items = list(counter.items())
                counter.clear()
                for i in range(0, len(items), 50_000):
                    part = items[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k for k, _ in part], pa.string()), pa.array([n * (label == 1) for _, n in part], pa.int64()), pa.array([n * (label == 0) for _, n in part], pa.int64())],
                        names=["key", "toxic", "clean"],
                    )

        for batch in batches:
            for text, label in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                counts[label].update(keys(fold(_decoded(text))))
                if len(counts[0]) + len(counts[1]) > 500_000:
                    yield from full()
        yield from full()

    return rows.select("text", "toxic").mapInArrow(run, "key string, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _weight(toxic, clean, n_toxic: int, n_clean: int):
    return F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1))


def _ratio(toxic, clean, n_toxic: int, n_clean: int):
    """Twice the log likelihood ratio of the counts against one common rate."""
    share, n = n_toxic / (n_toxic + n_clean), toxic + clean
    part = lambda k, rate: F.when(k > 0, k * F.log(k / (n * F.lit(rate)))).otherwise(0.0)
    return 2 * (part(toxic, share) + part(clean, max(1 - share, 1e-9)))


def sample(documents: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> DataFrame:
    """Text and label of at most about ``toxic_rows`` and ``clean_rows`` labelled documents, outside the held-out fold.

    Ids are drawn by hash from the labels, so the ids sent to every task are bounded by the two numbers. Of a repeated id
    one text is learned from, the first by hash and then by text, so the bound holds for rows too.
    """
    labels = labels.where(F.col("toxic").isin(0, 1) & ~held_out() & F.col("doc_id").isNotNull())
    # A document with two labels counts as toxic.
    labels = labels.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    cells = 1_000_000
    sizes = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    share = F.lit(0)
    for label, most in ((0, clean_rows), (1, toxic_rows)):
        share = F.when(F.col("toxic") == label, F.lit(min(cells, cells * most // max(1, sizes.get(label, 1))))).otherwise(share)
    drawn = labels.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), F.lit(cells)) < share)
    found = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), "doc_id")
    # Tasks take their minimum first, so that the rows of a repeated id do not meet.
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), F.col("text").alias("text"))).alias("first")
    return found.groupBy("doc_id", "toxic").agg(first).select("first.text", "toxic")


def fit(documents: DataFrame, labels: DataFrame) -> Lexicon:
    """Learn lexicon, exceptions and the logistic function from a bounded sample of labelled rows (see ``sample``)."""
    from playseq.operators.storage import written

    rows = written(sample(documents, labels), "toxic-sample")
    spark = rows.sparkSession
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic:
        return Lexicon({})
    weight = _weight(F.col("toxic"), F.col("clean"), n_toxic, n_clean)
    counted = _counts(rows, lambda folded: entries(folded.split()))
    chosen = counted.where((weight >= LEAST_WEIGHT) & (_ratio(F.col("toxic"), F.col("clean"), n_toxic, n_clean) >= LEAST_RATIO)).select("key", weight.alias("weight"), "toxic")
    found = chosen.orderBy(F.desc(F.col("weight") * F.log(F.col("toxic") + 1)), "key").limit(MOST_ENTRIES).collect()
    lexicon = Lexicon({r["key"]: float(r["weight"]) for r in found})
    shared = spark.sparkContext.broadcast(lexicon)

    def phrases(folded: str) -> set[str]:
        out = set()
        for start in shared.value.hits(folded):
            word, _, rest = folded[start + 1 :].partition(" ")
            before = folded[:start].rpartition(" ")[2]
            after = rest.partition(" ")[0]
            out.update(f"{a} {b}" for a, b in ((before, word), (word, after)) if a and b)
        return out

    # A phrase is an exception if its hits come from clean texts for the most part.
    clean = _counts(rows, phrases).where((F.col("clean") >= 3) & (F.col("clean") / n_clean > 3 * (F.col("toxic") + 0.5) / n_toxic))
    lexicon.exceptions = sorted(r["key"] for r in clean.orderBy(F.desc("clean"), "key").limit(MOST_ENTRIES).collect())
    shared = spark.sparkContext.broadcast(lexicon)

    def make():
        known = shared.value
        return lambda texts: [[known.features(fold(_decoded(t))) for t in texts]]

    measured = map_text(rows, ["toxic"], "text", [T.StructField("x", T.ArrayType(T.DoubleType()))], make).collect()
    measured.sort(key=lambda r: (r["toxic"], r["x"]))
    lexicon.coefficients = logistic(np.array([r["x"] for r in measured]), np.array([r["toxic"] for r in measured], dtype=float))
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> list[float]:
    """Coefficients of a ridge logistic regression (Newton's method); both classes count alike."""
    weight = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, len(y) - y.sum())))
    b = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - penalty @ b
        b = b + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, gradient)
    return [float(v) for v in b]


def score(documents: DataFrame, lexicon: Lexicon, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Add ``score`` (0 to 1) to the columns ``keep``. Whole texts are scanned; null and empty texts have no hits."""
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        known = shared.value
        return lambda texts: [[known.score(fold(_decoded(t))) for t in texts]]

    return map_text(documents, keep, "text", [T.StructField("score", T.DoubleType())], make)


def toxicity(documents: DataFrame, labels: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Learn from ``labels`` (doc_id, toxic) and score all of ``documents``: ``keep``, held_out, score, predicted.

    Labels that are null or neither 0 nor 1 are not learned from. Without toxic labels nothing is toxic. Kept columns
    named like a result are replaced.
    """
    lexicon = fit(documents, labels)
    scored = score(documents.withColumn("held_out", held_out()), lexicon, [*keep, "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
