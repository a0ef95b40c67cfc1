"""Language identification with a byte convolutional network, trained in numpy.

A text is cut into windows of a fixed number of bytes. Each byte is embedded; filters of several widths slide over the
window, their outputs are max-pooled over the window, and a softmax over the pooled features gives the language. The
probabilities of a text are the averages of its windows' log probabilities. All windows of all texts are scored, in
batches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playseq.llm.common import held_out, map_text

#: Bytes in a window, and between the starts of two windows (filters reach over the seam).
LENGTH, STEP = 128, 122
WIDTHS = (3, 5, 6)
FILTERS = 16
EMBEDDING = 8
#: Positions between two applications of a filter.
STRIDE = 2
#: Most training windows drawn from one language: the bound of what the driver gathers.
PER_LANGUAGE = 2000
#: Characters of a training text, from a hashed place on, that are looked at: the bound of its size.
SAMPLE_BYTES = 2048
SPACE = 32
UNDETERMINED = "und"


def windows(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all texts (n, LENGTH) as bytes, padded with spaces, and the number of the text of each."""
    counts = np.array([max(1, -(-(len(t) - (LENGTH - STEP)) // STEP)) for t in texts], dtype=np.int64)
    ends = np.cumsum(np.array([len(t) for t in texts], dtype=np.int64) + LENGTH)
    starts = ends - np.array([len(t) for t in texts], dtype=np.int64) - LENGTH
    pad = b" " * LENGTH
    flat = np.frombuffer(b"".join([x for t in texts for x in (t, pad)]), dtype=np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[owner] + nth * STEP
    cut = np.lib.stride_tricks.sliding_window_view(flat, LENGTH)[at]
    # A window that reaches past the end of its text must not see the next one.
    last = ends[owner] - LENGTH - at
    short = np.flatnonzero(last < LENGTH)
    if len(short):
        rows = cut[short]
        rows[np.arange(LENGTH)[None, :] >= last[short][:, None]] = SPACE
        cut[short] = rows
    return cut, owner


class ByteNetwork:
    """Embedding (256, E), filters (max width x E, filters) with zeros beyond a filter's width, softmax weights."""

    def __init__(self, languages: Sequence[str], seed: int = 7):
        random = np.random.default_rng(seed)
        self.languages, span, n = list(languages), max(WIDTHS), FILTERS * len(WIDTHS)
        self.embedding = random.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.mask = np.concatenate([np.repeat((np.arange(span) < w).astype(np.float32), EMBEDDING)[:, None].repeat(FILTERS, 1) for w in WIDTHS], axis=1)
        self.filters = (random.normal(0, 1 / np.sqrt(EMBEDDING * 4), (span * EMBEDDING, n)).astype(np.float32)) * self.mask
        self.bias = np.zeros(n, np.float32)
        self.out = random.normal(0, 0.1, (n, len(self.languages))).astype(np.float32)
        self.out_bias = np.zeros(len(self.languages), np.float32)

    def _columns(self, cut: np.ndarray) -> np.ndarray:
        """(rows, positions, width x E): the embedded bytes under the filters at each position."""
        embedded = self.embedding[cut]
        n, length, size = embedded.shape
        flat = embedded.reshape(n, length * size)
        return np.lib.stride_tricks.sliding_window_view(flat, max(WIDTHS) * size, axis=1)[:, :: STRIDE * size]

    def pooled(self, cut: np.ndarray) -> np.ndarray:
        columns = self._columns(cut)
        n, positions, width = columns.shape
        made = np.ascontiguousarray(columns).reshape(n * positions, width) @ self.filters
        return np.maximum(made.reshape(n, positions, -1).max(axis=1) + self.bias, 0)

    def log_probabilities(self, cut: np.ndarray, batch: int = 512) -> np.ndarray:
        out = np.empty((len(cut), len(self.languages)), np.float32)
        for i in range(0, len(cut), batch):
            logits = self.pooled(cut[i : i + batch]) @ self.out + self.out_bias
            logits -= logits.max(axis=1, keepdims=True)
            out[i : i + batch] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return out

    def train(self, cut: np.ndarray, label: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.004, seed: int = 7) -> None:
        """Adam on the cross entropy; rows of rarer languages weigh more."""
        random = np.random.default_rng(seed)
        weight = (len(label) / np.maximum(np.bincount(label, minlength=len(self.languages)), 1) / len(self.languages)).astype(np.float32)[label]
        names = ("embedding", "filters", "bias", "out", "out_bias")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        for _ in range(epochs):
            order = random.permutation(len(label))
            for i in range(0, len(order), batch):
                rows = order[i : i + batch]
                x = cut[rows]
                columns = np.ascontiguousarray(self._columns(x))
                n, positions, width = columns.shape
                made = (columns.reshape(-1, width) @ self.filters).reshape(n, positions, -1)
                where = made.argmax(axis=1)
                peak = np.take_along_axis(made, where[:, None, :], 1)[:, 0] + self.bias
                pooled = np.maximum(peak, 0)
                logits = pooled @ self.out + self.out_bias
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(n), label[rows]] -= 1
                p *= weight[rows][:, None] / n
                back = (p @ self.out.T) * (peak > 0)
                grads = {"out": pooled.T @ p, "out_bias": p.sum(axis=0), "bias": back.sum(axis=0)}
                # Only the position that won the pooling passes the gradient on.
                won = columns[np.arange(n)[:, None], where]  # (n, filters, width)
                grads["filters"] = np.einsum("nf,nfw->wf", back, won, optimize=True) * self.mask
                into = (back[:, :, None] * self.filters.T[None]).reshape(n, -1, max(WIDTHS), EMBEDDING)
                at = where[:, :, None] * STRIDE + np.arange(max(WIDTHS))
                seen = x[np.arange(n)[:, None, None], at]
                grads["embedding"] = np.zeros_like(self.embedding)
                np.add.at(grads["embedding"], seen.ravel(), into.reshape(-1, EMBEDDING))
                step += 1
                for k in names:
                    first[k] += 0.1 * (grads[k] - first[k])
                    second[k] += 0.001 * (grads[k] ** 2 - second[k])
                    move = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - move).astype(np.float32))


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE) -> ByteNetwork:
    """Train on texts with a non-null lang outside the held-out fold.

    A bounded sample is gathered: of each language the ``per_language`` / 2 texts with the smallest hash, SAMPLE_BYTES
    characters of each, from which at most ``per_language`` windows are drawn. Without any labelled text the network
    knows no language.
    """
    rows = documents.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = sorted((r[0], r[1]) for r in rows.groupBy("lang").count().collect())
    languages = [c[0] for c in counts]
    network = ByteNetwork(languages)
    if not languages:
        return network
    # A hash picks about three times the texts wanted, so that few are sorted; then the exact number is taken.
    goal, cells = per_language // 2, 1_000_000
    share = F.element_at(F.create_map(*[F.lit(x) for name, n in counts for x in (name, min(cells, -(-3 * goal * cells // n)))]), F.col("lang"))
    hashed = F.xxhash64(F.col("doc_id").cast("string"), F.lit(17))
    place = (F.pmod(hashed, F.greatest(F.length("text") - SAMPLE_BYTES, F.lit(0)) + 1) + 1).cast("int")
    few = rows.where(F.pmod(hashed, F.lit(cells)) < share).select("lang", hashed.alias("h"), F.substring(F.col("text"), place, F.lit(SAMPLE_BYTES)).alias("t"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))
    drawn = few.where(F.col("t").rlike(r"\p{L}")).withColumn("n", rank).where(F.col("n") <= goal).orderBy("lang", "n").collect()
    texts = [r["t"].encode() for r in drawn]
    labels = [languages.index(r["lang"]) for r in drawn]
    if not texts:
        return network
    cut, owner = windows(texts)
    label = np.array(labels, dtype=np.int64)[owner]
    letters = (np.char.isalpha(cut.view("S1")).reshape(cut.shape) | (cut >= 128)).sum(axis=1)
    random = np.random.default_rng(3)
    chosen = []
    for number in range(len(languages)):
        own = np.flatnonzero((label == number) & (letters >= 8))
        own = own if len(own) else np.flatnonzero(label == number)
        chosen.append(random.permutation(own)[:per_language])
    chosen = np.concatenate(chosen)
    cut, label = cut[chosen], label[chosen]
    # Short texts are met too: every fourth training window keeps only a part of its bytes.
    cut = cut.copy()
    for i in range(0, len(cut), 4):
        cut[i, int(random.integers(8, LENGTH)) :] = SPACE
    network.train(cut, label)
    return network


def predict(documents: DataFrame, network: ByteNetwork, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Add lang_pred and score to the columns ``keep``; kept columns with these names are replaced.

    Texts that are null, empty or without any letter get ``und`` with score 0; so does every text if no language is
    known. Ties go to the language that sorts first. Windows count by their number of letters.
    """
    shared = documents.sparkSession.sparkContext.broadcast(network)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def make():
        model = shared.value
        letter = np.zeros(256, np.uint8)
        letter[[b for b in range(256) if b >= 128 or chr(b).isalpha()]] = 1

        def some(texts: list[bytes]) -> list[tuple[str, float]]:
            cut, owner = windows(texts)
            logs = model.log_probabilities(cut).astype(np.float64)
            weight = letter[cut].sum(axis=1).astype(np.float64) + 1e-9
            total = np.zeros((len(texts), len(model.languages)))
            np.add.at(total, owner, logs * weight[:, None])
            total /= np.bincount(owner, weight, len(texts))[:, None]
            total = np.exp(total - total.max(axis=1, keepdims=True))
            total /= total.sum(axis=1, keepdims=True)
            best = total.argmax(axis=1)
            return [(model.languages[b], float(total[i, b])) for i, b in enumerate(best)]

        def work(texts):
            # Only texts beyond ASCII need the slower test for letters.
            lettered = [i for i, t in enumerate(texts) if t and (any(map(bytes.isalpha, (t[j : j + 1] for j in range(min(len(t), 64))))) or any(c.isalpha() for c in t.decode(errors="replace")))]
            out = [[UNDETERMINED] * len(texts), [0.0] * len(texts)]
            group, size = [], 0
            if not model.languages:
                return out
            for place, i in enumerate(lettered):
                group.append(i)
                size += len(texts[i])
                if size >= 1_000_000 or place == len(lettered) - 1:
                    for j, (language, score) in zip(group, some([texts[j] for j in group])):
                        out[0][j], out[1][j] = language, score
                    group, size = [], 0
            return out

        return work

    return map_text(documents, keep, "text", fields, make)


def identify(documents: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Train on ``documents`` and predict all of them: the columns ``keep``, held_out, lang_pred and score."""
    network = fit(documents)
    fold = documents.withColumn("held_out", held_out())
    return predict(fold, network, [*keep, "held_out"])
