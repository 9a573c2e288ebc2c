"""Operator 2: quality scores from supervised subword embeddings.

A document is the mean of learned vectors of its words and their character n-grams, hashed into a
fixed number of buckets; a softmax over two labels follows. Training is stochastic gradient descent
in numpy on a bounded sample. After training the score of a document depends only on the mean of
its features' projections, so executors keep one number for each word.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import partial
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import Memory, emit, hold, id_and_text, slices, texts_of
from blockloom.llm.language import held_out

OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
#: The word bigram of a word and itself is one feature for all words, so that stutter is learned as such; it
#: counts as often as a usual word has features.
SAME = "\0same"
SAME_WEIGHT = 8


def stutters(words: list[str]) -> int:
    return sum(map(eq, words, words[1:]))


def features(word: str, buckets: int, sizes: tuple[int, ...]) -> list[int]:
    """Buckets of a word and of its character n-grams. Case and marks stay: they tell quality."""
    w = f"<{word}>"
    parts = [w, *(w[i : i + n] for n in sizes for i in range(len(w) - n + 1) if n < len(w))]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % buckets for p in parts]


@dataclass
class Model:
    """projection: each bucket's embedding times the difference of the two output rows."""

    projection: np.ndarray
    bias: float
    sizes: tuple[int, ...]


class Words:
    """A word's sum of projections, and its number of features as the imaginary part.

    What n-grams that start a window of the longest size add is remembered: texts hold far fewer windows
    than words, so a word that is new or was forgotten costs a look-up a character and one hash.
    """

    def __init__(self, model: Model):
        self.values, self.sizes, self.longest = model.projection.tolist(), model.sizes, max(model.sizes, default=0)
        self.starts = Memory(self._start, 16 << 20)

    def _value(self, part: str) -> float:
        return self.values[zlib.crc32(part.encode("utf-8", "surrogatepass")) % len(self.values)]

    def _start(self, window: str) -> float:
        return sum(self._value(window[:n]) for n in self.sizes if n <= len(window))

    def __call__(self, word: str) -> complex:
        w, longest = f"<{word}>", self.longest
        if len(w) <= longest:  # an n-gram as long as the word is the word
            f = features(word, len(self.values), self.sizes)
            return complex(sum(self.values[k] for k in f), len(f))
        total = sum(map(self.starts.__getitem__, (w[i : i + longest] for i in range(len(w)))), self._value(w))
        return complex(total, 1 + sum(len(w) - n + 1 for n in self.sizes))


def fit(rows: list[tuple[str, int]], buckets: int = 1 << 15, dim: int = 12, sizes: tuple[int, ...] = (2, 3), epochs: int = 6, rate: float = 0.6, seed: int = 3) -> Model:
    """Stochastic gradient descent, one document a step, with a falling rate."""
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    memory: dict[str, list[int]] = {}
    bags = []
    for text, label in rows:
        bag: list[int] = []
        words = text.split()
        for w in words:
            if w not in memory:
                memory[w] = features(w, buckets, sizes)
            bag += memory[w]
        bag += features(SAME, buckets, ())[:1] * (SAME_WEIGHT * stutters(words))
        if bag:
            ids, n = np.unique(np.array(bag), return_counts=True)
            bags.append((ids, (n / n.sum()).astype(np.float32)[:, None], label))
    steps, k = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, share, label = bags[i]
            now = rate * (1 - k / steps)
            hidden = (embed[ids] * share).sum(0)
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ out
            out -= now * np.outer(p, hidden)
            bias -= now * 0.1 * p
            # a document's few thousand features share its gradient: step as for one feature each
            embed[ids] -= now * np.sqrt(len(ids)) * share * back
            k += 1
    return Model(embed @ (out[1] - out[0]), float(bias[1] - bias[0]), sizes)


_MEMORY: dict[str, tuple[Model, Memory]] = {}


def _score(shared, key: str, batches):
    hold("quality", _MEMORY.clear)
    if key not in _MEMORY:
        _MEMORY.clear()
        _MEMORY[key] = shared.value, Memory(Words(shared.value))
    model, words = _MEMORY[key]
    same = SAME_WEIGHT * complex(model.projection[features(SAME, len(model.projection), ())[0]], 1)
    for b in slices(batches):
        split = [t.split() for t in texts_of(b)]
        sums = [sum(map(words.__getitem__, w), 0j) + same * stutters(w) for w in split]
        z = np.array([s.real / max(s.imag, 1) for s in sums]) + model.bias
        yield emit(OUT, doc_id=b.column("doc_id"), score=1 / (1 + np.exp(-np.clip(z, -500, 500))))


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: doc_id, score (0 to 1; higher: label 1 likelier).

    One scan, no shuffle; the broadcast model is one number for each bucket. Null or empty text has no
    features and gets the score of the bias alone. Repeated rows are scored each; other columns are not
    looked at. Empty table: empty result.
    """
    spark = docs.sparkSession
    key = f"{spark.sparkContext.applicationId}-{zlib.crc32(model.projection.tobytes())}-{model.bias}"
    return id_and_text(docs, id_col, text_col).mapInArrow(partial(_score, spark.sparkContext.broadcast(model), key), "doc_id long, score double")


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: int, label_col: str = "quality") -> list[tuple[str, int]]:
    """At most max_rows labelled texts whose crc32(doc_id) mod 5 is not 0: those of smallest hash, so the same each time."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(5, 0))
    # at most max_rows ids: a broadcast of known size, so texts don't move
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(max_rows)
    rows = id_and_text(docs).join(F.broadcast(chosen), "doc_id").filter(F.col("text").isNotNull()).select("doc_id", "text", "label")
    # ids may be repeated: the bound holds for rows too
    rows = rows.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id", "label", "text").limit(max_rows).collect()
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["label"], r["text"]))]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4000) -> Model:
    rows = training_sample(docs, labels, max_rows)
    return fit(rows) if rows else Model(np.zeros(2, np.float32), 0.0, (2, 3))
