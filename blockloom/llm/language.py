"""Operator 9: language identification by error-correcting output codes.

Each language has a codeword. One binary classifier for each bit, over hashed character n-grams,
predicts that bit for a text; the language whose codeword has the least loss against the
classifiers' margins wins. A text's margin is a mean over its n-grams, so a worker remembers each
word's sums and adds them up.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import emit, hold, id_and_text, slices, texts_of

OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text[64:]))


def word_grams(word: str, sizes: tuple[int, ...], buckets: int) -> list[int]:
    """Hashed character n-grams of a word with its borders."""
    w = f"<{word}>"
    return [zlib.crc32(w[i : i + n].encode("utf-8", "surrogatepass")) % buckets for n in sizes for i in range(len(w) - n + 1)]


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each class: all splits of up to 5 classes in two, else random columns kept far apart."""
    if classes <= 1:
        return np.ones((classes, 1), np.int8)
    if classes <= 5:
        columns = [[1] + [1 if s >> k & 1 else -1 for k in range(classes - 1)] for s in range(2 ** (classes - 1) - 1)]
        return np.array(columns, np.int8).T
    bits = int(np.ceil(10 * np.log2(classes)))
    best, apart = None, -1
    for rng in map(np.random.default_rng, range(seed, seed + 50)):
        m = rng.choice(np.array([-1, 1], np.int8), (classes, bits))
        m = m[:, np.abs(m.sum(0)) < classes]
        gap = min((m[a] != m[b]).sum() for a in range(classes) for b in range(a))
        if gap > apart:
            best, apart = m, gap
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # classes x bits
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    sizes: tuple[int, ...]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, confidence and the gap to the second, by logistic loss against each codeword."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).sum(2)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        top = np.sort(p, 1)
        return loss.argmin(1), top[:, -1], top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)


class Words:
    """Sums of words' n-gram weights, and the n-grams' numbers.

    What n-grams that start a window of the longest size add is remembered: texts hold far fewer windows
    than words, so a word that is new or was forgotten costs a look-up a character and no hash.
    """

    def __init__(self, model: Model, most_bytes: int = 16 << 20, most_starts: int = 1 << 16):
        self.model, self.row, self.longest = model, {}, max(model.sizes, default=1)
        self.most_bytes, self.most_starts, self.held = most_bytes, most_starts, 0
        self.table = np.zeros((1024, model.weights.shape[1] + 1), np.float32)

    def _start(self, window: str) -> np.ndarray:
        weights = self.model.weights
        grams = [zlib.crc32(window[:n].encode("utf-8", "surrogatepass")) % len(weights) for n in self.model.sizes if n <= len(window)]
        return np.append(weights[grams].sum(0), len(grams))

    def _learn(self, windows: set[str]) -> None:
        new = windows.difference(self.row)
        entry = 200 + 2 * self.table[0].nbytes
        if self.row and self.held + entry * len(new) > self.most_bytes:
            self.row, self.held, new = {}, 0, windows
            self.table = self.table[:1024].copy()
        self.held += entry * len(new)
        self.table = enlarged(self.table, len(self.row), len(self.row) + len(new))
        for w in new:
            self.table[len(self.row)] = self._start(w)
            self.row[w] = len(self.row)

    def _pieces(self, words: list[str]) -> Iterator[list[tuple[int, str, int]]]:
        """Lists of (word number, part of the word with its borders, windows that start in it), of about most_starts windows each."""
        some, starts = [], 0
        for k, word in enumerate(words):
            w = f"<{word}>"
            for i in range(0, len(w), self.most_starts):
                n = min(self.most_starts, len(w) - i)
                some.append((k, w[i : i + n + self.longest - 1], n))
                starts += n
                if starts >= self.most_starts:
                    yield some
                    some, starts = [], 0
        if some:
            yield some

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.table.shape[1]))
        longest = self.longest
        for some in self._pieces(words):
            owner, _, counts = zip(*some, strict=True)
            windows = [w[i : i + longest] for _, w, n in some for i in range(n)]
            self._learn(set(windows))
            rows = np.fromiter(map(self.row.__getitem__, windows), np.int64, len(windows))
            sums = np.add.reduceat(self.table[rows], np.append(0, np.cumsum(counts)[:-1]), axis=0, dtype=np.float64)
            np.add.at(out, np.array(owner), sums)
        return out


def enlarged(table: np.ndarray, used: int, need: int) -> np.ndarray:
    """The table, or one of at least need rows that begins with its used ones."""
    if need <= len(table):
        return table
    grown = np.zeros((max(need, len(table) * 3 // 2), table.shape[1]), table.dtype)
    grown[:used] = table[:used]
    return grown


class Scorer:
    """Margins of whole texts from a memory of words that is bounded in bytes."""

    def __init__(self, model: Model, most_bytes: int = 48 << 20):
        self.model, self.row, self.most_bytes, self.held, self.words = model, {}, most_bytes, 0, Words(model)
        self.table = np.zeros((1024, model.weights.shape[1] + 1), np.float32)

    def _learn(self, words: set[str]) -> None:
        new = words.difference(self.row)
        size = sum(map(sys.getsizeof, new)) + len(new) * (100 + 2 * self.table[0].nbytes)
        if self.row and self.held + size > self.most_bytes:
            self.row, new = {}, words
            self.table = self.table[:1024].copy()
            size = sum(map(sys.getsizeof, new)) + len(new) * (100 + 2 * self.table[0].nbytes)
            self.held = 0
        self.held += size
        first, need = len(self.row), len(self.row) + len(new)
        self.table = enlarged(self.table, first, need)
        new = list(new)
        self.table[first:need] = self.words(new)
        self.row.update(zip(new, range(first, need), strict=True))

    def margins(self, texts: list[str]) -> np.ndarray:
        words = [t.lower().split() for t in texts]
        self._learn(set().union(*words))
        counts = np.array([len(w) for w in words])
        rows = np.fromiter(map(self.row.__getitem__, chain.from_iterable(words)), np.int64, counts.sum())
        sums = np.zeros((len(texts), self.table.shape[1]))
        full = np.flatnonzero(counts)
        if len(full):
            sums[full] = np.add.reduceat(self.table[rows], np.append(0, np.cumsum(counts[full])[:-1]), axis=0, dtype=np.float64)
        return sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.model.bias


def fit(rows: list[tuple[str, str]], buckets: int = 1 << 13, sizes: tuple[int, ...] = (1, 2, 3), rounds: int = 120, decay: float = 1e-4) -> Model:
    """Train on (text, language) rows: all bits' logistic regressions at once, on scaled n-gram frequencies."""
    languages = sorted({lang for _, lang in rows})
    code = codewords(len(languages))
    x = np.zeros((len(rows), buckets), np.float32)
    memory: dict[str, list[int]] = {}
    for k, (text, _) in enumerate(rows):
        grams: list[int] = []
        for w in text.lower().split():
            if w not in memory:
                memory[w] = word_grams(w, sizes, buckets)
            grams += memory[w]
        if grams:
            x[k] = np.bincount(grams, minlength=buckets) / len(grams)
    scale = 1 / (np.sqrt((x**2).mean(0)) + 1e-4)
    x *= scale / np.sqrt(buckets)
    number = {lang: k for k, lang in enumerate(languages)}
    y = np.array([number[lang] for _, lang in rows])
    target = code[y].astype(np.float32)
    share = 1 / np.bincount(y)[y]  # each language weighs the same
    share = (share / share.sum()).astype(np.float32)[:, None]
    w, b = np.zeros((buckets, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    step_w, step_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        g = -target * share / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30)))
        step_w = 0.9 * step_w - 4.0 * (x.T @ g + decay * w)
        step_b = 0.9 * step_b - 1.0 * g.sum(0)
        w, b = w + step_w, b + step_b
    return Model(languages, code, w * (scale / np.sqrt(buckets))[:, None], b, sizes)


def training_sample(docs: DataFrame, learn, rows_per_language: int, lang_col: str = "lang", max_languages: int = 1000) -> list[tuple[str, str]]:
    """At most rows_per_language whole texts of each of the max_languages most frequent languages, the same ones each time."""
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col("text").isNotNull())
    common = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(max_languages)
    counts = {r["lang"]: r["n"] for r in common.collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.5 * (rows_per_language + 20) / n))])
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    found = rows.select("text", F.col(lang_col).alias("lang"), draw.alias("draw")).filter(F.col("draw") < share[F.col("lang")])
    # rows that repeat one text share its draw: a second bound, on all of them together
    found = found.orderBy("draw", "text", "lang").limit(2 * (rows_per_language + 20) * len(counts))
    taken: dict[str, int] = {}
    out = []
    for r in sorted(found.collect(), key=lambda r: (r["draw"], r["text"], r["lang"])):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= rows_per_language:
            out.append((r["text"], r["lang"]))
    return out


def held_out(remainder_of: int, is_: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(remainder_of)) == is_


_SCORERS: dict[str, Scorer] = {}


def _predict(shared, key: str, unsure: float, batches):
    hold("language", _SCORERS.clear)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(shared.value)
    scorer = _SCORERS[key]
    for b in slices(batches):
        texts = texts_of(b)
        letters = np.array([has_letter(t) for t in texts], bool) & bool(scorer.model.languages)
        lang, score, ambiguous = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        some = np.flatnonzero(letters)
        if len(some):
            best, top, gap = scorer.model.decode(scorer.margins([texts[i] for i in some]))
            for i, k in zip(some.tolist(), best.tolist(), strict=True):
                lang[i] = scorer.model.languages[k]
            score[some], ambiguous[some] = top, gap < unsure
        yield emit(OUT, doc_id=b.column("doc_id"), lang_pred=lang, score=score, ambiguous=ambiguous)


def predict_language(docs: DataFrame, model: Model, unsure: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text: doc_id, lang_pred, score (0 to 1), ambiguous (the second language is close).

    One scan, no shuffle; the broadcast model has a fixed size for each language. Null text, or one
    without a letter: lang_pred "und", score 0. Repeated rows are predicted each; other columns are not
    looked at. Without any training row every text is "und". Empty table: empty result.
    """
    spark = docs.sparkSession
    key = f"{spark.sparkContext.applicationId}-{zlib.crc32(model.weights.tobytes())}-{len(model.languages)}"
    return id_and_text(docs, id_col, text_col).mapInArrow(partial(_predict, spark.sparkContext.broadcast(model), key, unsure), "doc_id long, lang_pred string, score double, ambiguous boolean")


def train(docs: DataFrame, rows_per_language: int = 300, lang_col: str = "lang") -> Model:
    """Fit on a bounded sample of rows whose crc32(doc_id) mod 4 is not 2."""
    rows = id_and_text(docs).withColumn("held", held_out(4, 2)) if lang_col not in docs.columns else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(lang_col).alias("lang")).withColumn("held", held_out(4, 2))
    sample = training_sample(rows, ~F.col("held"), rows_per_language) if lang_col in docs.columns else []
    return fit(sample) if sample else Model([], np.ones((0, 1), np.int8), np.zeros((2, 1), np.float32), np.zeros(1, np.float32), (1, 2, 3))
