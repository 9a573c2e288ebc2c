"""Operator 10: benchmark decontamination with an FM-index for each shard of the corpus.

A task gathers documents into shards of some 100,000 words, indexes each shard and searches all
benchmark windows in it at once. Words become symbols of the benchmark's vocabulary; any other
word ends a run, because no window holds it. Runs are the strings of the index: each has an end
mark of its own, ordered by place, so every suffix is unique and walking backwards is exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import LOWER_AZ, discard, hold, id_and_text, slices, store

#: Bytes that are no part of a word become blanks; A-Z become a-z. The rest is as it is.
WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 32 for b in LOWER_AZ)
SPAN = "array<struct<start: int, end: int>>"
OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text", pa.string()),
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


@dataclass
class Windows:
    """Distinct windows as symbol rows, with the items that hold them."""

    vocabulary: dict[bytes, int]
    symbols: np.ndarray  # a row for each window, 0 beyond its length
    lengths: np.ndarray
    item_at: np.ndarray  # items of window w: items[item_at[w]:item_at[w + 1]]
    items: np.ndarray
    names: list[str]

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]], size: int) -> Windows:
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        names = sorted({str(i) for i, _ in rows})
        number = {n: k for k, n in enumerate(names)}
        for item, text in rows:
            codes = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text or "")]
            for k in range(max(1, len(codes) - size + 1) if codes else 0):
                found.setdefault(tuple(codes[k : k + size]), set()).add(number[str(item)])
        symbols = np.zeros((len(found), size), np.int32)
        for k, w in enumerate(found):
            symbols[k, : len(w)] = w
        counts = [len(v) for v in found.values()]
        items = [i for v in found.values() for i in sorted(v)]
        return cls(vocabulary, symbols, (symbols > 0).sum(1), np.append(0, np.cumsum(counts, dtype=np.int64)), np.array(items, np.int64), names)


def suffix_array(code: np.ndarray, end: np.ndarray, bits: int) -> np.ndarray:
    """Order of all suffixes, each up to its run's end mark (code 0) at end; marks come first, by place.

    Prefix doubling from as many symbols as fit 62 bits; only suffixes that still tie are sorted again.
    """
    n = len(code)
    marks = np.flatnonzero(code == 0)
    h = max(1, 62 // bits)
    key = code.astype(np.int64)
    at = np.arange(n)
    for k in range(1, h):
        there = at + k
        key = (key << bits) | np.where(there < end, code[np.minimum(there, n - 1)], 0)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.append(True, sorted_key[1:] != sorted_key[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    order[: len(marks)], rank[marks] = marks, np.arange(len(marks))
    size = np.bincount(rank, minlength=n)
    tied = order[size[rank[order]] > 1]
    while len(tied):
        group = rank[tied]
        next_ = rank[np.minimum(tied + h, end[tied])]
        by = np.argsort(group * n + next_, kind="stable")
        tied, group, next_ = tied[by], group[by], next_[by]
        i = np.arange(len(tied))
        group_new = np.append(True, group[1:] != group[:-1])
        part_new = group_new | np.append(True, next_[1:] != next_[:-1])
        group_start = np.maximum.accumulate(np.where(group_new, i, 0))
        part_start = np.maximum.accumulate(np.where(part_new, i, 0))
        order[group + i - group_start] = tied
        rank[tied] = group + part_start - group_start
        alone = part_new & np.append(part_new[1:], True)
        tied = tied[~alone]
        h *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence: one row of zero counts for each bit."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.zeros = bits, []
        for b in range(bits - 1, -1, -1):
            one = (sequence >> b) & 1 == 1
            self.zeros.append(np.append(0, np.cumsum(~one, dtype=np.int32)).astype(np.int32))
            sequence = np.concatenate([sequence[~one], sequence[one]])

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often each symbol stands before each place."""
        out = [np.zeros_like(places[0]), *places]
        for k, zeros in enumerate(self.zeros):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            out = [np.where(one, zeros[-1] + p - zeros[p], zeros[p]) for p in out]
        return [p - out[0] for p in out[1:]]

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for zeros in self.zeros:
            before = zeros[at]
            one = zeros[at + 1] == before
            symbol = symbol * 2 + one
            at = np.where(one, zeros[-1] + at - before, before)
        return symbol


class FMIndex:
    """Backward search and location over runs of symbols."""

    def __init__(self, code: np.ndarray, symbols: int, sample: int = 8):
        self.bits = max(1, int(symbols).bit_length())
        n = len(code)
        marks = np.flatnonzero(code == 0)
        end = marks[np.searchsorted(marks, np.arange(n))]
        order = suffix_array(code, end, self.bits)
        starts_run = np.append(True, code[:-1] == 0)
        before = np.where(starts_run[order], 0, code[order - 1])
        self.first = np.append(0, np.cumsum(np.bincount(code, minlength=symbols + 1)))
        self.tree = WaveletMatrix(before, self.bits)
        # each run's start is sampled too: no walk crosses an end mark
        self.sampled = (order % sample == 0) | starts_run[order]
        self.sample_at = np.append(0, np.cumsum(self.sampled))
        self.places = order[self.sampled]

    def search(self, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that occur, with their first and end rows."""
        alive = np.arange(len(windows.lengths))
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.first[-1], np.int64)
        for k in range(windows.symbols.shape[1] - 1, -1, -1):
            symbol = windows.symbols[alive, k].astype(np.int64)
            go = symbol > 0
            a, b = self.tree.rank(symbol[go], low[go], high[go])
            low[go], high[go] = self.first[symbol[go]] + a, self.first[symbol[go]] + b
            some = low < high
            alive, low, high = alive[some], low[some], high[some]
        return alive, low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows begin: walk back to a sampled one."""
        out, steps, open_ = np.zeros(len(row), np.int64), 0, np.arange(len(row))
        row = row.copy()
        while len(open_):
            here = self.sampled[row]
            out[open_[here]] = self.places[self.sample_at[row[here]]] + steps
            open_, row = open_[~here], row[~here]
            symbol = self.tree.access(row)
            row = self.first[symbol] + self.tree.rank(symbol, row)[0]
            steps += 1
        return out


def search_shard(codes: np.ndarray, breaks: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences in a shard as (window, first word). codes: 0 for words outside the vocabulary; breaks: documents' ends."""
    inside = codes > 0
    if not inside.any() or not len(windows.lengths):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.flatnonzero(inside)
    doc = np.searchsorted(breaks, place, side="right")
    run_ends = np.append((place[1:] != place[:-1] + 1) | (doc[1:] != doc[:-1]), True)
    at = np.arange(len(place)) + np.append(0, np.cumsum(run_ends)[:-1])
    code = np.zeros(at[-1] + 2, np.int64)
    code[at] = codes[place]
    back = np.zeros(len(code), np.int64)
    back[at] = place
    index = FMIndex(code, len(windows.vocabulary))
    alive, low, high = index.search(windows)
    counts = high - low
    rows = np.repeat(low - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())
    return np.repeat(alive, counts), back[index.locate(rows)]


def _finish(shard: list[tuple], windows: Windows) -> pa.RecordBatch:
    """Rows of a shard: (doc_id, text, codes, earlier spans, earlier items)."""
    sizes = np.array([len(r[2]) for r in shard], np.int64)
    stops = np.cumsum(sizes)
    window, place = search_shard(np.concatenate([r[2] for r in shard]), stops, windows)
    edge = np.zeros(int(stops[-1]) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + windows.lengths[window], -1)
    hit = np.cumsum(edge[:-1]) > 0
    for (_, _, _, spans, _), stop, size in zip(shard, stops.tolist(), sizes.tolist(), strict=True):
        for s in spans or ():
            hit[stop - size + s["start"] : stop - size + s["end"]] = True
    doc = np.searchsorted(stops, place, side="right")
    counts = windows.item_at[window + 1] - windows.item_at[window]
    pair = np.unique(np.stack([doc, window], 1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
    counts = windows.item_at[pair[:, 1] + 1] - windows.item_at[pair[:, 1]]
    flat = np.repeat(windows.item_at[pair[:, 1]] - np.append(0, np.cumsum(counts)[:-1])[: len(counts)], counts) + np.arange(counts.sum())
    items: dict[int, set[str]] = {}
    for d, i in zip(np.repeat(pair[:, 0], counts).tolist(), windows.items[flat].tolist(), strict=True):
        items.setdefault(d, set()).add(windows.names[i])
    all_spans: list[list] = []
    for stop, size in zip(stops.tolist(), sizes.tolist(), strict=True):
        own = hit[stop - size : stop]
        if not own.any():
            all_spans.append([])
            continue
        turn = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
        all_spans.append([{"start": a, "end": b} for a, b in turn.reshape(-1, 2).tolist()])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in shard], pa.int64()),
            pa.array([r[1] for r in shard], pa.string()),
            pa.array(sizes, pa.int64()),
            pa.array(all_spans, OUT.field("spans").type),
            pa.array([sorted(items.get(k, set()) | set(r[4] or ())) for k, r in enumerate(shard)], OUT.field("items").type),
        ],
        schema=OUT,
    )


def _pass(docs: DataFrame, rows: list[tuple], size: int, shard_words: int, keep_text: bool) -> DataFrame:
    windows = docs.sparkSession.sparkContext.broadcast(Windows.of(rows, size))

    def run(batches):
        hold("decontaminate")
        known = windows.value
        shard: list[tuple] = []
        n = 0
        for b in slices(batches):
            for row in b.to_pylist():
                words = words_of(row["text"] or "")
                codes = np.fromiter(map(known.vocabulary.get, words, repeat(0)), np.int64, len(words))
                shard.append((row["doc_id"], row["text"] if keep_text else None, codes, row["spans"], row["items"]))
                n += len(words)
                if n >= shard_words or len(shard) >= 5000:
                    yield _finish(shard, known)
                    shard, n = [], 0
        if shard:
            yield _finish(shard, known)

    return docs.mapInArrow(run, f"doc_id long, text string, n_words long, spans {SPAN}, items array<string>")


def _pieces(size: int, most_words: int, batches):
    """Items as texts of most_words words at most; of one that is longer, parts that share all but one word of a window."""
    for b in batches:
        item, text = [], []
        for name, raw in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
            words = words_of(raw or "")
            for at in range(0, max(1, len(words) - size + 1), most_words):
                item.append(name)
                text.append(b" ".join(words[at : at + most_words + size - 1]).decode())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(text, pa.string())], names=["item", "text"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = 200_000, block_words: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Find benchmark windows in documents: doc_id, n_words, spans (merged word ranges to remove), items (sorted as strings).

    The benchmark is searched in blocks of about block_words words, one broadcast and one pass over the
    documents for each; a block's size is what bounds a broadcast, and a longer item is cut into parts. One scan for each block, no shuffle.
    Null or empty text: no words, no spans. An item without words matches nothing; items with a null id are
    left out; items of equal id count once. Repeated rows are searched each; other columns are not looked
    at. Empty documents: empty result; empty benchmark: no hits.
    """
    items = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    items = store(items.mapInArrow(partial(_pieces, window, block_words), "item string, text string"), "items")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // (block_words * 5)) or 1
    out = id_and_text(docs, id_col, text_col).withColumns({"spans": F.lit(None).cast(SPAN), "items": F.lit(None).cast("array<string>")})
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        out = _pass(out, [(r["item"], r["text"]) for r in rows], window, shard_words, k + 1 < blocks)
    discard(items)
    return out.drop("text")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from contamination()."""
    n_hit: Column = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
