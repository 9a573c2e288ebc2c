"""Byte-level BPE on ragged numpy arrays.

Many pre-tokens are held in one flat symbol array. In each round every pre-token's
lowest-ranked adjacent pair is merged at all its places at once; pre-tokens without a
mergeable pair leave the array. What is left are the token ids.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import sys
import unicodedata

import numpy as np

from blockloom.llm.common import hold

#: The pre-tokenizer of byte-level BPE, with Unicode's White_Space property written out.
SPACE = r"\t-\r \x85\xa0  -     　"
PRETOKEN = " ?[{L}]+| ?[{N}]+|'(?:[stmd]|re|ve|ll)| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
#: Bytes of pre-tokens and ids that a worker remembers before it forgets those that its last texts did not hold.
CACHE_BYTES = 48 << 20
#: Pre-tokens merged at once: few enough for their arrays to stay in a core's cache.
AT_ONCE = 8000


def _category_ranges(letter: str, top: int) -> str:
    """A regex class body of all code points up to top whose general category starts with letter."""
    runs, start = [], None
    for c in range(top + 2):
        inside = c <= top and unicodedata.category(chr(c))[0] == letter
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            runs.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(runs)


@functools.cache
def pretoken_pattern(top: int = sys.maxunicode) -> re.Pattern:
    """For texts of code points up to top: within the first plane, classes are one table look-up."""
    return re.compile(PRETOKEN.format(S=SPACE, L=_category_ranges("L", top), N=_category_ranges("N", top)))


def pretokens(text: str) -> list[str]:
    top = 0xFF if text.isascii() else 0xFFFF if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else sys.maxunicode
    return pretoken_pattern(top).findall(text)


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free one from 256."""
    free, out = 256, []
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class RankMerger:
    """A vocabulary file's merges as arrays, and the encoder over them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.byte_ids = np.array([vocab[s] for s in _byte_symbols()], np.int32)
        self.base = max(vocab.values()) + 1
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made[order]
        added = spec.get("added_tokens") or []
        grid = np.ix_(self.byte_ids.astype(np.int64), self.byte_ids)[0] * self.base + self.byte_ids
        self.first_rank, self.first_made = (x.reshape(256, 256) for x in self._look_up(grid.ravel()))
        self.special = {t["content"]: t["id"] for t in added}
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if added else None

    def _look_up(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (len(keys) if there is no such merge) and product of symbol pairs."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], np.int32(len(self.keys))), self.made[at]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each word's ids begin (one more entry at the end)."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        none = len(self.keys)
        symbols, owner = self.byte_ids[data], np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
        rank, made = np.full(len(data), none, np.int32), np.zeros(len(data), np.int32)
        if len(data) > 1:
            rank[:-1], made[:-1] = self.first_rank[data[:-1], data[1:]], self.first_made[data[:-1], data[1:]]
            rank[np.cumsum(sizes)[sizes > 0] - 1] = none
        done: list[tuple] = []
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            counts = np.diff(np.append(starts, len(owner)))
            target = np.repeat(np.minimum.reduceat(rank, starts), counts)
            live = target < none
            if not live.all():  # words without a mergeable pair leave
                done.append((symbols[~live], owner[~live]))
                symbols, owner, rank, made, target = (x[live] for x in (symbols, owner, rank, made, target))
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == target)
            # in a run of hits that overlap (one symbol repeated) every second one merges, from the left
            run = np.maximum.accumulate(np.where(np.append(True, np.diff(hit) > 1), np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            symbols[hit] = made[hit]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            now = np.cumsum(keep) - 1
            symbols, owner, rank, made = (x[keep] for x in (symbols, owner, rank, made))
            # only pairs beside a merged symbol have changed
            hit = now[hit]
            near = np.concatenate([hit, hit[hit > 0] - 1])
            rank[near] = none
            near = near[near < len(symbols) - 1]
            near = near[owner[near] == owner[near + 1]]
            rank[near], made[near] = self._look_up(symbols[near].astype(np.int64) * self.base + symbols[near + 1])
        symbols, owner = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (symbols, owner)
        ids = symbols[np.argsort(owner, kind="stable")]  # a word's symbols leave together, in order
        return ids, np.append(0, np.cumsum(np.bincount(owner, minlength=len(raw))))


class Rows(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Encoder:
    """Encodes whole texts; pre-tokens seen before come from a bounded memory: a row of ids for each."""

    def __init__(self, path: str):
        self.merger = RankMerger(path)
        special = self.merger.special
        self.always = len(special)  # rows that are never forgotten: the special strings, under keys of their own
        self.row = Rows(zip(map("\0special".__add__, special), range(len(special)), strict=True))
        self.flat, self.starts, self.held = np.array(list(special.values()), "<u4"), np.arange(len(special) + 1), 0

    def _parts(self, text: str) -> list[str]:
        """Pre-tokens of a text; a special string stands as it is, under its own key."""
        special = self.merger.special_at
        if special is None or not special.search(text):
            return pretokens(text)
        out, end = [], 0
        for m in special.finditer(text):
            out += pretokens(text[end : m.start()])
            out.append("\0special" + m[0])
            end = m.end()
        return out + pretokens(text[end:])

    def _learn(self, known: int) -> None:
        """Add the ids of the pre-tokens whose rows are known and up."""
        new = list(itertools.islice(self.row, known, None))
        ids, starts = [self.flat], [self.starts]
        for i in range(0, len(new), AT_ONCE):
            made, at = self.merger.merge(new[i : i + AT_ONCE])
            ids.append(made.astype("<u4"))
            starts.append(starts[-1][-1] + at[1:])
        self.flat, self.starts = np.concatenate(ids), np.concatenate(starts)
        self.held += 4 * sum(map(len, ids[1:])) + 150 * len(new) + sum(map(sys.getsizeof, new))

    def _look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all texts' pre-tokens, and where each text's begin (one more entry at the end)."""
        parts = [self._parts(t) for t in texts]
        ends = np.cumsum([0, *map(len, parts)])
        known = len(self.row)
        rows = np.fromiter(map(self.row.__getitem__, itertools.chain.from_iterable(parts)), np.int64, ends[-1])
        if len(self.row) > known:
            self._learn(known)
        return rows, ends

    def _ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows, one after the other, and where each row's begin (one more entry at the end)."""
        first = self.starts[rows]
        n = self.starts[rows + 1] - first
        ends = np.append(0, np.cumsum(n))
        return self.flat[np.arange(ends[-1]) + np.repeat(first - ends[:-1], n)], ends

    def _forget(self, rows: np.ndarray) -> None:
        """Once the memory is full, all but these rows go; they too, if they fill half of it."""
        if self.held <= CACHE_BYTES:
            return
        words, always = list(self.row), np.arange(self.always)
        stay = np.union1d(always, rows)
        size = 4 * int((self.starts[stay + 1] - self.starts[stay]).sum()) + 150 * len(stay) + sum(sys.getsizeof(words[k]) for k in stay.tolist())
        if size > CACHE_BYTES // 2:
            stay, size = always, 0
        self.flat, self.starts = self._ids(stay)
        self.row, self.held = Rows(zip(map(words.__getitem__, stay.tolist()), range(len(stay)), strict=True)), size

    def counts(self, texts: list[str]) -> list[int]:
        rows, ends = self._look_up(texts)
        total = np.append(0, np.cumsum(self.starts[rows + 1] - self.starts[rows]))
        self._forget(rows)
        return np.diff(total[ends]).tolist()

    def id_bytes(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        rows, ends = self._look_up(texts)
        ids, at = self._ids(rows)
        self._forget(rows)
        raw, cuts = ids.tobytes(), (4 * at[ends]).tolist()
        return [raw[a:b] for a, b in itertools.pairwise(cuts)]


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encoder(path: str) -> Encoder:
    """This worker's encoder."""
    hold("bpe", _encoder.cache_clear)
    return _encoder(path)
