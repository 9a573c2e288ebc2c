"""Spans in text as (kind, start, end), in code points, end exclusive; and their digests."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterable, Sequence

Span = tuple[str, int, int]


def listed(spans: Sequence[Span], kinds: Sequence[str]) -> str:
    """kind:start:end by start, then kind as listed, joined by commas."""
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Cover:
    """What some spans cover together, so that each look-up is one bisection."""

    def __init__(self, spans: Iterable[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def overlaps(self, a: int, b: int) -> bool:
        k = bisect.bisect_right(self.ends, a)
        return k < len(self.starts) and self.starts[k] < b
