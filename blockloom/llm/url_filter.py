"""Operator 6: URL filtering by a trie over reversed host labels and path segments."""

from __future__ import annotations

import bisect
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import LOWER_AZ, emit, slices

SCHEMA = pa.schema([(n, pa.int64() if n == "page_id" else pa.string()) for n in ("page_id", "host", "path", "rule", "verdict")])
#: (verdict, host, path)
Rule = tuple[str, str, str]
_LOWER = {i: LOWER_AZ[i] for i in range(128)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; both empty without "://"."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, tail = rest[:end].translate(_LOWER), rest[end:]
    end = min((i for c in "?#" if (i := tail.find(c)) >= 0), default=len(tail))
    return host, tail[:end]


@dataclass
class Node:
    labels: dict[str, Node] = field(default_factory=dict)
    segments: dict[str, Node] = field(default_factory=dict)
    #: Rules whose path goes on inside the next segment, by what they ask of it, and the lengths of that, longest first.
    partial: dict[str, Rule] = field(default_factory=dict)
    sizes: list[int] = field(default_factory=list)

    def add(self, rest: str, rule: Rule) -> None:
        self.partial.setdefault(rest, rule)
        at = bisect.bisect_left(self.sizes, -len(rest), key=lambda n: -n)
        if at == len(self.sizes) or self.sizes[at] != len(rest):
            self.sizes.insert(at, len(rest))

    def inside(self, segment: str) -> Rule | None:
        """The rule that asks for the longest start of a segment: one look-up for each length that rules have."""
        for n in self.sizes:
            if n <= len(segment) and (rule := self.partial.get(segment[:n])):
                return rule
        return None


class RuleTrie:
    """Host labels from the right, then whole path segments; the last, unfinished segment of a rule is a prefix."""

    def __init__(self, rules: Sequence[Rule]):
        self.root = Node()
        for rule in rules:
            _, host, path = rule
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.labels.setdefault(label, Node())
            *whole, last = path.split("/")
            for segment in whole:
                node = node.segments.setdefault(segment, Node())
            node.add(last, rule)

    def longest(self, host: str, path: str) -> Rule | None:
        """The fitting rule with the longest host plus path; of equals the deeper host, then the one listed first."""
        best, length = None, -1
        node, labels = self.root, reversed(host.split("."))
        parts = path.split("/")
        while node is not None:
            at, depth = node, 0
            while at is not None and depth < len(parts):
                if rule := at.inside(parts[depth]):
                    size = len(rule[1]) + len(rule[2])
                    if size > length or size == length and len(rule[1]) > len(best[1]):
                        best, length = rule, size
                at = at.segments.get(parts[depth]) if depth + 1 < len(parts) else None
                depth += 1
            label = next(labels, None)
            node = None if label is None else node.labels.get(label)
        return best


def url_filter(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url", max_rules: int = 1_000_000, max_chars: int = 64 << 20) -> DataFrame:
    """Judge every URL: page_id, host, path, rule (host and path of the rule that wins, or null), verdict.

    The rule list is broadcast as one trie, so its length is checked against max_rules and its hosts and paths
    against max_chars; a larger list is refused and belongs into a join on host suffixes. One scan, no shuffle.
    Null URL or none with "://": empty host and path, which only a rule with empty host and path fits.
    Repeated rows are judged each; other columns of pages are not looked at. Empty table: empty result.
    """
    chars = sum(len(host) + len(path) for _, host, path in rules)
    if len(rules) > max_rules or chars > max_chars:
        raise ValueError(f"{len(rules)} rules of {chars} characters; the broadcast trie is bounded to {max_rules} and {max_chars}")
    trie = pages.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    def run(batches):
        for b in slices(batches, column="url"):
            rows = [split_url(u) for u in b.column("url").to_pylist()]
            found = [trie.value.longest(h, p) for h, p in rows]
            yield emit(SCHEMA, page_id=b.column("page_id"), host=[h for h, _ in rows], path=[p for _, p in rows], rule=[r and r[1] + r[2] for r in found], verdict=[r[0] if r else default for r in found])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
