"""Operator 3: secrets by patterns and by dictionary-primed zstandard novelty.

The patterns give the base spans. Beyond them, tokens near sensitive words are measured: how many
bytes does a candidate add to its compressed surroundings, with a dictionary of code and identifier
words to prime the compressor? Words and identifiers cost little; keys cost as much as they hold.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from blockloom.llm.common import emit, id_and_text, slices, texts_of
from blockloom.llm.spans import Cover, Span, digest, listed

#: The base patterns of the contract. Possessive runs and look-behinds keep long texts linear.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]++")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
KINDS = ("assign", "access", "hex", "novel")

#: Words that make a context sensitive, and what may be a secret there.
SENSITIVE = re.compile(r"(?i:passphrase|passwort|credential|bearer|authorization|private[_ -]?key|access[_ -]?key|signing[_ -]?key|client[_ -]?secret|password|passwd|secret|token|api[_-]?key|auth[_-]key)", re.A)
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=~$!-])[A-Za-z0-9+/_.=~$!-]{16,}+")
#: What is left of a name and its equals sign, and the parts of a run between equals signs, with their padding.
NAMED = re.compile(r"[^=]*+=++")
PART = re.compile(r"[^=]++=*+")
#: Characters of a candidate that are measured at once, and of the windows in longer ones: the length of a key.
PIECE, WINDOW = 4096, 32

#: Text that primes the compressor: what surrounds secrets, and what identifiers are made of.
DICTIONARY = b"""
if else elif for while return import from class def function const let var public private static void string int
true false null none self this new try catch except finally raise throw async await yield lambda with as in is not and or
config configuration settings environment variable default value example sample placeholder changeme your_key_here
username user name email host hostname port database server client connection session cookie header content type
application json text html charset utf-8 https http localhost www com org net example.com request response status
password passwd secret token api_key apikey access_key private_key client_secret authorization bearer credential
get set put post delete update create insert select where table index file path directory folder document number
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 1111111111111111 xxxxxxxxxxxxxxxx
the and ing tion ment able less ness ever under over inter trans super anti counter self auto multi micro
"""


@functools.cache
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(DICTIONARY, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(candidate: str, context: str) -> float:
    """Marginal compressed bytes of a candidate after its context, for each of its own bytes."""
    c, raw = _compressor(), candidate.encode()
    before = context.encode()
    return (len(c.compress(before + b"\n" + raw)) - len(c.compress(before))) / len(raw)


def base_spans(text: str) -> list[Span]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _mixed(word: str) -> bool:
    """Whether there are digits and letters enough for a key."""
    return not word.isalpha() and any(map(str.isdigit, word)) and len(set(word)) >= 8


def _judged(text: str, a: int, b: int, base: Cover, least: float) -> bool:
    """Whether a candidate has digits and letters and doesn't compress. Of one too long to be measured at once every piece
    is measured, then every window of the length of a key, as padding in a piece outweighs a key."""
    if b - a < 16 or base.overlaps(a, b) or not _mixed(text[a:b]):
        return False
    if b - a <= PIECE:
        return novelty(text[a:b], text[max(0, a - 256) : a]) >= least
    pieces = [(x, x + PIECE) for x in (*range(a, b - PIECE, PIECE), b - PIECE)]
    windows = ((x, x + WINDOW) for x in (*range(a, b - WINDOW, WINDOW // 4), b - WINDOW))
    return any(_mixed(text[x:y]) and novelty(text[x:y], text[max(0, x - 256) : x]) >= least for x, y in itertools.chain(pieces, windows))


def novel_spans(text: str, base: list[Span], reach: int = 48, least: float = 0.62) -> list[Span]:
    """Candidates within reach characters before or after a sensitive word, or after the equals sign of a name that holds
    one, that don't compress and have digits and letters. Where no such run does, its parts between equals signs may."""
    out: list[Span] = []
    cover = Cover(base)
    words = [m.span() for m in SENSITIVE.finditer(text)]
    w = 0
    for run in CANDIDATE.finditer(text) if words else ():
        a, b = run.span()
        while w < len(words) and words[w][1] < a - reach:
            w += 1
        if w == len(words):
            break
        behind = bisect.bisect_left(words, (b,))
        near = words[w][1] <= a or behind < len(words) and words[behind][0] - b <= reach
        inside = bisect.bisect_right(words, a, key=lambda s: s[1])
        named = inside < len(words) and words[inside][0] < b
        # of a name with its value, the value: all of it first, as it may hold equals signs itself
        value = NAMED.match(text, words[inside][1], b) if named else None
        wholes = ([(value.end(), b)] if value else []) + ([(a, b)] if near else [])
        found = next((s for s in wholes if _judged(text, *s, cover, least)), None)
        if found:
            out.append(("novel", *found))
        elif wholes:
            parts = [m.span() for m in PART.finditer(text, min(x for x, _ in wholes), b)]
            out += [("novel", *s) for s in parts if s not in wholes and _judged(text, *s, cover, least)]
    return out


OUT = pa.schema(
    [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())],
)


def _scan(batches):
    for b in slices(batches):
        rows = []
        for text in texts_of(b):
            base = base_spans(text)
            rows.append((base, base + novel_spans(text, base)))
        counts = {f"n_{k}": [sum(s[0] == k for s in every) for _, every in rows] for k in KINDS}
        yield emit(OUT, doc_id=b.column("doc_id"), **counts, base_sha256=[digest(listed(base, KINDS)) for base, _ in rows], spans=[listed(every, KINDS) for _, every in rows])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every whole text: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans.

    spans lists kind:start:end in code points; base_sha256 is of the pattern spans alone. One scan, no
    shuffle. Null text is empty and has no spans. Repeated rows are scanned each; other columns are not
    looked at. Empty table: empty result.
    """
    return id_and_text(docs, id_col, text_col).mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")
