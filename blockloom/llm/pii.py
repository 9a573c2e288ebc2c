"""Operator 5: personal data by patterns and a linear-chain conditional random field.

The patterns give the base spans. The field labels every token of a text by word shapes and known words of
the token and its neighbours, and adds spans that patterns of fixed form miss: names and street addresses by
what stands around them, numbers of identity, phones without a plus sign.

Whole texts are decoded. A token's weights depend on its class alone (its set of known features), so a bound
on what any entity through a token could gain over no entity is a sum of four numbers; where even the best
stretch through a token can't reach zero, "O" is its label in every best path. Viterbi runs on what is left,
many runs at once in numpy; the result is that of Viterbi over all tokens.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from blockloom.llm.common import Memory, emit, hold, id_and_text, slices, texts_of
from blockloom.llm.spans import Cover, Span, digest, listed

KINDS = ("email", "ip", "card", "phone", "id", "name", "address")
#: The base patterns of the contract, each begun where a leftmost match can begin.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
TOKEN = re.compile(r"\S+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_MARKS = ".,;:!?#*$%&\"'"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Leftmost matches: the run before an "@" can only end there, so each "@" decides for itself."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def _octet(part: str) -> bool:
    """Whether ASCII digits make a number up to 255, however many zeros lead."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    if not TRIGGER.search(text):
        return []
    found = emails(text)
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return found


# ---- the field ----------------------------------------------------------------------------------

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: The labelled table: text with {kind:...} around personal data. # is any digit, L a card's right last digit, ~ any
#: small word and ^ any word with a capital, of drawn letters, so that no name or place is learned by heart.
TABLE = """
call me at {phone:(###) ###-####} today
phone {phone:###-###-####} or mail {email:abc.de@mail#.example.com} please
tel {phone:###.###.####} fax {phone:###.###.####}
reach us on {phone:+# (###) ###-####} any time
reach us on {phone:+## ### ### ####} any time
ring {phone:+#-###-###-####} now
~ ~ ~ {phone:(###) ###-####} ~ ~
~ ~ {phone:###-###-####} ~ ~
my ssn is {id:###-##-####} thanks
number {id:###-##-####} of the insured
~ ~ {id:###-##-####} ~ ~
write to {email:ab@host.org} soon
from {email:first.last##@mail#.example.com} came a note
the host {ip:##.###.##.###} answered
server {ip:###.##.#.##} is down
pay with {card:#### #### #### ###L} at once
card {card:###############L} was used
card {card:####-####-####-###L} was used
my name is {name:^ ^} and ~ ~
my name is {name:^} and ~ ~
his name is {name:^ ^}.
her name was {name:^}, ~ ~
Name: {name:^ ^}
name: {name:^ ^ ^}, ~ ~
~ ~ Mr. {name:^} ~ ~
~ ~ Mrs. {name:^ ^} ~ ~
Ms. {name:^} ~ ~ ~
~ Dr. {name:^ ^}, ~ ~
~ Mr {name:^} ~ ~
~ Herr {name:^ ^} ~ ~
Frau {name:^} ~ ~ ~
~ ~ Monsieur {name:^} ~ ~
~ Madame {name:^ ^} ~ ~
~ Señora {name:^} ~ ~
Dear {name:^ ^}, ~ ~ ~
Sincerely, {name:^ ^}
Regards, {name:^ ^}
patient {name:^ ^} was ~ ~
~ customer {name:^ ^} ~ ~
~ employee {name:^ ^}, ~ ~
~ contact {name:^ ^} at {phone:###-###-####}
~ ~ lives at {address:## ^ Street} ~ ~
~ ~ at {address:### ^ Road}, ~ ~
~ to {address:#### ^ ^ Avenue} ~ ~
~ ~ {address:## ^ Lane}, ^ ~ ~
Address: {address:### ^ Street, ^}
address: {address:## ^ ^ Road}
~ ~ {address:##, rue ^} ~ ~
~ ~ {address:## rue de ^} ~ ~
~ ~ {address:calle ^ ##} ~ ~
order ################ has shipped
number ####### and ###### are counts
in the year #### there were ## of them
page ## of ### pages
see #.#.# and ##.# for more
on ##.##.#### we met
on ####-##-## we met
at ##:## we met
version #.##.# of the tool
it costs ###.## or $## each
section #.# and #.#.#.
about ##% of ###,### people
item a#b#c# and x## in stock
row ## ### #### ##### of the table
ratio ##/## and ##-## score
code ####-## is old
room ### floor #
http://host.example.com/en/### is a page
https://www.host.org/fr/##?id=### is a page
user@ and @name are not mail
^ ~ ~ ~, ~ ~. ^ ~ ~ ~ ~.
^ ~ ~ ~. ^ ~ is ~ ~ and ^.
~ ~ is ^ ^ ~, ~ to ^ ~ ~ at ^
^ ^ ^ ~ ~. ^. ^ ~ ~
~, ^ ^ ~ ~ ~ the ^ ^ ~ of ^
~ at ## ~ ~ and ## ^ ~ ~
~ ~ at ### ^ ^ ~ ~ ~
## ^ ~ ~, ## ~ ^. ^ ## ~
~ name of ^ ^ ~, ~ names ~ ^
~ ~ the street ~, the Road ~ ~ rue ~
the customer ~ ~ ^, ~ patient ~ ~
the contact ~ ~ is ~ my ~ was ^
~ ~! ^? ~; ^: ~ ~
^!! ^!! ~*** ^&&& ~$$$ ^%%%
~,&&& ~.!! ^?? ~\" ^*** ^!!! ~!! ^!!
~ ~ from ^ ^ to ^ ~ on ^ ##
under the ^ License, ^ #.# of ^
~ ~ ~ ~ ~ ~ ~ ~ ~ ~
dear ~, ~ ~ to ~
^ ^ ^ ^ ^ ^ ^ ^ ^ ^ ^ ^ ^ ^
^ ^ ^ ^ ^ ^ ~ ~ ~
~. ^ ^ ^ ^ ~ ^ ^ ^ ^ ^
^. ^ ^, ^, ^, ^, ^, ~ ~
^, ^, ^, ^, ^, ^, ^, ^, ^, ^, ^, ^, ^, ^, ^, ^, ~ ~
^. ^. ^. ^. ^. ^. ^. ^. ^. ^. ^. ^. ^. ^. ^. ^. ~
^ ^ ^ ^ ^ ^ ^ ^ ^ ^ ^ ^ ^ ^ ^ ^ ^ ^ ~ ~ ~
De De De De De De De De De de de ~ ~
De, De, De, De, De, De, De, De, ~ ~
~ de ^ de ^ ~ La de la ^ ~ rue ~
^, ^, ^, ^, ^, ~ ~
^, ^, ^, ^, ^, ^, ^, ^, ^, ^, ^, ^, ^, ^, ^, ^, ~ ~
^. ^. ^. ^. ^. ^. ^. ^. ^. ^. ^. ^. ^. ^. ^. ^. ~
^ ^ ^ ^ ^ ^ ^ ^ ^ ^ ^ ^ ^ ^ ^ ^ ^ ^ ~ ~ ~
De De De De De De De De De de de ~ ~
De, De, De, De, De, De, De, De, ~ ~
~ de ^ de ^ ~ La de la ^ ~ rue ~
~ ~ de. ^, ~ de ^ ~, ~ de la ^.
de ^ ~ ~ rue. ^ ~ calle. ^ ~
~ ~ de. ^ ~ ~. De ^ ~ ~ ~
| ^ ~ | ^ | ~ | ^ ^ |
- ^ ~ - ^ ~ - ~ * ^
~ on. ^ ~ ~ at. ^ to ^ ~
^ ~ ~ ~ ~ ~ ~. ^ ~ ~ ~ ~ ~ ~ ~ ~
~ ~ ~, ~ ~ ~ ~ ~ ~. ~ ~ ~ ~
"""


def shape(token: str) -> str:
    """Letters to x, or X where a capital leads, digits to their counts, marks as they are; a right or wrong card number is told apart."""
    d = _digits(token)
    core = re.sub(r"[0-9]+", lambda m: f"<{min(len(m[0]), 5)}>", re.sub(r"[^\W\d_]+", lambda m: "X" if m[0][0].isupper() else "x", token.rstrip(_MARKS)))[:48]
    if 14 <= len(d) <= 19:
        core += "+luhn" if luhn(d) else "-luhn"
    return core


def token_features(token: str) -> list[str]:
    """Shape, mark at the end, number of digits, parts of an address, and the word itself, which only the table's words have."""
    bare = token.rstrip(_MARKS)
    mark = token[len(bare) : len(bare) + 1]
    return [f"s:{shape(token)}", f"m:{mark}", f"#:{min(len(_digits(token)), 20)}", f"@:{'@' in token}{'.' in bare}", f"w:{bare.lower()[:24]}{':' * (mark == ':')}"]


#: Neighbours whose features tell of a token.
OFFSETS = (0, -1, -2, 1)


def training_rows(copies: int = 6, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """The table with digits and words drawn: tokens and labels of each line."""
    rng, rows = np.random.default_rng(seed), []
    drawn = lambda: "".join(rng.choice(list("abcdefghilmnoprstuvz"), rng.integers(2, 9)))
    for line in TABLE.strip().splitlines():
        for _ in range(copies):
            text = re.sub(r"\^", lambda m: drawn().capitalize(), re.sub("~", lambda m: drawn(), re.sub("#", lambda m: str(rng.integers(1, 10)), line)))
            while "L" in (card := re.search(r"\{card:([^}]*)\}", text) or [""] * 2)[1]:
                known = card[1][:-1]
                text = text.replace(card[1], known + next(str(n) for n in range(10) if luhn(_digits(known) + str(n))), 1)
            tokens, labels = [], []
            for part in re.split(r"(\{[a-z]+:[^}]*\}\S*)", text):
                m = re.fullmatch(r"\{([a-z]+):([^}]*)\}(\S*)", part)
                for k, t in enumerate((m[2] + m[3] if m else part).split()):
                    tokens.append(t)
                    labels.append(f"{'I' if k else 'B'}-{m[1]}" if m else "O")
            rows.append((tokens, labels))
    return rows


class Field:
    """Weights of features at each offset for each label, and of label pairs. Unseen features weigh nothing."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, move: np.ndarray):
        self.index, self.weights, self.move = index, weights, move  # weights: offset x feature x label
        self.plain: dict[tuple, tuple[int, ...]] = {}
        inner = move[1:, 1:]
        step = float(inner[inner > -1e8].max()) if (inner > -1e8).any() else 0.0
        self.per_token = step - float(move[0, 0])
        self.ends = float(move[0, 1:].max() + move[1:, 0].max()) - step - float(move[0, 0])

    def known(self, token: str) -> tuple[int, ...]:
        """A token's class: its features that have weights. All words that the table lacks and whose case and mark agree have one class."""
        bare = token.rstrip(_MARKS)
        if bare.isalpha() and f"w:{bare.lower()[:24]}" not in self.index and f"w:{bare.lower()[:24]}:" not in self.index:
            key = bare[0].isupper(), token[len(bare) : len(bare) + 1]
            if key not in self.plain:
                self.plain[key] = self._known(token)
            return self.plain[key]
        return self._known(token)

    def _known(self, token: str) -> tuple[int, ...]:
        return tuple(self.index[f] for f in token_features(token) if f in self.index)

    def class_weights(self, classes: list[tuple[int, ...]]) -> np.ndarray:
        """class x offset x label"""
        return np.array([self.weights[:, list(c)].sum(1) for c in classes]).reshape(len(classes), len(OFFSETS), len(LABELS))

    def emissions(self, table: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of the labels of the tokens at some places of a chain of class numbers; -1 is a border."""
        out = np.zeros((len(at), len(LABELS)))
        for k, offset in enumerate(OFFSETS):
            place = at + offset
            near = np.where((place >= 0) & (place < len(ids)), ids[np.clip(place, 0, len(ids) - 1)], -1)
            if offset == -2:  # not beyond a border
                near = np.where((at > 0) & (ids[np.maximum(at - 1, 0)] < 0), -1, near)
            some = near >= 0
            out[some] += table[near[some], k]
        return out

    def possible(self, table: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which tokens may have another label than O in a best path. All others have O in every best path.

        If a stretch of other labels is best, its labels' gains over O and its label pairs' gains over O-O add up to zero
        or more. The largest weight of each neighbour bounds a token's gain; the best sums of bounds that end and that
        begin at a token bound every stretch through it.
        """
        worth = (table[:, :, 1:] - table[:, :, :1]).max(2)
        worth = np.concatenate([worth, np.zeros((1, len(OFFSETS)))])  # the last row is for borders
        padded = np.concatenate([[-1, -1], ids, [-1]])
        n = len(ids)
        gain = sum(worth[padded[2 + offset : 2 + offset + n], k] for k, offset in enumerate(OFFSETS)) + self.per_token
        # two places from a border: the neighbour beyond it is none, whatever it would be worth
        gain = np.where(padded[1 : 1 + n] < 0, gain - worth[padded[:n], OFFSETS.index(-2)], gain)
        gain[ids < 0] = -1000.0
        total = np.concatenate([[0.0], np.cumsum(gain)])
        ending = total[1:] - np.minimum.accumulate(total)[:-1]
        beginning = np.maximum.accumulate(total[::-1])[::-1][1:] - total[:-1]
        return (ids >= 0) & (ending + beginning - gain + self.ends >= -1e-6)

    def _batch(self, grid: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Best labels of rows x steps of scores, whose path leaves from the scores in start and ends in O."""
        score, back = start, []
        for t in range(grid.shape[1]):
            total = score[:, :, None] + self.move
            back.append(total.argmax(1))
            score = total.max(1) + grid[:, t]
        label = (score + self.move[:, 0]).argmax(1)
        path = []
        for b in reversed(back):
            path.append(label)
            label = b[np.arange(len(grid)), label]
        return np.stack(path[::-1], 1)

    def _long(self, run: np.ndarray, block: int, warm: int) -> np.ndarray:
        """Best labels of one long run, all its blocks at once. A block starts from the scores that it finds over the warm
        tokens before it, and what the block before ends with proves them right up to a constant; else all go one by one."""
        n, size = len(run), len(LABELS)
        blocks = -(-n // block)
        closed = np.append(0.0, np.full(size - 1, -1e9))
        full = np.concatenate([np.tile(closed, (warm, 1)), run, np.tile(closed, (blocks * block - n, 1))])
        grid = np.stack([full[b * block : b * block + warm + block] for b in range(blocks)])
        score = np.tile(closed, (blocks, 1))
        back = np.zeros((blocks, block, size), np.int8)
        before = None
        for t in range(warm + block):
            if t == warm:
                before = score - score.max(1, keepdims=True)
            total = score[:, :, None] + self.move
            if t >= warm:
                back[:, t - warm] = total.argmax(1)
            score = total.max(1) + grid[:, t]
        after = score - score.max(1, keepdims=True)
        if not np.allclose(np.maximum(before[1:], -1e6), np.maximum(after[:-1], -1e6), atol=1e-6):
            return self._batch(run[None], closed[None])[0]
        flat = back.reshape(-1, size)
        path = np.zeros(blocks * block, np.int64)
        label = int((score[-1] + self.move[:, 0]).argmax())
        for t in range(blocks * block - 1, -1, -1):
            path[t] = label
            label = int(flat[t, label])
        return path[:n]

    def viterbi(self, runs: list[np.ndarray], block: int = 512, warm: int = 64) -> list[list[int]]:
        """Best labels of many runs of tokens at once. A run is between O tokens (or the text's ends)."""
        out: list[list[int]] = [[] for _ in runs]
        by_size: dict[int, list[int]] = {}
        for i, r in enumerate(runs):
            if len(r) > 8 * block:
                out[i] = self._long(r, block, warm).tolist()
            elif len(r):
                by_size.setdefault((len(r) - 1).bit_length(), []).append(i)
        for members in by_size.values():
            sizes = np.array([len(runs[i]) for i in members])
            grid = np.full((len(members), sizes.max(), len(LABELS)), -1e9)
            grid[:, :, 0] = 0  # beyond a run's end: O
            for k, i in enumerate(members):
                grid[k, : len(runs[i])] = runs[i]
            start = np.tile(np.append(0.0, np.full(len(LABELS) - 1, -1e9)), (len(members), 1))
            paths = self._batch(grid, start)
            for k, i in enumerate(members):
                out[i] = paths[k, : len(runs[i])].tolist()
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis)
    return m + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis))


class Training:
    """Rows as one grid: an O token that is sure stands before each row, and at least one after it."""

    def __init__(self, rows: list[tuple[list[str], list[str]]], decay: float = 2e-4):
        self.index: dict[str, int] = {}
        for tokens, _ in rows:
            for t in tokens:
                for f in token_features(t):
                    self.index.setdefault(f, len(self.index))
        seen = np.bincount([self.index[f] for tokens, _ in rows for f in {g for t in tokens for g in token_features(t)}])
        kept = [f for f, k in self.index.items() if seen[k] > 3]  # of drawn words no word is learned
        self.index = {f: k for k, f in enumerate(kept)}
        number = {label: k for k, label in enumerate(LABELS)}
        self.width = max(len(t) for t, _ in rows) + 2
        self.gold = np.zeros((len(rows), self.width), np.int64)
        self.real = np.zeros((len(rows), self.width), bool)
        self.where: list[tuple[np.ndarray, np.ndarray]] = []
        pairs: list[list[tuple[int, int]]] = [[] for _ in OFFSETS]
        for i, (tokens, labels) in enumerate(rows):
            self.gold[i, 1 : len(tokens) + 1] = [number[x] for x in labels]
            self.real[i, 1 : len(tokens) + 1] = True
            known = [[self.index[f] for f in token_features(t) if f in self.index] for t in tokens]
            for k, offset in enumerate(OFFSETS):
                pairs[k] += [(i * self.width + t + 1, f) for t in range(len(tokens)) if 0 <= t + offset < len(tokens) for f in known[t + offset]]
        self.where = [tuple(np.array(p, np.int64).reshape(-1, 2).T) for p in pairs]
        n = len(LABELS)
        self.impossible = np.zeros((n, n), bool)  # I follows B or I of its kind only
        for k, label in enumerate(LABELS):
            if label[0] == "I":
                self.impossible[:, k] = [LABELS[j][1:] != label[1:] for j in range(n)]
        self.decay = decay * len(rows)

    def loss(self, weights: np.ndarray, move: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Negative log likelihood with decay, by forward-backward over all rows at once, and its gradients."""
        rows, n = len(self.gold), len(LABELS)
        e = np.zeros((rows * self.width, n))
        for k, (at, f) in enumerate(self.where):
            np.add.at(e, at, weights[k, f])
        e = e.reshape(rows, self.width, n)
        e[~self.real, 1:] = -1e9
        step = np.where(self.impossible, -1e9, move)
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for t in range(1, self.width):
            forward[:, t] = _log_sum(forward[:, t - 1, :, None] + step, 1) + e[:, t]
        for t in range(self.width - 2, -1, -1):
            backward[:, t] = _log_sum(step + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        z = _log_sum(forward[:, -1], 1)
        marginal = np.exp(forward + backward - z[:, None, None])
        i, t = np.indices(self.gold.shape)
        score = e[i, t, self.gold].sum() + move[self.gold[:, :-1], self.gold[:, 1:]].sum()
        marginal[i, t, self.gold] -= 1
        flat = marginal.reshape(-1, n)
        grad_w = self.decay * weights
        for k, (at, f) in enumerate(self.where):
            np.add.at(grad_w[k], f, flat[at])
        grad_m = self.decay * move
        for t in range(1, self.width):
            grad_m = grad_m + np.exp(forward[:, t - 1, :, None] + step + (e[:, t] + backward[:, t])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(grad_m, (self.gold[:, :-1].ravel(), self.gold[:, 1:].ravel()), -1.0)
        grad_m[self.impossible] = 0
        return float(z.sum() - score + self.decay / 2 * ((weights**2).sum() + (move**2).sum())), grad_w, grad_m


def fit(rows: list[tuple[list[str], list[str]]], rounds: int = 60, rate: float = 0.5) -> Field:
    """Maximum likelihood by AdaGrad, on the whole small table in each round."""
    data = Training(rows)
    w, move = np.zeros((len(OFFSETS), len(data.index), len(LABELS))), np.zeros((len(LABELS), len(LABELS)))
    seen_w, seen_m = np.full_like(w, 1e-6), np.full_like(move, 1e-6)
    for _ in range(rounds):
        _, grad_w, grad_m = data.loss(w, move)
        seen_w += grad_w**2
        seen_m += grad_m**2
        w -= rate * grad_w / np.sqrt(seen_w)
        move -= rate * grad_m / np.sqrt(seen_m)
    return Field(data.index, w, np.where(data.impossible, -1e9, move))


class Decoder:
    """A field with a bounded memory of tokens' classes."""

    def __init__(self, field: Field):
        self.field, self.memory = field, Memory(self._class)
        self.numbers: dict[tuple[int, ...], int] = {}
        self.table = np.zeros((0, len(OFFSETS), len(LABELS)))

    def _class(self, token: str) -> int:
        known = self.field.known(token)
        return self.numbers.setdefault(known, len(self.numbers))

    def labels(self, texts: list[str]) -> list[dict[int, str]]:
        """Labels but O of each text's tokens, by place."""
        split = [t.split() for t in texts]
        sizes = np.array([len(s) + 1 for s in split], np.int64)
        ids = np.full(int(sizes.sum()), -1, np.int64)  # a border before each text
        starts = np.cumsum(sizes) - sizes + 1
        inside = np.ones(len(ids), bool)
        inside[starts - 1] = False
        words = itertools.chain.from_iterable(split)
        ids[inside] = np.fromiter(map(self.memory.__getitem__, words), np.int64, int(inside.sum()))
        if len(self.numbers) > len(self.table):
            new = list(self.numbers)[len(self.table) :]
            self.table = np.concatenate([self.table, self.field.class_weights(new)])
        at = np.flatnonzero(self.field.possible(self.table, ids)) if len(self.table) else np.zeros(0, np.int64)
        out: list[dict[int, str]] = [{} for _ in texts]
        if not len(at):
            return out
        scores = self.field.emissions(self.table, ids, at)
        cuts = np.flatnonzero(np.diff(at) > 1) + 1
        found = self.field.viterbi(np.split(scores, cuts))
        flat = np.fromiter((x for r in found for x in r), np.int64, len(at))
        hit = np.flatnonzero(flat)
        owner = np.searchsorted(starts, at[hit], side="right") - 1
        for i, place, label in zip(owner.tolist(), (at[hit] - starts[owner]).tolist(), flat[hit].tolist(), strict=True):
            out[i][place] = LABELS[label]
        return out


def decode(decoder: Decoder, texts: list[str]) -> list[list[Span]]:
    """Spans that the field finds in each text, without the marks around them."""
    out: list[list[Span]] = []
    for text, labels in zip(texts, decoder.labels(texts), strict=True):
        spans: list[Span] = []
        where = {k: m.span() for k, m in enumerate(TOKEN.finditer(text)) if k in labels} if labels else {}
        open_: tuple[str, int] | None = None
        for k, following in itertools.pairwise([*sorted(labels), None]):
            kind = labels[k][2:]
            if labels[k][0] == "B":
                open_ = kind, where[k][0]
            if following != k + 1 or labels[following][0] == "B":
                a, b = open_[1], where[k][1]
                word = text[a:b]
                end = a + len(word.rstrip(_MARKS))
                start = a + len(word) - len(word.lstrip("\"'"))
                if start < end:
                    spans.append((kind, start, end))
        out.append(spans)
    return out


def plausible(kind: str, word: str) -> bool:
    """An exact check on what the field adds: parts of an address, last digit of a card."""
    if kind == "ip":
        return all(p.isascii() and p.isdigit() and _octet(p) for p in word.split("."))
    return kind != "card" or luhn(_digits(word))


@functools.cache
def default_field() -> Field:
    return fit(training_rows())


_DECODERS: dict[str, Decoder] = {}
OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("n_added", pa.int64()), ("n_spans", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in every whole text: doc_id, n_email, n_ip, n_card, n_phone, n_added, n_spans, base_sha256, spans.

    Counts and base_sha256 are of pattern spans; n_added counts the field's spans that overlap none of them;
    spans lists both as kind:start:end in code points, n_spans is their number. One scan, no shuffle; the
    broadcast field comes from a small table in this module. Null text is empty and has no spans. Repeated rows
    are searched each; other columns are not looked at. Empty table: empty result. A very long text costs time
    in proportion to its length.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(default_field())
    key = f"{spark.sparkContext.applicationId}-pii"

    def run(batches):
        hold("pii", _DECODERS.clear)
        if key not in _DECODERS:
            _DECODERS.clear()
            _DECODERS[key] = Decoder(shared.value)
        decoder = _DECODERS[key]
        for b in slices(batches):
            texts = texts_of(b)
            base = [base_spans(t) for t in texts]
            extra = []
            for t, found, known in zip(texts, decode(decoder, texts), base, strict=True):
                cover = Cover(known)
                extra.append([s for s in found if not cover.overlaps(s[1], s[2]) and plausible(s[0], t[s[1] : s[2]])])
            every = [[*s, *x] for s, x in zip(base, extra, strict=True)]
            counts = {f"n_{k}": [sum(s[0] == k for s in spans) for spans in base] for k in KINDS[:4]}
            yield emit(OUT, doc_id=b.column("doc_id"), **counts, n_added=[len(x) for x in extra], n_spans=[len(x) for x in every], base_sha256=[digest(listed(s, KINDS)) for s in base], spans=[listed(s, KINDS) for s in every])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, n_spans long, base_sha256 string, spans string")
