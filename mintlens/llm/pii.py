"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns (email, ip, card, phone) give the base spans. The field finds what is written otherwise
(``jane [at] mail dot org``, ``(551) 555-0126``, ``4929.1234...``): words are labelled O, B- or I-kind
from the shape features of themselves and of two words on either side and from the label before. It is
trained in numpy on a small labelled table (``labelled_table``: ``ROWS`` sentences made from a rule and a
seed; any list of (text, spans) will do) by maximum likelihood, and decoded by Viterbi over batches of
padded word sequences.

Most words cannot be anything but O: where O leads every other label by more than any change of
the two transitions beside it can win back, the best path has O, whatever its neighbours are. Texts are cut
at such words and only the sequences between are decoded; the labels are those of the whole text's best path.

A labelled run becomes a span if its numbers fit its kind (``plausible``) and it does not overlap a base span.

Defined cases: null text is empty and has no spans; rows with equal or null id are searched one by one;
spans are in code points of the whole text, of any length; other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .piece_memo import slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
REACH = (-2, -1, 0, 1, 2)       # the words whose features a word's label sees
ROWS = 600                      # sentences of the labelled table
EPOCHS = 120
MEMO = 200_000                  # words whose features a task remembers
CELLS = 1 << 20                 # words decoded at once, padding included

# ---- base patterns -------------------------------------------------------------------------------
# Each finds the matches of the stated pattern, leftmost and without overlaps, in time linear in the text: a run
# that cannot match from its first character cannot from a later one, so no start inside a run is tried.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def _fits(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(map(_byte, found.split(".")))
    d = _digits(found)
    return 16 <= len(d) <= 19 and luhn(d) if kind == "card" else 8 <= len(d) <= 15


def _emails(text: str):
    for m in EMAIL.finditer(text):
        if m[1]:
            yield m.span()


def base_spans(text: str, kinds=KINDS) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the matches of the patterns, by kind, then start."""
    out = []
    for kind in kinds:
        if kind == "email":
            out += [("email", *at) for at in _emails(text)]
        else:
            pattern = {"ip": IP, "card": CARD, "phone": PHONE}[kind]
            out += [(kind, *m.span()) for m in pattern.finditer(text) if _fits(kind, m[0])]
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1:])))


# ---- features of a word --------------------------------------------------------------------------
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
TELLING = np.zeros(256, bool)       # a word with none of these is plain, unless it is a cue
TELLING[[ord(c) for c in string.digits + "@+[("]] = True
#: Words that stand inside or beside personal data, or beside what only looks like it; of at most eight letters.
CUES = ("at", "dot", "com", "org", "net", "tel", "phone", "call", "fax", "mobile", "card", "visa", "ip", "host", "server",
        "mail", "email", "isbn", "order", "version", "id", "account", "number")
EDGE = ".,;:!?\"'<>*$%&#"
NUMBER = re.compile("[0-9]+")
RUNS = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
PLAIN, EDGE_OF_TEXT = 0, 1           # classes of words that have no features of their own


def features(word: str) -> list[str]:
    """Names of what the field sees of a word that is not plain."""
    bare = word.strip(EDGE)
    inner = bare.strip("[](){}").lower()
    if inner in CUES:
        return [f"word={inner}"] + ["bracketed"] * (inner != bare.lower())
    numbers = NUMBER.findall(bare[:64])
    d = sum(map(len, numbers))
    if len(bare) > 64:
        return ["long", "digit" if d else "other"]
    shape = "".join("9" * min(len(r), 5) if "0" <= r[0] <= "9" else "a" if r[0].isalpha() else r for r in RUNS.findall(bare))
    out = [f"shape={shape}", f"digits={d if d <= 4 else 5 if d < 8 else 8 if d < 12 else 12 if d < 16 else 16 if d < 20 else 20}",
           f"numbers={min(len(numbers), 5)}"]
    out += [f"has={c}" for c in "@+[(.-/:" if c in bare]
    if any(c.isalpha() for c in bare):
        out.append("letters")
    if len(numbers) == 4 and not any(c.isalpha() for c in bare) and all(map(_byte, numbers)):
        out.append("quad")
    if 16 <= d <= 19 and luhn("".join(numbers)):
        out.append("luhn")
    return out


class Words:
    """The words of texts in one buffer: their places, and the class of each."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray):
        """``raw`` the bytes of all texts, ``ends`` where each ends."""
        space = SPACE[raw]
        before, after = np.ones(len(raw) + 1, bool), np.ones(len(raw) + 1, bool)
        before[1:], after[:-1] = space, space
        before[ends] = after[ends] = True       # texts are apart, as if by white space
        self.raw = raw
        self.start = np.nonzero(before[:-1] & ~space)[0]
        self.stop = np.nonzero(after[1:] & ~space)[0] + 1
        self.doc = np.searchsorted(ends, self.start, side="right")

    def classes(self, known: Classes) -> np.ndarray:
        """Class of every word."""
        out = np.full(len(self.start), PLAIN, np.int64)
        if not len(out):
            return out
        told = np.concatenate([[0], np.cumsum(TELLING[self.raw])])
        telling = told[self.stop] > told[self.start]
        size = self.stop - self.start
        last = self.raw[self.stop - 1]
        cue = np.nonzero(~telling & (size <= 9))[0]
        length = size[cue] - np.isin(last[cue], np.frombuffer(EDGE.encode(), np.uint8))
        code = np.zeros(len(cue), np.uint64)
        for k in range(8):
            byte = self.raw[np.minimum(self.start[cue] + k, len(self.raw) - 1)] | 0x20
            code |= np.where(k < length, byte, 0).astype(np.uint64) << np.uint64(8 * k)
        code[length > 8] = 0
        at = np.minimum(np.searchsorted(known.cue_codes, code), len(known.cue_codes) - 1)
        hit = known.cue_codes[at] == code
        out[cue[hit]] = known.cue_class[at[hit]]
        for k in np.nonzero(telling)[0].tolist():
            out[k] = known.of(self.raw[self.start[k]:self.stop[k]].tobytes())
        return out


class Classes:
    """Words with the same features are one class. Class 0 is plain, 1 what stands before and after a text."""

    def __init__(self):
        self.sets: list[tuple[str, ...]] = [("plain",), ("edge",)]
        self.index = {s: k for k, s in enumerate(self.sets)}
        self.memo: dict[bytes, int] = {}
        codes = [(int.from_bytes(bytes(b | 0x20 for b in c.encode()), "little"), self._add((f"word={c}",))) for c in CUES]
        self.cue_codes = np.array([c for c, _ in sorted(codes)], np.uint64)
        self.cue_class = np.array([k for _, k in sorted(codes)], np.int64)

    def _add(self, names: tuple[str, ...]) -> int:
        if names not in self.index:
            self.index[names] = len(self.sets)
            self.sets.append(names)
        return self.index[names]

    def of(self, word: bytes) -> int:
        found = self.memo.get(word)
        if found is None:
            found = self._add(tuple(features(word.decode("utf-8", "replace"))))
            if len(word) <= 80:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[word] = found
        return found


def _buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw], dtype=np.int64)


# ---- the field -----------------------------------------------------------------------------------
class Field:
    """Weights of (reach, feature, label), of seeing plain words only (label), and transitions (label, label);
    before and after a text stands O."""

    def __init__(self, names: list[str]):
        self.names = {n: k for k, n in enumerate(names)}
        self.weight = np.zeros((len(REACH), len(names), len(LABELS)))
        self.alone = np.zeros(len(LABELS))
        self.move = np.zeros((len(LABELS), len(LABELS)))

    def table(self, sets: list[tuple[str, ...]]) -> np.ndarray:
        """(reach, class, label): what a word of each class adds to the labels of the words that see it."""
        out = np.zeros((len(REACH), len(sets), len(LABELS)))
        for k, names in enumerate(sets):
            at = [self.names[n] for n in names if n in self.names]
            out[:, k] = self.weight[:, at].sum(axis=1)
        return out

    def lead(self) -> np.ndarray:
        """By how much O must exceed each label for O to be certain, whatever stands beside the word."""
        m = self.move
        through = m[:, None, :] + m.T[None, :, :]                  # (before, after, label)
        return (through - through[:, :, :1]).max(axis=(0, 1))

    def train(self, sequences: list[np.ndarray], goals: list[np.ndarray], sets: list[tuple[str, ...]],
              epochs: int = EPOCHS, rate: float = 0.08, decay: float = 2e-4) -> None:
        """Maximum likelihood by Adam; ``sequences`` hold the classes of each sentence's words, ``goals`` their labels."""
        has = np.zeros((len(sets), len(self.names)))
        for k, names in enumerate(sets):
            has[k, [self.names[n] for n in names if n in self.names]] = 1
        x, y, live = _padded(sequences, goals)
        params = [self.weight, self.alone, self.move]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        for step in range(1, epochs + 1):
            grads = [g + decay * p for g, p in zip(self.gradient(x, y, live, has)[1:], params)]
            now = rate * (1 - (step - 1) / epochs)
            for p, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= now * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)

    def gradient(self, x: np.ndarray, y: np.ndarray, live: np.ndarray, has: np.ndarray):
        """(mean negative log-likelihood, its gradients). ``x`` (time + 4, sentences) classes with the reach around them."""
        table = np.einsum("cf,rfl->rcl", has, self.weight)
        steps, n = y.shape
        emit = sum(table[r][x[r:r + steps]] for r in range(len(REACH)))
        alone = np.all([x[r:r + steps] <= EDGE_OF_TEXT for r in range(len(REACH))], axis=0)
        emit += alone[:, :, None] * self.alone
        labels = len(LABELS)
        ahead, m = np.empty((steps, n, labels)), self.move
        ahead[0] = emit[0] + m[0]
        for t in range(1, steps):
            new = emit[t] + _log_sum(ahead[t - 1][:, :, None] + m, 1)
            ahead[t] = np.where(live[t][:, None], new, ahead[t - 1])
        behind = np.empty_like(ahead)
        behind[-1] = m[:, 0]
        for t in range(steps - 1, 0, -1):
            new = _log_sum(m + (emit[t] + behind[t])[:, None, :], 2)
            behind[t - 1] = np.where(live[t][:, None], new, m[:, 0])
        total = _log_sum(ahead[-1] + m[:, 0], 1)
        p = np.exp(ahead + behind - total[None, :, None]) * live[:, :, None]
        at = np.arange(n)
        score, d_move = np.zeros(n), np.zeros_like(m)
        for t in range(steps):
            before = y[t - 1] if t else np.zeros(n, np.int64)
            on = live[t]
            score += np.where(on, emit[t, at, y[t]] + m[before, y[t]], 0)
            np.add.at(d_move, (before[on], y[t][on]), -1)
            if t:
                pair = np.exp(ahead[t - 1][:, :, None] + m + (emit[t] + behind[t])[:, None, :] - total[:, None, None])
                d_move += pair[on].sum(axis=0)
            else:
                d_move[0] += p[0].sum(axis=0)
        final = y[live.sum(axis=0) - 1, at]
        score += m[final, 0]
        np.add.at(d_move, (final, np.zeros(n, np.int64)), -1)
        d_move[:, 0] += np.exp(ahead[-1] + m[:, 0] - total[:, None]).sum(axis=0)
        p[np.arange(steps)[:, None], at, y] -= live
        by_class = np.zeros((len(REACH), len(has), labels))
        for r in range(len(REACH)):
            np.add.at(by_class[r], x[r:r + steps], p)
        return float((total - score).mean()), np.einsum("cf,rcl->rfl", has, by_class) / n, p[alone].sum(axis=0) / n, d_move / n

    def best(self, emit: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Labels (sequences, time) of the best paths through (sequences, time, labels), between two Os."""
        n, steps, labels = emit.shape
        back = np.zeros((steps, n, labels), np.int8)
        at, out = np.arange(n), np.zeros((n, steps), np.int8)
        score = emit[:, 0] + self.move[0]
        last = score + self.move[:, 0]
        final = np.where((size == 1)[:, None], last, -np.inf)
        for t in range(1, steps):
            through = score[:, :, None] + self.move
            back[t] = through.argmax(axis=1)
            score = through.max(axis=1) + emit[:, t]
            final = np.where((size == t + 1)[:, None], score + self.move[:, 0], final)
        now = final.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            inside = t < size
            out[inside, t] = now[inside]
            now = np.where(inside, back[t, at, now], now)
        return out

    def decode(self, classes: np.ndarray, doc: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Label of every word; ``doc`` (rising) tells texts apart."""
        n = len(classes)
        out = np.zeros(n, np.int8)
        if not n:
            return out
        lead = self.lead()
        plain = table[:, PLAIN].sum(axis=0) + self.alone
        seen = np.ones(n, bool)
        if (plain[0] - plain > lead)[1:].all():
            # a word among plain ones is certainly O: only those that see another class, or an end of a text, are looked at
            near = np.zeros(n + 4, bool)        # of the words two before the first to two after the last
            for odd, offsets in ((np.nonzero(classes != PLAIN)[0], REACH), (np.nonzero(np.diff(doc))[0] + 1, (-2, -1, 0, 1))):
                for off in offsets:
                    near[odd + 2 + off] = True
            near[2:4] = near[n:n + 2] = True
            seen = near[2:n + 2]
        at = np.nonzero(seen)[0]
        emit, alone = np.zeros((len(at), len(LABELS))), np.ones(len(at), bool)
        for r, off in enumerate(REACH):
            to = np.clip(at + off, 0, n - 1)
            inside = (to == at + off) & (doc[to] == doc[at])
            of = np.where(inside, classes[to], EDGE_OF_TEXT)
            emit += table[r][of]
            alone &= of <= EDGE_OF_TEXT
        emit += alone[:, None] * self.alone
        open_ = ~((emit[:, :1] - emit > lead)[:, 1:].all(axis=1))
        at, emit = at[open_], emit[open_]
        if not len(at):
            return out
        first = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(doc[at]) > 0)])
        begin = np.nonzero(first)[0]
        size = np.diff(np.append(begin, len(at)))
        order = np.argsort(size, kind="stable")
        lo = 0
        while lo < len(order):
            most = 2 * int(size[order[lo]])         # padded to less than twice their length
            hi = int(np.searchsorted(size[order], most, side="left"))
            hi = max(lo + 1, min(hi, lo + max(1, CELLS // most)))
            some = order[lo:hi]
            steps = int(size[some].max())
            where = begin[some][:, None] + np.minimum(np.arange(steps), size[some][:, None] - 1)
            labels = self.best(emit[where], size[some])
            inside = np.arange(steps) < size[some][:, None]
            out[at[where[inside]]] = labels[inside]
            lo = hi
        return out


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis=axis)) + np.squeeze(top, axis)


def _padded(sequences: list[np.ndarray], goals: list[np.ndarray]):
    steps, n = max(map(len, sequences)), len(sequences)
    x = np.full((steps + len(REACH) - 1, n), EDGE_OF_TEXT, np.int64)
    y, live = np.zeros((steps, n), np.int64), np.zeros((steps, n), bool)
    for k, (s, g) in enumerate(zip(sequences, goals)):
        x[2:2 + len(s), k], y[:len(s), k], live[:len(s), k] = s, g, True
    return x, y, live


# ---- the labelled table --------------------------------------------------------------------------
def _card(rng: random.Random, valid: bool) -> str:
    while True:
        d = "".join(rng.choice(string.digits) for _ in range(16))
        if luhn(d) == valid:
            return d


def _made(rng: random.Random, kind: str) -> str:
    """One piece of personal data of a kind, in one of the ways in which it is written."""
    def number(n):
        return "".join(rng.choice(string.digits) for _ in range(n))

    def name():
        return "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 8)))

    if kind == "email":
        at, dot = rng.choice([(" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" [at] ", "."), (" (at) ", "."),
                              ("[at]", "[dot]"), ("(at)", "."), ("@", "."), ("@", ".")])
        who = rng.choice([name(), f"{name()}.{number(2)}", f"{name()}.{name()}"])
        return f"{who}{at}{name()}{dot}{rng.choice(['com', 'org', 'net'])}"
    if kind == "ip":
        join = rng.choice([".", ".", "[.]", "(.)", " dot "])
        return join.join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        d = _card(rng, True)
        join = rng.choice(["", " ", "-", ".", "/", "_"])
        return join.join(d[k:k + 4] for k in range(0, 16, 4))
    a, b, c = number(3), number(3), number(4)
    return rng.choice([f"({a}) {b}-{c}", f"({a}) {b} {c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a}/{b}{c}",
                       f"+1 ({a}) {b}-{c}", f"+{number(2)} {a} {b}{c}", f"+{number(2)}-{a}-{b}-{c}"])


def _decoy(rng: random.Random) -> str:
    """What is not personal data, though it has digits or cue words."""
    def number(n):
        return "".join(rng.choice(string.digits) for _ in range(n))

    return rng.choice([
        lambda: _card(rng, False), lambda: " ".join(_card(rng, False)[k:k + 4] for k in range(0, 16, 4)),
        lambda: f"20{number(2)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", lambda: f"{rng.randint(0, 23)}:{number(2)}",
        lambda: f"${number(1)},{number(3)}.{number(2)}", lambda: f"version {number(1)}.{number(2)}.{number(1)}",
        lambda: f"order {number(8)}", lambda: f"id {number(10)}", lambda: f"isbn 978-{number(1)}-{number(2)}-{number(6)}-{number(1)}",
        lambda: f'"{rng.getrandbits(4 * rng.randint(30, 40)):x}"', lambda: f"({number(4)})", lambda: f"[{number(2)}]", lambda: number(rng.randint(1, 9)),
        lambda: f"({_word(rng)} {_word(rng)})", lambda: f"at {_word(rng)}", lambda: f"{_word(rng)} at the {_word(rng)}", lambda: f"the dot {_word(rng)}",
        lambda: f"{_word(rng)} at {_word(rng)} dot {_word(rng)}", lambda: f"at the dot {_word(rng)}",
        lambda: f"call {_word(rng)}", lambda: f"phone {_word(rng)}", lambda: f"{number(3)} {number(3)}", lambda: f"{number(3)}-{number(3)}",
        lambda: f"{number(2)}.{number(2)}", lambda: f"{number(1)}+{number(1)}", lambda: f"@{_word(rng)}", lambda: f"account {number(12)}",
        lambda: f"999.{number(3)}.{rng.randint(256, 999)}.{number(2)}", lambda: f"{_word(rng)}.com", lambda: f"{number(5)}-{number(4)}"])()


def _word(rng: random.Random) -> str:
    word = "".join(rng.choice("abcdefghilmnoprstuéöñ") for _ in range(rng.randint(1, 9)))
    return rng.choice([word] * 6 + [word.capitalize(), word.upper()]) + rng.choice([""] * 6 + [",", ".", "!!", "###"])


def labelled_table(rows: int = ROWS, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, spans): sentences of made-up words with personal data and with what only looks like it."""
    rng, out = random.Random(seed), []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(rng.randint(3, 16)):
            odds = rng.random()
            if odds < 0.12:
                kind = rng.choice(KINDS)
                if rng.random() < 0.3:
                    text += {"email": "mail", "ip": "host", "card": "card", "phone": "tel"}[kind] + rng.choice([" ", ": "])
                found = _made(rng, kind)
                spans.append((kind, len(text), len(text) + len(found)))
                text += found + rng.choice([""] * 4 + [",", ".", "!!", "***"])
            else:
                text += _decoy(rng) if odds < 0.3 else _word(rng)
            text += rng.choice([" "] * 9 + ["\n"])
        out.append((text, spans))
    return out


def train(labelled: list[tuple[str, list[tuple[str, int, int]]]] | None = None, epochs: int = EPOCHS) -> Field:
    """A field trained on a small labelled table. A feature seen in one word only is left out."""
    labelled = labelled_table() if labelled is None else labelled
    known, sequences, goals = Classes(), [], []
    for text, spans in labelled:
        words = Words(*_buffer([text]))
        if not len(words.start):
            continue
        chars = np.concatenate([[0], np.cumsum((words.raw & 0xC0) != 0x80)])      # bytes -> code points
        start, stop = chars[words.start], chars[words.stop]
        y = np.zeros(len(start), np.int64)
        for kind, a, b in spans:
            inside = np.nonzero((start < b) & (stop > a))[0]
            y[inside] = LABELS.index(f"I-{kind}")
            y[inside[:1]] = LABELS.index(f"B-{kind}")
        sequences.append(words.classes(known))
        goals.append(y)
    times: dict[str, int] = {}
    for names in known.sets + [known.sets[c] for s in sequences for c in s]:
        for name in names:
            times[name] = times.get(name, 0) + 1
    field = Field(sorted(n for n, k in times.items() if k > 2 or not n.startswith("shape=")))
    if sequences:
        field.train(sequences, goals, known.sets, epochs)
    return field


# ---- over texts ----------------------------------------------------------------------------------
def plausible(kind: str, found: str) -> bool:
    """Whether what the field has found can be of its kind."""
    d = _digits(found)
    if kind == "email":
        parts = re.split(r"@|\W*\bat\b\W*", found, maxsplit=1, flags=re.I)
        return len(parts) == 2 and all(re.search(r"[^\W\d_]|\d", p) for p in parts) and bool(re.search(r"\.|\bdot\b", parts[1], re.I))
    if kind == "ip":
        parts = NUMBER.findall(found)
        return len(parts) == 4 and all(map(_byte, parts))
    if re.search(r"[^\W\d_]", found):
        return False
    return 16 <= len(d) <= 19 and luhn(d) if kind == "card" else 8 <= len(d) <= 15


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """Without punctuation and single brackets at the ends."""
    while a < b and text[a] in EDGE:
        a += 1
    while a < b and text[b - 1] in EDGE:
        b -= 1
    for left, right in ("()", "[]"):
        if text[a:a + 1] == left and right not in text[a:b]:
            a += 1
        if text[b - 1:b] == right and left not in text[a:b]:
            b -= 1
    return a, b


class Finder:
    """Base spans and added spans of texts; one in a task."""

    def __init__(self, field: Field):
        self.field, self.classes = field, Classes()
        self.table = field.table(self.classes.sets)

    def labels(self, words: Words) -> np.ndarray:
        if len(self.classes.sets) > MEMO:           # many rare shapes: start anew
            self.classes = Classes()
            self.table = self.field.table(self.classes.sets)
        found = words.classes(self.classes)
        if len(self.classes.sets) > self.table.shape[1]:
            self.table = np.concatenate([self.table, self.field.table(self.classes.sets[self.table.shape[1]:])], axis=1)
        return self.field.decode(found, words.doc, self.table)

    def find(self, raw: np.ndarray, ends: np.ndarray) -> dict[int, tuple[list, list]]:
        """text -> (base spans, added spans), of the texts that have any; ``ends`` are the places where texts end in ``raw``."""
        starts = np.concatenate([[0], ends[:-1]])
        bounds = np.concatenate([[0], ends])

        def count(mask):
            return np.diff(np.searchsorted(np.nonzero(mask)[0], bounds))

        digits = count((raw >= 0x30) & (raw <= 0x39))
        has = {"email": count(raw == ord("@")) > 0, "ip": (digits > 3) & (count(raw == ord(".")) > 2), "card": digits > 15,
               "phone": (digits > 7) & (count(raw == ord("+")) > 0)}
        out: dict[int, tuple[list, list]] = {}
        texts: dict[int, str] = {}

        def text(k):
            if k not in texts:
                texts[k] = raw[starts[k]:ends[k]].tobytes().decode("utf-8", "replace")
            return texts[k]

        for k in np.nonzero(np.any(list(has.values()), axis=0))[0].tolist():
            if base := base_spans(text(k), [kind for kind in KINDS if has[kind][k]]):
                out[k] = (base, [])
        words = Words(raw, ends)
        labels = self.labels(words)
        runs: dict[int, list[tuple[str, int, int]]] = {}
        for at in np.nonzero(labels)[0].tolist():
            k, name = int(words.doc[at]), LABELS[labels[at]]
            a, b = int(words.start[at]), int(words.stop[at])
            own = runs.setdefault(k, [])
            if name[0] == "I" and own and own[-1][0] == name[2:] and at and labels[at - 1] and own[-1][3] == at - 1:
                own[-1] = (own[-1][0], own[-1][1], b, at)
            else:
                own.append((name[2:], a, b, at))
        for k, own in runs.items():
            base, added = out.get(k, ([], []))
            byte, char = int(starts[k]), 0
            for kind, a, b, _ in own:
                char += len(raw[byte:a].tobytes().decode("utf-8", "replace"))
                size = len(raw[a:b].tobytes().decode("utf-8", "replace"))
                byte, first = b, char
                char += size
                lo, hi = _trimmed(text(k), first, char)
                if lo < hi and plausible(kind, text(k)[lo:hi]) and not any(s < hi and e > lo for _, s, e in base):
                    added.append((kind, lo, hi))
            if base or added:
                out[k] = (base, added)
        return out


def find_personal(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row; the counts are of base spans."""
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        finder = Finder(field)
        for whole in batches:
            for batch in slices(whole, 1):
                column = batch.column(1).cast(pa.large_binary()).fill_null(b"")
                offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
                data = column.buffers()[2]
                raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)
                found = finder.find(raw, (offsets[1:] - offsets[0]).astype(np.int64)) if len(column) else {}
                n = {kind: np.zeros(len(column), np.int64) for kind in (*KINDS, "added")}
                sha, spans = [nothing] * len(column), [""] * len(column)
                for k, (base, added) in found.items():
                    for kind, _, _ in base:
                        n[kind][k] += 1
                    n["added"][k] = len(added)
                    sha[k], spans[k] = hashlib.sha256(written(base).encode()).hexdigest(), written(base + added)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(n[k]) for k in KINDS), pa.array(sha, pa.string()), pa.array(spans, pa.string()),
                     pa.array(n["added"])], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run,
                     f"doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS)
                     + ", base_sha256 string, spans string, n_added bigint")
