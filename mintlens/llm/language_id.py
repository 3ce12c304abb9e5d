"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in segments, forwards and backwards, and gives every byte
position a distribution over the learned languages; a document's probabilities are the mean over
all its positions. It is trained here, in numpy, by backpropagation through time with Adam, on a
bounded sample of labelled documents (``DOCS_A_LANG`` rows for each labelled language, however many there are,
``SEGMENTS_A_DOC`` segments of each, spread over the whole text). The weights (about 60 KB) travel with
the task. Prediction covers every byte of every text.

Defined cases: null text and text without a letter are ``und`` with score 0; without any labelled
document everything is ``und``; rows with equal id are predicted one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_rows, map_arrow

HIDDEN = 8
SEGMENT = 96            # bytes read with one state
DOCS_A_LANG = 240       # training sample
SEGMENTS_A_DOC = 6
EPOCHS = 10
BATCH = 256
POSITIONS = 1 << 19     # bytes predicted at once
PAD = 256
UND = "und"
LETTER = regex.compile(r"\p{L}")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Direction:
    """One gated recurrent layer; arrays are (features, batch). Gates: z, r, candidate."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.h = hidden
        self.params = {"w": (rng.standard_normal((3 * hidden, PAD + 1)) * 0.3).astype(np.float32),
                       "u": (rng.standard_normal((3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)}

    def states(self, x: np.ndarray, live: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each of the (time, batch) bytes; padding resets the state."""
        h, (w, u) = self.h, (self.params["w"], self.params["u"])
        out = np.empty((len(x), h, x.shape[1]), np.float32)
        s = np.zeros((h, x.shape[1]), np.float32)
        g = np.empty((3 * h, x.shape[1]), np.float32)
        a = np.empty_like(g)
        n = np.empty_like(s)
        for t in range(len(x)):
            np.take(w, x[t], axis=1, out=g, mode="clip")
            np.matmul(u, s, out=a)
            zr = g[:2 * h]
            zr += a[:2 * h]
            _sigmoid(zr)
            np.multiply(zr[h:], a[2 * h:], out=n)
            n += g[2 * h:]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((s.copy(), zr.copy(), a[2 * h:].copy(), n.copy()))
            s -= n
            s *= zr[:h]
            s += n
            s *= live[t]
            out[t] = s
        return out

    def gradients(self, x: np.ndarray, live: np.ndarray, kept: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        """Backpropagation through time; ``d_out`` is the loss gradient of the states."""
        h, u = self.h, self.params["u"]
        dw, du = np.zeros_like(self.params["w"]), np.zeros_like(u)
        carry = np.zeros_like(d_out[0])
        for t in range(len(x) - 1, -1, -1):
            s, zr, an, n = kept[t]
            z, r = zr[:h], zr[h:]
            d = (carry + d_out[t]) * live[t]
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (s - n) * z * (1 - z)
            dr = dn * an * r * (1 - r)
            gates = np.concatenate([dz, dr, dn])
            inner = np.concatenate([dz, dr, dn * r])
            du += inner @ s.T
            for k in range(3 * h):
                dw[k] += np.bincount(x[t], weights=gates[k], minlength=PAD + 1).astype(np.float32)
            carry = u.T @ inner + d * z
        return {"w": dw, "u": du}


class Network:
    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.forward, self.backward = Direction(rng, hidden), Direction(rng, hidden)
        self.out = {"v": (rng.standard_normal((len(langs), 2 * hidden)) * 0.3).astype(np.float32),
                    "b": np.zeros((len(langs), 1), np.float32)}

    def _probabilities(self, states: np.ndarray) -> np.ndarray:
        """(time, languages, batch) from the (time, 2 hidden, batch) states."""
        p = np.matmul(self.out["v"], states)
        p += self.out["b"]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def label(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities of every position, live) for (time, batch) bytes."""
        live = (x != PAD).astype(np.float32)[:, None, :]
        ahead = self.forward.states(x, live)
        behind = self.backward.states(x[::-1], live[::-1])[::-1]
        return self._probabilities(np.concatenate([ahead, behind], axis=1)), live

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = 0.02,
              seed: int = 11) -> None:
        """``x`` (segments, time) bytes, ``y`` the language of each; every position learns its segment's language."""
        rng = np.random.default_rng(seed)
        groups = [self.forward.params, self.backward.params, self.out]
        moments = [{k: (np.zeros_like(p), np.zeros_like(p)) for k, p in g.items()} for g in groups]
        step, hidden = 0, self.forward.h
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                some = order[lo:lo + batch]
                xt = np.ascontiguousarray(x[some].T)
                live = (xt != PAD).astype(np.float32)[:, None, :]
                back_x, back_live = xt[::-1], live[::-1]
                kept_f, kept_b = [], []
                ahead = self.forward.states(xt, live, kept_f)
                behind = self.backward.states(back_x, back_live, kept_b)
                states = np.concatenate([ahead, behind[::-1]], axis=1)
                d = self._probabilities(states)
                d[:, y[some], np.arange(len(some))] -= 1
                d *= live / max(1.0, float(live.sum()))
                d_states = np.matmul(self.out["v"].T, d)
                grads = [self.forward.gradients(xt, live, kept_f, d_states[:, :hidden]),
                         self.backward.gradients(back_x, back_live, kept_b, d_states[::-1, hidden:]),
                         {"v": np.einsum("tcb,thb->ch", d, states), "b": d.sum(axis=(0, 2))[:, None]}]
                step += 1
                now = rate * (1 - epoch / epochs)
                for group, grad, moment in zip(groups, grads, moments):
                    for k, p in group.items():
                        m, v = moment[k]
                        m += 0.1 * (grad[k] - m)
                        v += 0.01 * (grad[k] ** 2 - v)
                        p -= now * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """(documents, languages): the mean distribution over all positions of each text (zeros for an empty one)."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        segments = -(-sizes // SEGMENT)
        sums = np.zeros((len(texts), len(self.langs)))
        owner = np.repeat(np.arange(len(texts)), segments)
        starts = np.concatenate([[0], np.cumsum(sizes)])[owner] + SEGMENT * (
            np.arange(len(owner)) - np.repeat(np.cumsum(segments) - segments, segments))
        ends = np.minimum(starts + SEGMENT, np.cumsum(sizes)[owner])
        raw = np.frombuffer(b"".join(texts), np.uint8)
        step = max(1, POSITIONS // SEGMENT // 8)
        for lo in range(0, len(owner), step):
            at = starts[lo:lo + step] + np.arange(SEGMENT)[:, None]
            inside = at < ends[lo:lo + step]
            x = np.where(inside, raw[np.minimum(at, len(raw) - 1)].astype(np.intp), PAD)
            p, live = self.label(x)
            np.add.at(sums, owner[lo:lo + step], (p * live).sum(axis=0).T)
        return sums / np.maximum(sizes, 1)[:, None]


def train(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> Network | None:
    """A network trained on a bounded sample of the labelled documents for which ``may_learn`` holds."""
    named = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    raw = F.encode(F.col(text_col), "utf-8")
    gap = F.greatest(F.lit(1), F.floor((F.octet_length(text_col) - SEGMENT) / (SEGMENTS_A_DOC - 1)))
    cuts = F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS_A_DOC - 1)),
                       lambda k: F.substring(raw, (k * gap + 1).cast("int"), F.lit(SEGMENT)))
    # only the segments travel; a task hands over DOCS_A_LANG rows a language at most (a group limit before the shuffle)
    rows = named.select(F.col(id_col).alias("i"), F.col(lang_col).alias("y"), F.octet_length(text_col).alias("n"),
                        F.array_distinct(cuts).alias("cuts"))
    first = Window.partitionBy("y").orderBy(F.xxhash64("i"), "i", "n", F.xxhash64("cuts"))
    picked = rows.withColumn("k", F.row_number().over(first)).where(F.col("k") <= DOCS_A_LANG)
    segments = sorted((r["y"], bytes(r["s"])) for r in picked.select("y", F.explode("cuts").alias("s")).collect())
    langs = sorted({y for y, _ in segments})
    if not langs:
        return None
    x = np.full((len(segments), SEGMENT), PAD, np.intp)
    for k, (_, s) in enumerate(segments):
        x[k, :len(s)] = np.frombuffer(s, np.uint8)
    net = Network(langs)
    number = {y: k for k, y in enumerate(langs)}
    net.train(x, np.array([number[y] for y, _ in segments]))
    return net


def identify(net: Network | None, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of each text."""
    lang, score = np.full(len(texts), UND, object), np.zeros(len(texts))
    lo = 0
    while net is not None and lo < len(texts):     # slices of about POSITIONS bytes
        hi, size = lo + 1, len(texts[lo])
        while hi < len(texts) and size + len(texts[hi]) <= POSITIONS:
            size += len(texts[hi])
            hi += 1
        some = [k for k in range(lo, hi) if LETTER.search(texts[k].decode("utf-8", "replace"))]
        if some:
            pooled = net.pool([texts[k] for k in some])
            best = pooled.argmax(axis=1)
            lang[some] = np.array(net.langs, object)[best]
            score[some] = np.clip(np.round(pooled[np.arange(len(some)), best], 4), 0, 1)
        lo = hi
    return lang, score


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; ``score`` is the pooled probability of the predicted language."""

    def run(batches):
        for batch in batches:
            lang, score = identify(net, [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)],
                                             ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run,
                     f"doc_id {kind}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """A fifth of the documents, by id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def keep_identified(docs: DataFrame, net: Network | None, min_score: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is identified with at least ``min_score``."""

    def keep():
        def test(column):
            lang, score = identify(net, [x or b"" for x in column.cast(pa.binary()).to_pylist()])
            return ((lang != UND) & (score >= min_score)).tolist()
        return test

    return keep_rows(docs, text_col, keep)
