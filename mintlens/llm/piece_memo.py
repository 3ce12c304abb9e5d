"""Whole texts to token ids through their distinct space-delimited chunks and pattern matches.

The pre-tokenizer pattern never matches across the place between a character that is not
white space and a following space. Texts are cut there and Arrow finds the distinct chunks of a batch;
each is matched against the pattern once, each distinct match is encoded once, and a text's ids are
gathered from those. A text with a chunk after which a cut would not be safe (it is empty or ends in
white space) is matched as a whole, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: White space that stands between chunks (and pieces) that are matched together.
SEPARATOR = "\x0b"
#: Matches of the pattern that do not end in white space are matched just the same between separators.
#: Stands for a separator that a text holds itself; the pattern has no match like this.
OWN = SEPARATOR + "\0"
WHITE = frozenset(c for c in map(chr, range(0x3001)) if c.isspace() or regex.match(r"\s", c))


class Ragged:
    """Append-only list of integer sequences in one flat array."""

    def __init__(self):
        self.n = self.used = 0
        self.flat = np.empty(1 << 12, np.int32)
        self.start = np.empty(1 << 10, np.int64)
        self.count = np.empty(1 << 10, np.int64)

    @staticmethod
    def _fit(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.empty(max(n - len(a), len(a)), a.dtype)])

    def extend(self, flat: np.ndarray, count: np.ndarray) -> int:
        """Appends the sequences and returns the index of the first."""
        first, n = self.n, self.n + len(count)
        self.flat = self._fit(self.flat, self.used + len(flat))
        self.start, self.count = self._fit(self.start, n), self._fit(self.count, n)
        self.flat[self.used:self.used + len(flat)] = flat
        self.count[first:n] = count
        self.start[first:n] = self.used + np.cumsum(count) - count
        self.used, self.n = self.used + len(flat), n
        return first

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(their values in a row, their lengths)"""
        count = self.count[which]
        into = np.cumsum(count) - count
        return self.flat[np.arange(int(count.sum())) + np.repeat(self.start[which] - into, count)], count


def _strings(chunks: pa.Array) -> list[str]:
    try:
        return chunks.cast(pa.string()).to_pylist()
    except pa.ArrowInvalid:      # not UTF-8
        return [c.decode("utf-8", "replace") for c in chunks.to_pylist()]


class PieceMemo:
    """``encode_pieces`` maps a list of distinct pattern matches to (flat ids, ids of each).

    Between calls ``chunk_limit`` chunks and ``piece_limit`` matches are remembered, as Arrow arrays; a memo that has
    grown beyond its limit starts anew with the next call.
    """

    def __init__(self, pattern: str, encode_pieces: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
                 chunk_limit: int = 1_000_000, piece_limit: int = 600_000):
        self.findall = regex.compile(pattern).findall
        self.encode_pieces = encode_pieces
        self.chunk_limit, self.piece_limit = chunk_limit, piece_limit
        self._forget_pieces()
        self._forget_chunks()

    def _forget_pieces(self) -> None:
        self.pieces = pa.array([SEPARATOR], pa.string())      # a separator between chunks has no ids
        self.piece_ids = Ragged()
        self.piece_ids.extend(np.empty(0, np.int32), np.zeros(1, np.int64))

    def _forget_chunks(self) -> None:
        self.known = pa.array([], pa.binary())      # chunks after a space, without it
        self.place = np.empty(0, np.int64)          # their indexes in ``chunks``; -1: no cut after this one
        self.chunks = Ragged()
        self.chunks.extend(np.empty(0, np.int32), np.zeros(1, np.int64))      # 0: no ids

    def _ids(self, found: list[str], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each chunk) of matches in a row, of which chunk k has those before ``ends[k]``."""
        matches = pa.array(found, pa.string()).dictionary_encode()
        place = pc.index_in(matches.dictionary, value_set=self.pieces).to_numpy(zero_copy_only=False)
        new = np.isnan(place)
        if new.any():
            pieces = matches.dictionary.filter(pa.array(new))
            place[new] = self.piece_ids.extend(*self.encode_pieces(
                [SEPARATOR if p == OWN else p for p in pieces.to_pylist()])) + np.arange(len(pieces))
            self.pieces = pa.concat_arrays([self.pieces, pieces])
        flat, count = self.piece_ids.take(place.astype(np.int64)[matches.indices.to_numpy()])
        return flat, np.diff(np.concatenate([[0], np.cumsum(count)])[ends], prepend=0)

    def _add(self, tails: pa.Array, heads: pa.Array) -> np.ndarray:
        """Ids of the chunks (tails follow a space, heads begin a text) go into ``self.chunks``; returns their indexes there
        (-1: no cut after this one), tails first."""
        texts = [" " + c for c in _strings(tails)]
        first_head = len(texts)
        texts += _strings(heads)
        into = np.full(len(texts), -1, np.int64)
        white = WHITE
        many = [k for k, c in enumerate(texts) if len(c) > (k < first_head) and c[-1] not in white
                and c[k < first_head] not in white and SEPARATOR not in c]
        if many:
            some = texts if len(many) == len(texts) else [texts[k] for k in many]
            found = self.findall(SEPARATOR.join(some))
            # a chunk ends with the match that ends with its last character
            chars = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1) - 1
            ends = np.searchsorted(np.cumsum(np.fromiter(map(len, found), np.int64, len(found))), chars) + 1
            at = self.chunks.extend(*self._ids(found, ends))
            into[many] = np.arange(at, at + len(many))
        if len(many) < len(texts):
            rest = [k for k, c in enumerate(texts) if into[k] < 0 and len(c) > (k < first_head) and c[-1] not in white]
            into[rest] = self._add_apart([texts[k] for k in rest])
        return into

    def _add_apart(self, texts: list[str]) -> np.ndarray:
        """Like ``_add``, each text matched by itself."""
        found, ends = [], []
        for t in texts:
            matches = self.findall(t)
            found += [OWN if p == SEPARATOR else p for p in matches] if SEPARATOR in matches else matches
            ends.append(len(found))
        if not texts:
            return np.empty(0, np.int64)
        return np.arange(len(texts)) + self.chunks.extend(*self._ids(found, np.array(ends)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each); null is an empty text."""
        if len(self.pieces) > self.piece_limit:
            self._forget_pieces()
        # chunks that begin a text lie among the ids as well, though they are not looked up again
        if len(self.known) > self.chunk_limit or self.chunks.used > 8 * self.chunk_limit:
            self._forget_chunks()
        if not len(texts):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        raw = pc.fill_null(texts.cast(pa.binary()), b"")
        cut = pc.split_pattern(raw, " ")
        starts = cut.offsets.to_numpy().astype(np.int64)
        head = np.zeros(len(cut.values), bool)
        head[starts[:-1]] = True
        tails = cut.values.filter(pa.array(~head)).dictionary_encode()
        place = pc.index_in(tails.dictionary, value_set=self.known).to_numpy(zero_copy_only=False)
        new = np.isnan(place)
        chunks = tails.dictionary.filter(pa.array(new))
        kept = self.chunks.n, self.chunks.used      # until the chunks of this call are known
        into = self._add(chunks, cut.values.filter(pa.array(head)))
        if len(chunks):
            self.place = np.concatenate([self.place, into[:len(chunks)]])
            place[new] = np.arange(len(self.known), len(self.known) + len(chunks))
            self.known = pa.concat_arrays([self.known, chunks])
            kept = self.chunks.n, self.chunks.used
        which = np.empty(len(head), np.int64)
        which[~head] = self.place[place.astype(np.int64)][tails.indices.to_numpy()]
        which[head] = into[len(chunks):]
        uncut = np.unique(np.searchsorted(starts, np.nonzero(which < 0)[0], side="right") - 1).tolist()
        for k, at in zip(uncut, self._add_apart([raw[k].as_py().decode("utf-8", "replace") for k in uncut])):
            which[starts[k]:starts[k + 1]] = 0
            which[starts[k]] = at
        flat, count = self.chunks.take(which)
        self.chunks.n, self.chunks.used = kept
        ends = np.concatenate([[0], np.cumsum(count)])
        return flat, np.diff(ends[starts])


def slices(batch: pa.RecordBatch, text: int, most: int = 4 << 20):
    """``batch`` in slices of about ``most`` bytes of its column ``text`` (one row at least). What Arrow has freed
    goes back to the system after each: it would add up to hundreds of MB in a worker that lives long."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lo, ends = 0, np.cumsum(sizes)
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield batch.slice(lo, hi - lo)
        pa.default_memory_pool().release_unused()
        lo = hi
