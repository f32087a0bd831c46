"""All segmentations of many words at once, under a vocabulary of weighted pieces.

A word is a row of bytes that begins with a space (the mark of a word's start);
every byte is a piece too, so each word has a segmentation. Words of one length
are handled together: for each start and piece length one vector operation over
all of them finds the pieces, and the recursions run in log space.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, inf, log1p

import numpy as np

_BASE = np.uint64(0xD6E8FEB86659FD93)
_BITS = 20
#: Words of a length that are handled together.
GROUP = 20_000
#: Longer words are handled one by one, in time and memory that grow with their length.
LONG = 1000


def vocabulary_pieces(model_file: str) -> tuple[list[bytes], np.ndarray]:
    """The pieces of a sentencepiece vocabulary as bytes (word starts as a space) and its scores; each byte is a piece at least with the lowest score."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    found: dict[bytes, float] = {}
    for k in range(sp.get_piece_size()):
        if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k)):
            piece = sp.id_to_piece(k)
            surface = (b" " + piece[1:].encode()) if piece.startswith("▁") else piece.encode()
            if b" " not in surface[1:]:
                found.setdefault(surface, sp.get_score(k))
    low = min(found.values()) - 1
    for b in range(256):
        found.setdefault(bytes([b]), low)
    return list(found), np.array(list(found.values()))


class Lattice:
    """Pieces by the hash of their bytes. Prefixes of pieces are in the tables too, so a search stops where no piece goes on."""

    def __init__(self, pieces: list[bytes]):
        self.longest = max(map(len, pieces))
        known: dict[bytes, int] = {p[:k]: -1 for p in pieces for k in range(1, len(p))}
        known |= {p: k for k, p in enumerate(pieces)}
        self.hashes = np.zeros(len(known) + 1, np.uint64)
        self.piece = np.full(len(known) + 1, -1, np.int32)
        with np.errstate(over="ignore"):
            for k, (p, i) in enumerate(known.items()):
                h = np.uint64(0)
                for b in p:
                    h = (h + np.uint64(b + 1)) * _BASE
                self.hashes[k], self.piece[k] = h, i
        self.tables = [np.full(1 << _BITS, len(known), np.int32) for _ in range(3)]
        left = np.arange(len(known))
        for t, table in enumerate(self.tables):
            at = self._at(self.hashes[left], t)
            table[at] = left
            left = left[table[at] != left]
        if len(left):
            raise ValueError("piece hashes collide")

    @staticmethod
    def _at(h: np.ndarray, t: int) -> np.ndarray:
        return (h >> np.uint64((44, 24, 4)[t])) & np.uint64((1 << _BITS) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """For each hash its place among the pieces and prefixes, or the place after the last."""
        k = self.tables[0][self._at(h, 0)]
        for t in (1, 2):
            miss = np.flatnonzero(self.hashes[k] != h)
            k[miss] = self.tables[t][self._at(h[miss], t)]
        k[self.hashes[k] != h] = len(self.hashes) - 1
        return k

    def _edges(self, rows: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        n = rows.shape[1]
        codes = rows.T.astype(np.uint64) + np.uint64(1)
        for i in range(n):
            who, h = np.arange(len(rows)), np.zeros(len(rows), np.uint64)
            for j in range(i, min(n, i + self.longest)):
                h = (h + codes[j][who]) * _BASE
                k = self.find(h)
                on = np.flatnonzero(k < len(self.hashes) - 1)
                if not len(on):
                    break
                who, h, piece = who[on], h[on], self.piece[k[on]]
                whole = np.flatnonzero(piece >= 0)
                if len(whole):
                    yield i, j + 1, who[whole], piece[whole]

    def forward(self, rows: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """log p of each row, summed over its segmentations."""
        if rows.shape[1] > LONG:
            return np.array([self._long(r, logp)[3][-1] for r in rows])
        return self._forward(rows, logp, None)[:, -1]

    def _long(self, row: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
        """(starts, ends, pieces) of the edges of one long row by start, and log p up to each place: pieces are found for all starts at once."""
        codes = row.astype(np.uint64) + np.uint64(1)
        who, h = np.arange(len(row)), np.zeros(len(row), np.uint64)
        found = []
        for n in range(self.longest):
            on = who + n < len(row)
            who, h = who[on], h[on]
            h = (h + codes[who + n]) * _BASE
            k = self.find(h)
            on = np.flatnonzero(k < len(self.hashes) - 1)
            if not len(on):
                break
            who, h, piece = who[on], h[on], self.piece[k[on]]
            whole = np.flatnonzero(piece >= 0)
            found.append((who[whole], who[whole] + n + 1, piece[whole]))
        start, end, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(start, kind="stable")
        start, end, piece = start[order], end[order], piece[order]
        return start, end, piece, self._sums(len(row), start.tolist(), end.tolist(), logp[piece].tolist())

    @staticmethod
    def _sums(n: int, start: list[int], end: list[int], lp: list[float]) -> list[float]:
        """log of the sums over paths from place 0 to each place; edges come by start."""
        a = [0.0] + [-inf] * n
        for i, j, w in zip(start, end, lp, strict=True):
            x, y = a[i] + w, a[j]
            a[j] = x if y == -inf else x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))
        return a

    def _forward(self, rows: np.ndarray, logp: np.ndarray, keep: list | None) -> np.ndarray:
        a = np.full((len(rows), rows.shape[1] + 1), -np.inf)
        a[:, 0] = 0
        for i, j, who, piece in self._edges(rows):
            if keep is not None:
                keep.append((i, j, who, piece))
            a[who, j] = np.logaddexp(a[who, j], a[who, i] + logp[piece])
        return a

    def expected(self, rows: np.ndarray, times: np.ndarray, logp: np.ndarray, out: np.ndarray) -> None:
        """Add how often each piece is expected in rows that occur so many times."""
        if rows.shape[1] > LONG:
            for r, t in zip(rows, times, strict=True):
                start, end, piece, up = self._long(r, logp)
                order = np.argsort(-end, kind="stable")
                down = self._sums(len(r), (len(r) - end[order]).tolist(), (len(r) - start[order]).tolist(), logp[piece[order]].tolist())
                p = np.exp(np.array(up)[start] + logp[piece] + np.array(down)[len(r) - end] - up[-1])
                out += np.bincount(piece, p * t, len(out))
            return
        edges: list = []
        a = self._forward(rows, logp, edges)
        b = np.full_like(a, -np.inf)
        b[:, -1] = 0
        for i, j, who, piece in reversed(edges):
            b[who, i] = np.logaddexp(b[who, i], b[who, j] + logp[piece])
        for i, j, who, piece in edges:
            p = np.exp(a[who, i] + logp[piece] + b[who, j] - a[who, -1])
            out += np.bincount(piece, p * times[who], len(out))

    @staticmethod
    def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, rows) of the words, each with a space before it, by length."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for at in np.split(order, cuts):
            n = int(lengths[at[0]]) + 1
            step = max(1, min(GROUP, 4_000_000 // (n * n)))
            for k in range(0, len(at), step):
                some = at[k : k + step]
                yield some, np.frombuffer(b" " + b" ".join([words[x] for x in some]), np.uint8).reshape(len(some), n)
