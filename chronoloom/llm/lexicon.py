"""Texts cut into segments that a tokenizer treats each by itself, and what is known of segments, by number.

A cut is safe where no token can hold the two bytes beside it. Candidates lie before a space or a
line end that follows something solid, after a line end, and between an ASCII letter or digit and
a mark. The regular expression of byte-level tokenizers always splits there; a piece model cannot
join two bytes that no piece holds side by side, which together_in() reads from its vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Segments that a worker remembers, and bytes of text looked at together.
REMEMBER, WINDOW = 400_000, 1 << 21
SPACE = "▁"
_MARKS, _ALNUM, _INK = (np.zeros(256, bool) for _ in range(3))
_MARKS[list(b".,;:!?")] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_INK[33:127] = True


def together_in(pieces: Iterable[str]) -> np.ndarray:
    """together[x, y]: some piece, or some single character, holds byte y right after byte x; a space may be written either way."""
    out = np.zeros((256, 256), bool)
    out[:, 0x80:0xC0] = True  # inside a character
    ends = lambda c, k: [c.encode()[k]] + [32] * (c == SPACE)
    for piece in pieces:
        for p, q in zip(piece, piece[1:]):
            for x in ends(p, -1):
                out[x, ends(q, 0)] = True
    return out


def _safe(raw: np.ndarray, together: np.ndarray) -> np.ndarray:
    """Where a cut before the byte is safe; the first two bytes are context only."""
    x, y, p = raw[1:-1], raw[2:], raw[:-2]
    white = (p == 0xC2) & ((x == 0x85) | (x == 0xA0)) | (p == 0x80) & ((x <= 0x8B) | (x == 0xA8) | (x == 0xA9) | (x == 0xAF))
    white |= (p == 0x81) & (x == 0x9F) | (p == 0x9A) & (x == 0x80) | (p == 0xA0) & (x == 0x8E)
    solid = _INK[x] | (x >= 0x80) & ~white
    out = ((y == 32) | (y == 10)) & solid | (x == 10) & _INK[y] | _ALNUM[x] & _MARKS[y]
    at = np.flatnonzero(out)
    out[at[together[x[at], y[at]]]] = False
    return out


def segments(raw: np.ndarray, begins: np.ndarray, together: np.ndarray | None, window: int = WINDOW) -> Iterator[np.ndarray]:
    """The borders of the segments of texts that begin at begins (all bytes belong to one), window by window.

    The last border of one window is the first of the next. together None: texts are not cut.
    """
    n, at = len(raw), 0
    starts = np.zeros(n, bool)
    starts[begins] = True
    while at < n:
        size = window
        while True:
            end = min(n, at + size)
            cut = starts[at:end].copy()
            if together is not None:
                low = max(0, at - 2)
                part = np.concatenate([np.full(2 - (at - low), 32, np.uint8), raw[low:end]])
                cut |= _safe(part, together)
            cut[0] = True
            found = np.flatnonzero(cut) + at
            if end == n:
                found = np.append(found, n)
            if len(found) > 1:
                break
            size *= 2
        yield found
        at = int(found[-1])


class Lexicon:
    """Numbers of segments; learn(new segments) is called once for each, in the order of their numbers."""

    def __init__(self, learn: Callable[[list[bytes]], None]):
        self.learn, self.numbers = learn, {}

    def look_up(self, raw: np.ndarray, borders: np.ndarray) -> np.ndarray:
        col = pa.Array.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = col.dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.numbers]
        if new:
            self.learn(new)
            self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new))))
        table = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        return table[coded.indices.to_numpy()]

    def full(self) -> bool:
        return len(self.numbers) > REMEMBER


class Pool:
    """Rows of numbers of different lengths, in parallel columns, gathered by row."""

    def __init__(self, *kinds):
        self.n, self.used = 0, 0
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flats = [np.zeros(1 << 14, k) for k in kinds]

    def put(self, sizes: np.ndarray, *flats: np.ndarray) -> None:
        n, m = len(sizes), int(sizes.sum())
        while self.n + n > len(self.size):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while self.used + m > len(self.flats[0]):
            self.flats = [np.concatenate([x, np.zeros_like(x)]) for x in self.flats]
        for mine, new in zip(self.flats, flats):
            mine[self.used : self.used + m] = new
        self.size[self.n : self.n + n] = sizes
        self.start[self.n : self.n + n] = self.used + np.cumsum(sizes) - sizes
        self.n, self.used = self.n + n, self.used + m

    def get(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """The sizes of the rows, then each column's values one after another."""
        size = self.size[rows]
        at = np.cumsum(size) - size
        where = np.repeat(self.start[rows] - at, size) + np.arange(int(size.sum()))
        return size, *(f[where] for f in self.flats)


def spaced(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts raw[off[k]:off[k + 1]] with a space before each that is not empty, and their offsets."""
    size = np.diff(off)
    wide = size + (size > 0)
    new = np.concatenate(([0], np.cumsum(wide)))
    out = np.full(int(new[-1]), 32, np.uint8)
    mask = np.ones(len(out), bool)
    mask[new[:-1][size > 0]] = False
    out[mask] = raw
    return out, new
