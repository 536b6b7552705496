"""Vectorised word and shingle hashing over the bytes of an Arrow string column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_SHORT = _rng.integers(0, 2**64, 17, dtype=U)
_LANE = _rng.integers(0, 2**64, 16, dtype=U) | U(1)
_NEXT = U(0x9E3779B97F4A7C15)
#: The lowest 0 to 8 bytes of a 64-bit number.
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U)

#: Bytes after folding A-Z; 0 marks white space (0x20, 0x09-0x0D), a zero byte keeps a code of its own below.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def eights(raw: np.ndarray) -> np.ndarray:
    """For each place of raw the eight bytes from there on as one number; zeros follow the end."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))


def run_hashes(view: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of bytes, eight at a time, each step mixed: no sum that texts could cancel."""
    out = mix(mix(sizes.astype(U)) ^ (view[starts] & LOW_BYTES[np.minimum(sizes, 8)]))
    at, more = 8, np.flatnonzero(sizes > 8)
    while len(more):
        left = sizes[more] - at
        out[more] = mix(out[more] * _NEXT + (view[starts[more] + at] & LOW_BYTES[np.minimum(left, 8)]))
        at, more = at + 8, more[left > 8]
    return out


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(col) else np.zeros(0, np.uint8)
    return raw, off - off[0]


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word, ASCII letters folded, and the number of words of each text.

    Works through the bytes in pieces that end where a word or a text ends, so memory is bounded by
    PIECE or the longest word.
    """
    hashes, firsts = [], []
    n, at = len(raw), 0
    while at < n:
        end = min(n, at + PIECE)
        if end < n:
            cut = np.flatnonzero(_SPACE[raw[at:end]])
            border = off[np.searchsorted(off, end, "right") - 1]
            if len(cut) or border > at:
                end = max(at + int(cut[-1]) + 1 if len(cut) else 0, int(border))
            else:
                while end < n and not _SPACE[raw[end]] and off[np.searchsorted(off, end)] != end:
                    end += 1
        part = raw[at:end]
        word = ~_SPACE[part]
        inner = off[np.searchsorted(off, at) : np.searchsorted(off, end)] - at
        before = np.empty(len(part), bool)
        before[0] = False
        before[1:] = word[:-1]
        before[inner[inner < len(part)]] = False
        starts = np.flatnonzero(word & ~before)
        after = np.empty(len(part), bool)
        after[-1] = False
        after[:-1] = word[1:] & before[1:]
        ends = np.flatnonzero(word & ~after) + 1
        hashes.append(run_hashes(eights(_FOLD[part]), starts, ends - starts))
        firsts.append(starts + at)
        at = end
    if not hashes:
        return np.zeros(0, U), np.zeros(len(off) - 1, np.int64)
    where = np.concatenate(firsts)
    return np.concatenate(hashes), np.searchsorted(where, off[1:]) - np.searchsorted(where, off[:-1])


def shingle_sets(col: pa.Array, k: int):
    """For each text in turn its set of k-word shingles as sorted distinct hashes.

    A text with fewer words has its whole sequence as the only shingle; one without words has none.
    """
    raw, off = string_bytes(col)
    words, counts = word_hashes(raw, off)
    at = 0
    for n in counts.tolist():
        w = words[at : at + n]
        at += n
        if not n:
            yield np.zeros(0, U)
        elif n < k:
            yield mix((w * _LANE[:n]).sum(dtype=U, keepdims=True) + _SHORT[n : n + 1])
        else:
            s = w[: n - k + 1] * _LANE[0]
            for j in range(1, k):
                s = s + w[j : n - k + 1 + j] * _LANE[j]
            yield np.unique(mix(s))
