"""Token ids in a compressed binary file: Re-Pair grammars per shard, with random access.

Texts are encoded by the tokenizer file and end with END. A shard is a run of whole documents in
ascending doc_id. Its ids are compressed by Re-Pair: the most frequent pairs of neighbouring
symbols, counted exactly, become nonterminals, round after round, until no pair is frequent or the
16-bit symbols run out. A pair never spans two documents. A shard's row holds

    rules      uint16 pairs; rule r stands for symbol base + r
    lengths    uint32, the number of ids that each rule expands to
    symbols    uint16, all documents' compressed symbols one after another
    ends       uint32, where each document's symbols end
    doc_ids, counts   per document: its id and its number of ids

and first, the number of ids of the same part before it. Symbols are 16 bits: an id beyond base - 1
cannot occur, and a shard has at most 65535 - base rules.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import documents, stash
from chronoloom.llm.texthash import LOW_BYTES, U, eights, mix, run_hashes, string_bytes

END = 2
#: Ids of a shard, beyond which it is closed at the next document's end.
SHARD_IDS = 1 << 18
#: A pair becomes a rule if it occurs at least so often in a shard; pairs of a round.
LEAST, PAIRS = 8, 4096
#: Pieces of texts whose ids a worker remembers.
REMEMBER = 1_500_000
#: Documents whose pieces are encoded before the tasks start, and the longest of them in bytes.
WARM_DOCS, WARM_BYTES = 2000, 8000

FILE_SCHEMA = "part int, first long, rules binary, lengths binary, symbols binary, ends binary, doc_ids array<long>, counts array<long>, base int"

#: White space outside ASCII and the start of a special token: such texts are encoded in one piece.
_RARE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|<\\|")
#: Kinds of bytes, to be looked up by bytes.translate(). A first byte of TWO and a SECOND one are a letter of Latin-1 or Latin Extended-A.
SPACE, ALNUM, LETTER, MARK, TWO, SECOND, LEAD = (1 << k for k in range(7))
_kind = np.zeros(256, np.uint8)
_kind[[9, 10, 11, 12, 13, 32]] |= SPACE
_kind[[*range(48, 58), *range(65, 91), *range(97, 123)]] |= ALNUM
_kind[[*range(65, 91), *range(97, 123)]] |= LETTER
_kind[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] |= MARK
_kind[[0xC3, 0xC4, 0xC5]] |= TWO
_kind[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] |= SECOND
_kind[[0xC2, 0xE1, 0xE2, 0xE3, ord("<")]] |= LEAD
_KIND = _kind.tobytes()
#: The character that byte-level vocabularies write for each byte.
_own = [*range(33, 127), *range(161, 173), *range(174, 256)]
_CHARS = np.zeros(256, np.uint32)
_CHARS[_own] = _own
_CHARS[[x for x in range(256) if x not in _own]] = 256 + np.arange(256 - len(_own))
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


class Table:
    """An open hash table from 64-bit keys to entries; the keys are mixed already."""

    def __init__(self):
        self.bits, self.n = 18, 0
        self.keys, self.slots = np.zeros(1 << 18, U), np.full(1 << 18, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 if there is none."""
        mask = np.int64((1 << self.bits) - 1)
        at = (keys >> U(64 - self.bits)).astype(np.int64)
        out = self.slots[at]
        odd = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(odd):
            at[odd] = (at[odd] + 1) & mask
            got = self.slots[at[odd]]
            out[odd] = got
            odd = odd[(got >= 0) & (self.keys[at[odd]] != keys[odd])]
        return out

    def put(self, keys: np.ndarray, entries: np.ndarray) -> None:
        """keys: distinct and not in the table."""
        self.n += len(keys)
        if 2 * self.n > 1 << self.bits:
            held = self.slots >= 0
            keys, entries = np.concatenate([self.keys[held], keys]), np.concatenate([self.slots[held], entries])
            while 2 * self.n > 1 << self.bits:
                self.bits += 1
            self.keys, self.slots = np.zeros(1 << self.bits, U), np.full(1 << self.bits, -1, np.int32)
        mask = np.int64((1 << self.bits) - 1)
        at = (keys >> U(64 - self.bits)).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.slots[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.slots[at[won]] = keys[won], entries[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, entries, at = keys[rest], entries[rest], (at[rest] + 1) & mask


def _kinds(raw: np.ndarray) -> np.ndarray:
    return np.frombuffer(raw.tobytes().translate(_KIND), np.uint8)


def _parted(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, mark: int) -> np.ndarray:
    """raw[s : s + n] for each start and size, with the byte mark between two."""
    ends = np.cumsum(sizes + 1)
    text = raw[np.minimum(np.repeat(starts - ends + sizes + 1, sizes + 1) + np.arange(ends[-1]), len(raw) - 1)]
    text[ends - 1] = mark
    return text[:-1]


def _gather(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """raw[s : s + n] for each start and size, one after another."""
    at = np.cumsum(sizes) - sizes
    return raw[np.repeat(starts - at, sizes) + np.arange(int(sizes.sum()))]


class Encoder:
    """Ids of texts, the same as of encoding each text whole, from pieces encoded once.

    The pre-tokenizer always splits before white space that follows something else, on both sides
    of a single line end, and between a letter or digit and an ASCII mark. Merges never cross its
    splits, so texts are cut there, in their bytes. A piece of up to seven bytes is its own key; a
    longer one is looked up by a hash and then compared byte by byte with the piece found. New pieces
    that are one word of plain letters, with or without a space before, are given to the tokenizer as
    split already; the bytes of the ids show where each begins. Others are encoded together, a line
    each; the line end's id shows where each begins. At REMEMBER pieces all are forgotten.
    """

    def __init__(self, path: str, base: tuple | None = None):
        """base: what known() of another encoder of the same file gave."""
        from tokenizers import Tokenizer

        self.base_known = base
        self.tokenizer = Tokenizer.from_file(path)
        self.base = max(self.tokenizer.get_vocab_size(), END + 1)
        if self.base >= 1 << 16:
            raise ValueError("the vocabulary needs more than 16 bits")
        (self.line,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        form = json.loads(self.tokenizer.to_str())
        self.words = None
        if form["normalizer"] is None and form["pre_tokenizer"] == _BYTE_LEVEL:
            self.words = Tokenizer.from_file(path)
            self.words.pre_tokenizer = None
            #: Of each id: how many bytes it stands for.
            self.spell = np.zeros(self.base, np.int64)
            for piece, k in self.words.get_vocab().items():
                self.spell[k] = len(piece)
        self._forget()

    def _forget(self) -> None:
        self.short, self.long = Table(), Table()
        self.n, self.used, self.held = 1, 1, 0
        #: Of each entry: where its ids start and how many; where its bytes start and how many.
        self.start, self.size, self.where, self.width = (np.zeros(1 << 16, np.int32) for _ in range(4))
        self.pool, self.bytes = np.zeros(1 << 20, np.uint16), np.zeros(1 << 20, np.uint8)
        self.pool[0], self.size[0] = END, 1  # entry 0: the end of a document
        if self.base_known:
            sizes, flat, widths, raw = self.base_known
            entries = self._store(sizes, flat, widths, raw)
            keys = self._keys(eights(raw), np.cumsum(widths) - widths, widths)
            for table, mine in ((self.short, widths < 8), (self.long, widths >= 8)):
                table.put(keys[mine], entries[mine])

    def known(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all pieces in the order learned: their numbers of ids, ids, numbers of bytes, bytes."""
        return self.size[1 : self.n].astype(np.int64), self.pool[1 : self.used], self.width[1 : self.n].astype(np.int64), self.bytes[: self.held]

    @staticmethod
    def _keys(view: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        keys = mix(view[starts] & LOW_BYTES[np.minimum(sizes, 7)] | sizes.astype(U) << U(56))
        big = np.flatnonzero(sizes >= 8)
        keys[big] = run_hashes(view, starts[big], sizes[big])
        return keys

    def _learn(self, raw: np.ndarray, a: np.ndarray, b: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Encode the pieces raw[a:b] and give their entries; whole marks where pieces with rare characters start."""
        n = b - a
        text, at = _gather(raw, a, n), np.cumsum(n) - n
        kind = _kinds(text)
        space, wordy = kind & SPACE > 0, kind & (LETTER | TWO | SECOND) > 0
        lead = (text[at] == 32) & (n > 1)
        wordy[at] |= lead
        odd = space[at] & ~lead
        space[at] = False
        word = np.logical_and.reduceat(wordy, at) & (self.words is not None)
        # these can stand on a line of their own
        plain = ~(odd | np.logical_or.reduceat(space, at) | whole[a] | word)
        order, flats, sizes = [], [], []
        words, lines, rest = np.flatnonzero(word), np.flatnonzero(plain), [np.flatnonzero(~word & ~plain)]
        for k in range(0, len(words), 2048):
            part = words[k : k + 2048]
            ids, ends = self._words(raw, a[part], n[part])
            if ids is None:
                rest.append(part)
            else:
                order.append(part)
                flats.append(ids)
                sizes.append(np.diff(ends, prepend=0))
        for k in range(0, len(lines), 2048):
            part = lines[k : k + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast([_parted(raw, a[part], n[part], 10).tobytes().decode()], add_special_tokens=False)[0].ids, np.uint16)
            cuts = np.flatnonzero(ids == self.line)
            if len(cuts) == len(part) - 1:
                order.append(part)
                flats.append(ids[ids != self.line])
                sizes.append(np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1)
            else:
                rest.append(part)
        rest = np.concatenate(rest)
        names = [raw[x:y].tobytes().decode() for x, y in zip(a[rest].tolist(), b[rest].tolist())]
        for e in self.tokenizer.encode_batch_fast(names, add_special_tokens=False):
            flats.append(np.array(e.ids, np.uint16))
            sizes.append(np.array([len(flats[-1])]))
        order = np.concatenate([*order, rest])
        out = np.empty(len(a), np.int32)
        out[order] = self._store(np.concatenate(sizes), np.concatenate(flats), n[order], _gather(raw, a[order], n[order]))
        return out

    def _words(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None]:
        """The ids of words and where each word's end, or None if the ids do not spell all their bytes."""
        text = _parted(raw, starts, sizes, 10)
        chars = _CHARS[text]
        chars[text == 10] = 32
        words = chars.tobytes().decode("utf-32-le").split(" ")
        ids = np.array(self.words.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint16)
        upto, ends = np.cumsum(self.spell[ids]), np.cumsum(sizes)
        at = np.searchsorted(upto, ends)
        if len(upto) and upto[-1] == ends[-1] and (upto[at] == ends).all():
            return ids, at + 1
        return None, None

    def _store(self, sizes: np.ndarray, flat: np.ndarray, widths: np.ndarray, raw: np.ndarray) -> np.ndarray:
        n = len(sizes)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.held + len(raw) > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        while self.n + n > len(self.size):
            self.start, self.size, self.where, self.width = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.where, self.width))
        new = slice(self.n, self.n + n)
        self.pool[self.used : self.used + len(flat)], self.bytes[self.held : self.held + len(raw)] = flat, raw
        self.start[new], self.size[new] = self.used + np.cumsum(sizes) - sizes, sizes
        self.where[new], self.width[new] = self.held + np.cumsum(widths) - widths, widths
        self.used, self.held, self.n = self.used + len(flat), self.held + len(raw), self.n + n
        return np.arange(self.n - n, self.n, dtype=np.int32)

    def _differ(self, entry: np.ndarray, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which of the pieces are not, byte by byte, those of their entries."""
        odd = self.width[entry] != sizes
        same = np.flatnonzero(~odd)
        view, mine = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, 0, (1,)), eights(raw)
        # the last eight bytes first, then eights from the start: pieces have eight bytes or more
        at, back = self.where[entry[same]].astype(np.int64), sizes[same] - 8
        odd[same] = view[at + back] != mine[starts[same] + back]
        done = 0
        while len(same):
            more = sizes[same] - 8 > done
            same, at = same[more], at[more]
            odd[same] |= view[at + done] != mine[starts[same] + done]
            done += 8
        return np.flatnonzero(odd)

    def _entries(self, table: Table, keys: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray, exact: bool) -> np.ndarray:
        """The entries of the pieces raw[starts:ends] by their keys, learned where they are new."""
        entry = table.find(keys)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            new, first = np.unique(keys[miss], return_index=True)
            first = miss[first]
            table.put(new, self._learn(raw, starts[first], ends[first], whole))
            entry[miss] = table.find(keys[miss])
        if not exact:
            odd = self._differ(entry, raw, starts, ends - starts)
            if len(odd):  # another piece has the same hash: these are encoded each time they occur
                entry[odd] = self._learn(raw, starts[odd], ends[odd], whole)
        return entry

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, each text's followed by END, and their counts."""
        raw, off = string_bytes(texts)
        if self.n > REMEMBER or self.used > 16 * REMEMBER:
            self._forget()
        first = np.zeros(len(raw), bool)
        first[off[:-1][off[:-1] < len(raw)]] = True
        kind = _kinds(raw)
        space = (kind & SPACE).view(bool)
        before = np.concatenate(([False], space[:-1])) & ~first
        cut = space & ~before
        line = cut & (raw == 10)
        after = np.flatnonzero(line[:-1] & ~space[1:]) + 1
        if len(raw) > 1:
            last = kind & ALNUM > 0
            last[1:] |= (kind[1:] & SECOND > 0) & (kind[:-1] & TWO > 0)
            cut[1:] |= (kind[1:] & MARK > 0) & last[:-1]
        cut[after] = True
        cut |= first
        lead = np.flatnonzero(kind & LEAD)
        whole = np.zeros(len(raw) + 1, bool)
        for k in np.unique(np.searchsorted(off, lead, "right") - 1).tolist():
            if _RARE.search(raw[off[k] : off[k + 1]].tobytes().decode()):
                cut[off[k] + 1 : off[k + 1]] = False
                whole[off[k]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(raw)) if len(starts) else starts
        sizes = ends - starts
        keys = self._keys(eights(raw), starts, sizes)
        entry = np.empty(len(keys), np.int32)
        for table, mine, exact in ((self.short, np.flatnonzero(sizes < 8), True), (self.long, np.flatnonzero(sizes >= 8), False)):
            entry[mine] = self._entries(table, keys[mine], raw, starts[mine], ends[mine], whole, exact)
        # entry 0 ends each text
        upto = np.searchsorted(starts, off[1:])
        entry = np.insert(entry, upto, 0)
        size = self.size[entry].astype(np.int64)
        at = np.cumsum(size) - size
        ids = self.pool[np.repeat(self.start[entry] - at, size) + np.arange(int(size.sum()))]
        done = np.cumsum(size)[upto + np.arange(len(upto))]
        return ids, np.diff(done, prepend=0)


def _frequent(seq: np.ndarray, live: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a round, most frequent first, and of each place: the number of its pair among them
    from 1 on, 0xFFFF for other frequent pairs, else 0. Pairs are counted at the live places."""
    rank = np.zeros(len(seq), np.uint16)
    at = np.flatnonzero(live)
    order = seq[at].astype(np.uint64)
    order <<= np.uint64(16)
    order |= seq[1:][at]
    order <<= np.uint64(32)
    order |= at.view(np.uint64)
    del at
    order.sort()
    places = order.astype(np.uint32)
    order >>= np.uint64(32)
    keys = order.astype(np.uint32)
    del order
    same = keys[LEAST - 1 :] == keys[: 1 - LEAST]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False]))))
    first = edge[::2]  # of each frequent pair
    if not len(first):
        return keys[:0], rank
    count = edge[1::2] - first + LEAST - 1
    top = np.argsort(-count, kind="stable")[:most]
    # a round stops where pairs are so rare that the first ones' replacement may have changed them
    top = top[count[top] * 32 >= count[top[0]]]
    name = np.full(len(first), 0xFFFF, np.uint16)
    name[top] = np.arange(1, len(top) + 1)
    run = np.zeros(len(keys) + 1, np.int8)
    run[first] += 1
    run[first + count] -= 1
    rank[places[np.cumsum(run[:-1], dtype=np.int8).view(bool)]] = np.repeat(name, count)
    return keys[first[top]], rank


def _apart(at: np.ndarray) -> np.ndarray:
    """Of places that follow one another every second one from the left."""
    start = np.flatnonzero(np.concatenate(([True], at[1:] - at[:-1] > 1)))
    if len(start) == len(at):
        return at
    odd = at & 1 > 0
    return at[odd == np.repeat(odd[start], np.diff(start, append=len(at)))]


def repair(ids: np.ndarray, last: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rules, lengths, symbols, ends) of uint16 ids; last marks the final id of each document.

    The number of times that a pair occurs never grows once its two symbols are there. So a round sorts
    only the places of pairs that were frequent in the round before or are new; the counts are exact.
    """
    seq, ends = ids.astype(np.uint32), np.flatnonzero(last)
    live = ~last
    room = (1 << 16) - 1 - base
    rules, lengths = np.empty((room, 2), np.uint16), np.ones(base + room, np.int64)
    n = base  # symbols so far
    while n < base + room:  # each round replaces its most frequent pair at least
        pairs, rank = _frequent(seq, live, min(PAIRS, base + room - n))
        if not len(pairs):
            break
        live = rank > 0
        at = _apart(np.flatnonzero(live & (rank <= len(pairs))))
        rank = rank[at]
        used = np.bincount(rank, minlength=len(pairs) + 1) > 0
        pairs = pairs[used[1:]]
        left, right = pairs >> np.uint32(16), pairs & np.uint32(0xFFFF)
        new = slice(n, n + len(pairs))
        rules[n - base : new.stop - base, 0], rules[n - base : new.stop - base, 1] = left, right
        lengths[new] = lengths[left] + lengths[right]
        seq[at] = (n - 1 + np.cumsum(used))[rank]
        n = new.stop
        live[at] = live[at - (at > 0)] = True
        # where the last symbol went into a pair, the pair's is the last
        gone = at + 1
        ends -= np.searchsorted(gone, ends, "right")
        keep = np.ones(len(seq), bool)
        keep[gone] = False
        seq, live = seq[keep], live[keep]
        live[ends] = False
        del at, gone, keep, rank
    return rules[: n - base].copy(), lengths[base:n].astype(np.uint32), seq.astype(np.uint16), (ends + 1).astype(np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids of some symbols: the rules are expanded once, level by level, then copied into place."""
    flat = np.arange(base, base + len(rules), dtype=np.int64)
    while True:
        big = flat >= base
        if not big.any():
            break
        width = 1 + big
        at = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.int64)
        out[at] = flat
        out[at[big]] = rules[flat[big] - base, 0]
        out[at[big] + 1] = rules[flat[big] - base, 1]
        flat = out
    table = np.concatenate([np.arange(base, dtype=np.uint16), flat.astype(np.uint16)])
    wide = lengths.astype(np.int64)
    size = np.concatenate([np.ones(base, np.int64), wide])[symbols]
    start = np.concatenate([np.arange(base), base + np.cumsum(wide) - wide])[symbols]
    at = np.cumsum(size) - size
    return table[np.repeat(start - at, size) + np.arange(int(size.sum()))]


def ids_between(row: dict, doc: int, start: int, stop: int) -> np.ndarray:
    """Random access: ids start to stop of the shard row's doc-th document, expanding only what they touch."""
    rules = np.frombuffer(row["rules"], np.uint16).reshape(-1, 2)
    lengths, ends, base = np.frombuffer(row["lengths"], np.uint32), np.frombuffer(row["ends"], np.uint32), row["base"]
    symbols = np.frombuffer(row["symbols"], np.uint16)[int(ends[doc - 1]) if doc else 0 : int(ends[doc])]
    size = np.ones(len(symbols), np.int64)
    big = symbols >= base
    size[big] = lengths[symbols[big].astype(np.int64) - base]
    after = np.cumsum(size)
    a, b = np.searchsorted(after, start, "right"), np.searchsorted(after, stop, "left")
    skip = start - (after[a] - size[a]) if a < len(symbols) else 0
    return expand(symbols[a : b + 1], rules, lengths, base)[skip : skip + max(0, stop - start)]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str, pieces, job: str) -> Encoder:
    """The worker's encoder for one job. A shipped closure gets copies of the globals that it names, but functions
    of this module by reference: so tasks find what earlier tasks of the job learned. Each job starts anew."""
    if job not in _encoders:
        _encoders.clear()
        _encoders[job] = Encoder(path, pieces.value)
    return _encoders[job]


def common_pieces(docs: DataFrame, path: str) -> tuple:
    """Pieces of some documents, encoded once for all tasks to start from: a bounded table that saves work only."""
    some = [r.text for r in docs.where(F.octet_length("text") <= WARM_BYTES).select("text").head(WARM_DOCS)]
    coder = Encoder(path)
    for at in range(0, len(some), 48):
        coder.encode(pa.array(some[at : at + 48], pa.string()))
    return coder.known()


def _write(path: str, pieces, job: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = _encoder(path, pieces, job)
        part, first = TaskContext.get().partitionId(), 0
        flats: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        names: list[int | None] = []

        def shard(n: int):
            """A shard of the first n documents held."""
            nonlocal first
            every, ids = np.concatenate(counts), np.concatenate(flats)
            mine, cut = every[:n], int(every[:n].sum())
            last = np.zeros(cut, bool)
            last[np.cumsum(mine) - 1] = True
            rules, lengths, symbols, ends = repair(ids[:cut], last, coder.base)
            row = [part, first, rules.tobytes(), lengths.tobytes(), symbols.tobytes(), ends.tobytes(), names[:n], mine.tolist(), coder.base]
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32()]
            first += cut
            flats[:], counts[:], names[:] = [ids[cut:]], [every[n:]], names[n:]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], FILE_NAMES)

        for batch in batches:
            for at in range(0, batch.num_rows, 96):
                ids, n = coder.encode(batch.column("text").slice(at, 96))
                flats.append(ids)
                counts.append(n)
                names += batch.column("doc_id").slice(at, 96).to_pylist()
                while sum(map(len, flats)) >= SHARD_IDS:
                    yield shard(int(np.searchsorted(np.cumsum(np.concatenate(counts)), SHARD_IDS)) + 1)
        if names:
            yield shard(len(names))

    return run


FILE_NAMES = [x.split()[0] for x in FILE_SCHEMA.split(", ")]


def write_tokens(docs: DataFrame, path: str) -> DataFrame:
    """The token files of docs (doc_id, text) in the shared folder, as the table read back from them.

    Parts hold ascending ranges of doc_id, null ids first, ties by a hash of the text and the text,
    so that rows of one id spread over parts too; null texts are empty and give the end id alone, and
    rows that repeat are all written. A long text is one document of its shard, however long. An empty
    table gives no file row. Other columns are ignored. path: the tokenizer file on the driver; what
    tasks need of it they read from the same path.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pieces = docs.sparkSession.sparkContext.broadcast(common_pieces(rows, path))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return stash(rows.mapInArrow(_write(path, pieces, uuid.uuid4().hex), FILE_SCHEMA), "tokens")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            rules, lengths = np.frombuffer(row["rules"], np.uint16).reshape(-1, 2), np.frombuffer(row["lengths"], np.uint32)
            flat = expand(np.frombuffer(row["symbols"], np.uint16), rules, lengths, row["base"])
            wide = memoryview(flat.astype("<u4").tobytes())
            ends = np.cumsum(row["counts"])
            starts = ends - row["counts"]
            crcs = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(ends), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["first"], pa.int64()), pa.array(row["counts"], pa.int64()), pa.array(crcs, pa.int64())], ["part", "doc_id", "inner", "n_tokens", "ids_crc32"])


def digest(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the expanded files."""
    totals = files.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before, sums = 0, []
    for part, n in sorted(map(tuple, totals.collect())):  # a number for each part
        sums.append((part, before))
        before += n
    spark = files.sparkSession
    offsets = spark.createDataFrame(sums, "part int, before long")
    docs = files.mapInArrow(_read, "part int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op1_tokens(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return digest(write_tokens(documents(spark, sf_dir), path or public_tokenizers.path("byte_bpe_50k.json")))
