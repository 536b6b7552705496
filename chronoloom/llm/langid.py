"""Language identification by cross-parsing entropy with suffix automata.

For each language the suffix automaton of its labelled text is built. A text is parsed against it
greedily: each phrase is the longest match from where the last one ended, or one letter that the
language does not have. The language whose parse needs the fewest phrases per character wins. Only
the automaton's transitions matter for that, with a failed one leading where its letter leads from
the root, so a parse is a walk. Texts are walked side by side in blocks; a block's walk first begins
afresh, then the walk of the block before goes on into it until both are in the same state, so the
count is that of one walk over the whole text.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import documents, held_out, slices, small

#: Labelled text of each language that an automaton is built of: PIECES pieces of PIECE characters, taken in hash
#: order from everywhere in all documents.
PIECE, PIECES = 400, 100
#: Characters that are walked side by side with those of other blocks; and of the texts parsed together.
BLOCK, TOGETHER = 512, 1 << 20
#: Scale from phrases per character to a score.
SHARPNESS = 40.0
UNKNOWN = "und"


def normalise(text: str) -> str:
    """Lower case; anything but letters becomes one space."""
    return " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "


def automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of text; state 0 is the root."""
    trans, link, length, last = [{}], [-1], [0], 0
    for c in text:
        cur = len(trans)
        trans.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in trans[p]:
            trans[p][c] = cur
            p = link[p]
        if p >= 0:
            q = trans[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(trans)
                trans.append(dict(trans[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and trans[p].get(c) == q:
                    trans[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return trans


class Walk:
    """Transitions of an automaton in one array: those of state s lie at base[s] + code, unless check says otherwise.

    dead is a state without transitions; from the beginning of a text and from a letter unknown to
    the language every step begins a phrase.
    """

    def __init__(self, trans: list[dict[str, int]], codes: dict[str, int]):
        width, n = len(codes) + 1, len(trans)
        self.dead = n
        self.root = np.full(width, n, np.int32)
        for c, q in trans[0].items():
            self.root[codes[c]] = q
        room = width + 2 * sum(map(len, trans)) + 2
        taken = bytearray(room + width)
        self.base = np.full(n + 1, room, np.int32)
        self.check, self.next = np.full(room + width, -1, np.int32), np.zeros(room + width, np.int32)
        rng, free = random.Random(1), width
        for s in sorted(range(n), key=lambda s: -len(trans[s])):
            cells = [codes[c] for c in trans[s]]
            if len(cells) > 1:  # anywhere that all of them fit
                at = rng.randrange(room - width)
                while any(taken[at + c] for c in cells):
                    at = rng.randrange(room - width)
            elif cells:  # the next free cell
                while taken[free]:
                    free += 1
                at = free - cells[0]
            for c, q in zip(cells, trans[s].values()):
                taken[at + c], self.check[at + c], self.next[at + c] = 1, s, q
            if cells:
                self.base[s] = at

    def step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after the letters, and where a phrase began."""
        at = self.base[state] + code
        fail = self.check[at] != state
        return np.where(fail, self.root[code], self.next[at]), fail


class Parser:
    """A walk for each language. Code 0 is a character unknown to all."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        letters = sorted({c for t in texts.values() for c in t})
        codes = {c: k + 1 for k, c in enumerate(letters)}
        self.walks = [Walk(automaton(texts[lang]), codes) for lang in self.langs]
        self.points = np.array([ord(c) for c in letters], np.uint32)

    def encode(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if not len(self.points):
            return np.zeros(len(points), np.int32)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, at + 1, 0).astype(np.int32)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that each text needs in each language; rows as texts, columns as langs."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        owner = np.repeat(np.arange(len(texts)), -(-sizes // BLOCK))
        if not len(owner):
            return out
        flat = np.concatenate(texts)
        after = np.concatenate(([False], owner[1:] == owner[:-1]))  # the block goes on with the text of the one before
        inner = np.arange(len(owner)) - np.searchsorted(owner, owner)
        begin = (np.cumsum(sizes) - sizes)[owner] + inner * BLOCK
        size = np.minimum(sizes[owner] - inner * BLOCK, BLOCK)
        order = np.argsort(-size, kind="stable")
        column = np.empty(len(order), np.int64)
        column[order] = np.arange(len(order))
        begin, size, owner, after = begin[order], size[order], owner[order], after[order]
        before = np.where(after, column[np.maximum(order - 1, 0)], -1)  # the column of the block before
        grid = np.zeros((int(size[0]), len(size)), np.int32)
        alive = np.searchsorted(-size, -np.arange(len(grid)), "left")
        for k, n in enumerate(alive.tolist()):
            grid[k, :n] = flat[begin[:n] + k]
        for lang, walk in enumerate(self.walks):
            fails, last = self._walk(walk, grid, alive, size, before)
            np.add.at(out[:, lang], owner, fails)
        return out

    @staticmethod
    def _walk(walk: Walk, grid: np.ndarray, alive: np.ndarray, size: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        states, failed = np.empty(grid.shape, np.int32), np.zeros(grid.shape, bool)
        state = np.full(grid.shape[1], walk.dead, np.int32)
        for k, n in enumerate(alive.tolist()):
            state[:n], failed[k, :n] = walk.step(state[:n], grid[k, :n])
            states[k, :n] = state[:n]
        fails, last, came = failed.sum(axis=0), state, np.full(len(size), walk.dead, np.int32)
        todo = np.flatnonzero(before >= 0)
        todo = todo[last[before[todo]] != came[todo]]
        while len(todo):  # walks that go on from the block before, until they meet the block's own
            entry = last[before[todo]]
            came[todo] = entry
            now, cols, own, k = entry.copy(), todo.copy(), np.zeros(len(todo), np.int64), 0
            place = np.arange(len(todo))
            ends = np.empty(len(todo), np.int32)
            total = np.zeros(len(todo), np.int64)
            while len(cols):
                now, fail = walk.step(now, grid[k, cols])
                own += fail
                met, out = now == states[k, cols], size[cols] == k + 1
                done = met | out
                if done.any():
                    where, c = place[done], cols[done]
                    rest = np.array([failed[k + 1 :, x].sum() if m else 0 for x, m in zip(c.tolist(), met[done].tolist())], np.int64)
                    total[where] = own[done] + rest
                    ends[where] = np.where(met[done], states[size[c] - 1, c], now[done])
                    now, cols, own, place = now[~done], cols[~done], own[~done], place[~done]
                k += 1
            fails[todo], last[todo] = total, ends
            todo = np.flatnonzero(before >= 0)
            todo = todo[last[before[todo]] != came[todo]]
        return fails, last

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        plain = [normalise(t) for t in texts]
        counts = self.phrases([self.encode(p) for p in plain])
        rate = counts / np.array([max(1, len(p)) for p in plain])[:, None]
        names, scores = [], []
        for p, r in zip(plain, rate):
            if not p.strip() or not self.langs:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(np.argmin(r))
            names.append(self.langs[best])
            scores.append(float(1 / np.exp(-SHARPNESS * (r - r[best])).sum()))
        return names, scores


def train(docs: DataFrame) -> Parser:
    """Learn from rows with a language outside the held-out fold: PIECES pieces of each in hash order.

    Pieces come from anywhere in texts of any length, so a long document is neither cut nor left out;
    rows that repeat an id teach each their own text. Null texts, null languages and an empty table
    teach nothing. The driver gets PIECES * PIECE characters of each language.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()).select("lang", "doc_id", "text", F.ceil(F.length("text") / PIECE).cast("int").alias("n")).where("n > 0")
    pieces = rows.groupBy("lang").agg(F.sum("n").alias("all"))
    # about four times the pieces that are needed, by hash, before any text is read
    bar = (F.least(F.lit(1.0), F.lit(4.0 * PIECES) / F.col("all")) * (1 << 30)).cast("long")
    keep = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.pmod(F.xxhash64(F.lit(3), F.col("doc_id"), k), F.lit(1 << 30)) < F.col("bar"))
    some = rows.join(small(pieces.select("lang", bar.alias("bar"))), "lang").select("lang", "doc_id", "text", F.explode(keep).alias("k"))
    some = some.select("lang", F.struct(F.xxhash64(F.lit(4), "doc_id", "k"), F.substring("text", F.col("k") * PIECE + 1, F.lit(PIECE)).alias("text")).alias("row"))
    picked = some.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list("row")), 1, PIECES).alias("rows"))
    return Parser({r.lang: "".join(normalise(x.text) for x in r.rows) for r in picked.collect()})


def _together(texts: list[str]) -> Iterator[list[str]]:
    part, n = [], 0
    for t in texts:
        if part and n + len(t) > TOGETHER:
            yield part
            part, n = [], 0
        part.append(t)
        n += len(t)
    if part:
        yield part


def _predict(parser):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, scores = [], []
            for part in _together([t or "" for t in batch.column("text").to_pylist()]):
                a, b = parser.value.predict(part)
                names += a
                scores += b
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, parser: Parser) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs (doc_id, text).

    `und` and 0 where the text is null or has no letter, or nothing was learned. Texts are parsed
    whole, however long; ties go to the language that sorts first; equal texts score alike, and rows
    that repeat an id are answered each. A null doc_id is held out. Other columns are ignored; an
    empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    return rows.mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, train(docs))
