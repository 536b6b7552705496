"""Alignment of two tokenizers' ids of the same text by a dangling-suffix transducer.

Reading both sides in turn, the transducer keeps which side leads and the bytes by which it leads;
the next token comes from the other side. Its transitions are remembered by residual and token. An
empty residual closes a group: the ids of both sides between two places where both have a border.
Texts are cut into segments that both tokenizers treat by themselves; there the residual is empty,
so a segment's groups are found once and looked up after that. Corpus-wide counts of linked ids
are a Spark aggregation over each document's different links.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import BROADCAST_ROWS, documents, drop_stash, hot_join, slices, stash
from chronoloom.llm.lexicon import Lexicon, Pool, segments, spaced
from chronoloom.llm.pieces import BYTE, PieceEncoder
from chronoloom.llm.texthash import string_bytes

#: Transitions that a worker remembers.
TRANSITIONS = 250_000
#: A group of more links than this is linked by its different ids and their numbers.
MOST_LINKS = 1024
#: Bits of a pair of ids beside the number of its word or document.
PAIR_BITS = 40
LEFT, RIGHT = 0, 1


class Transducer:
    """Closes groups of two token sequences; left and right are the bytes of each side's ids."""

    def __init__(self, left: list[bytes], right: list[bytes]):
        self.bytes = left, right
        self._forget()

    def _forget(self) -> None:
        #: State 0 is the empty residual; the left side then reads first.
        self.states, self.lead, self.rest = {(RIGHT, b""): 0}, [RIGHT], [b""]
        self.memo: dict[tuple[int, int], int] = {}

    def _step(self, state: int, token: int) -> int:
        lead, rest = self.lead[state], self.rest[state]
        new = self.bytes[1 - lead][token]
        if rest.startswith(new):
            after = (lead, rest[len(new) :])
        elif new.startswith(rest):
            after = (1 - lead, new[len(rest) :])
        else:
            return -1
        if not after[1]:
            return 0
        if after not in self.states:
            self.states[after] = len(self.lead)
            self.lead.append(after[0])
            self.rest.append(after[1])
        return self.states[after]

    def groups(self, left: list[int], right: list[int]) -> list[int] | None:
        """How many ids of the left and of the right side every group takes, in turn; None where the sides spell different bytes."""
        if len(self.memo) > TRANSITIONS:
            self._forget()
        memo, lead = self.memo, self.lead
        i = j = i0 = j0 = state = 0
        n, m = len(left), len(right)
        out = []
        while i < n or j < m:
            if lead[state]:
                if i == n:
                    return None
                token = left[i]
                i += 1
            else:
                if j == m:
                    return None
                token = right[j]
                j += 1
            after = memo.get((state, token))
            if after is None:
                after = memo[state, token] = self._step(state, token)
            if after <= 0:
                if after < 0:
                    return None
                out += i - i0, j - j0
                i0, j0 = i, j
            state = after
        return None if state else out


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes for themselves, the others moved above 255 in order."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(moved)}


class Aligner:
    """Both tokenizers, by their files, and what is known of segments: their ids, groups and links."""

    def __init__(self, left_path: str, right_path: str):
        from tokenizers import Tokenizer

        self.left = Tokenizer.from_file(left_path)
        self.left.encode_special_tokens = True
        with open(right_path, "rb") as f:
            self.right = PieceEncoder(f.read())
        table = byte_level()
        vocabulary = self.left.get_vocab(with_added_tokens=True)
        left = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            left[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
        kinds = self.right.kinds
        right = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace("▁", " ").encode() for p, k in zip(self.right.texts, kinds)]
        self.transducer, self.n_left, self.n_right = Transducer(left, right), len(left), len(right)
        spec = json.loads(self.left.to_str())
        split = (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel" and spec["pre_tokenizer"].get("use_regex", True) and not spec["normalizer"]
        self.together = self.right.together if split else None
        if self.n_left * self.n_right >= 1 << PAIR_BITS:
            raise ValueError("the vocabularies are too large")
        most = max(self.n_left, self.n_right)
        wide = len(str(most))
        #: The decimal digits of each id, with room for a sign after them.
        self.digits = np.array([str(k).ljust(wide + 1).encode() for k in range(most)]).view(np.uint8).reshape(most, wide + 1)
        self.digit_count = np.array([len(str(k)) for k in range(most)])
        self._forget()

    def _forget(self) -> None:
        self.lexicon = Lexicon(self._learn)
        self.ids, self.pieces, self.sizes, self.links, self.totals = Pool(np.int32), Pool(np.int32), Pool(np.int32, np.int32), Pool(np.int64, np.int64), Pool(np.int64)
        self.spelled: list[bytes | None] = []

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        lefts = [e.ids for e in self.left.encode_batch_fast(texts, add_special_tokens=False)]
        rights = self.right.bare.encode([t.replace(" ", "▁") for t in texts], num_threads=1)
        spell, groups = self.transducer.bytes[LEFT], self.transducer.groups
        found = [groups(a, b) for a, b in zip(lefts, rights)]
        bad = []
        for k, word in enumerate(words):
            # equal sides may still spell another text: a written space mark
            if found[k] is None or b"".join(map(spell.__getitem__, lefts[k])) != word:
                found[k], lefts[k], rights[k] = [], [], []
                bad.append(k)
        flat = lambda rows, kind: np.fromiter(chain.from_iterable(rows), kind)
        size = lambda rows: np.fromiter(map(len, rows), np.int64, len(rows))
        n_a, n_b, n_g = size(lefts), size(rights), size(found) // 2
        a, b, sizes = flat(lefts, np.int64), flat(rights, np.int64), flat(found, np.int64).reshape(-1, 2)
        word = np.repeat(np.arange(len(words)), n_g)
        self.ids.put(n_a, a)
        self.pieces.put(n_b, b)
        self.sizes.put(n_g, *sizes.T)
        p, q = sizes.T
        at_a, at_b = np.cumsum(p) - p, np.cumsum(q) - q
        self._link(len(words), word, a, b, p, q, at_a, at_b)
        n_links = np.bincount(word, p * q, len(words)).astype(np.int64)
        self.totals.put(np.full(len(words), 4), np.stack([n_a, n_b, n_g, n_links], axis=1).ravel())
        self._spell(n_a + n_b, a, b, p, q, at_a, at_b)
        for k in bad:
            self.spelled[k - len(words)] = None

    def _link(self, words: int, word: np.ndarray, a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> None:
        """Store each word's different links and how often it has them."""
        few = np.flatnonzero(p * q <= MOST_LINKS)
        group = np.repeat(few, (p * q)[few])
        nth = np.arange(len(group)) - np.repeat(np.cumsum((p * q)[few]) - (p * q)[few], (p * q)[few])
        keys = [word[group] << PAIR_BITS | a[at_a[group] + nth // q[group]] * self.n_right + b[at_b[group] + nth % q[group]]]
        times = [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(p * q > MOST_LINKS).tolist():
            (x, nx), (y, ny) = (np.unique(v, return_counts=True) for v in (a[at_a[g] : at_a[g] + p[g]], b[at_b[g] : at_b[g] + q[g]]))
            keys.append((word[g] << PAIR_BITS) | (x[:, None] * self.n_right + y[None]).ravel())
            times.append((nx[:, None] * ny[None]).ravel())
        key, m = self._summed(np.concatenate(keys), np.concatenate(times))
        self.links.put(np.bincount(key >> PAIR_BITS, minlength=words), key & ((1 << PAIR_BITS) - 1), m)

    def _spell(self, tokens: np.ndarray, a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> None:
        """Store each word's groups as text; tokens: the number of ids of both sides of each word."""
        n, group_a, group_b = len(a) + len(b), np.repeat(np.arange(len(p)), p), np.repeat(np.arange(len(q)), q)
        ids, sign = np.zeros(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[np.arange(len(a)) + at_b[group_a]] = a
        ids[np.arange(len(b)) + (at_a + p)[group_b]] = b
        sign[at_a + at_b + p - 1] = ord("|")
        sign[at_a + at_b + p + q - 1] = ord(";")
        width = self.digit_count[ids]
        grid = self.digits[ids]
        grid[np.arange(n), width] = sign
        text = grid[np.arange(grid.shape[1])[None] <= width[:, None]].tobytes()
        ends = np.concatenate(([0], np.cumsum(width + 1)))[np.concatenate(([0], np.cumsum(tokens)))].tolist()
        self.spelled += [text[x : y - 1] if y > x else b"" for x, y in zip(ends, ends[1:])]

    def align(self, texts: pa.Array, groups: bool) -> dict:
        """Columns of the texts by name; see align_tokens()."""
        if self.lexicon.full():
            self._forget()
        raw, new = spaced(*string_bytes(texts))
        n = len(new) - 1
        totals, hashes, spoken = np.zeros((n, 4), np.int64), [hashlib.sha256() for _ in range(n)], [False] * n
        fits = np.diff(new) > 0
        linked, lists = [np.zeros((2, 0), np.int64)], []
        for borders in segments(raw, new[:-1][fits], self.together):
            entry = self.lexicon.look_up(raw, borders)
            doc = np.searchsorted(new, borders[:-1], "right") - 1
            said = [self.spelled[e] for e in entry.tolist()]
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            for k, a, b in zip(doc[first].tolist(), first.tolist(), [*first[1:].tolist(), len(doc)]):
                if None in said[a:b]:
                    fits[k] = False
                else:
                    hashes[k].update(b";" * spoken[k] + b";".join(said[a:b]))
                    spoken[k] = True
            np.add.at(totals, doc, self.totals.get(entry)[1].reshape(-1, 4))
            once, times = np.unique(doc << 32 | entry, return_counts=True)
            size, number, m = self.links.get(once & 0xFFFFFFFF)
            linked.append(self._summed((np.repeat(once >> 32, size) << PAIR_BITS) | number, m * np.repeat(times, size)))
            if groups:
                lists.append((doc, entry))
        totals[~fits] = 0
        key, m = self._summed(*np.concatenate(linked, axis=1))
        mine = fits[key >> PAIR_BITS]
        key, m = key[mine], m[mine]
        counts = np.bincount(key >> PAIR_BITS, minlength=n)
        pairs = key & ((1 << PAIR_BITS) - 1)
        out = dict(zip(("n_a", "n_b", "n_groups", "n_links"), totals.T))
        out["groups_sha256"] = [h.hexdigest() if ok else "" for h, ok in zip(hashes, fits.tolist())]
        out |= {"pairs": (counts, pairs), "times": (counts, m)}
        if groups:
            doc, entry = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (zip(*lists) if lists else ((), ())))
            doc, entry = doc[fits[doc]], entry[fits[doc]]
            for name, pool, at in (("a_ids", self.ids, 1), ("b_ids", self.pieces, 1), ("a_sizes", self.sizes, 1), ("b_sizes", self.sizes, 2)):
                got = pool.get(entry)
                out[name] = np.bincount(doc, got[0], n).astype(np.int64), got[at]
        return out

    @staticmethod
    def _summed(key: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Different keys in order and the sums of their weights."""
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        edge = np.flatnonzero(np.diff(key, prepend=-1))
        return np.stack([key[edge], np.add.reduceat(weight, edge) if len(edge) else weight])


_aligners: dict[tuple[str, str], Aligner] = {}

TOTALS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
LINKS = ", pairs array<long>, times array<long>"
GROUPS = ", a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>"


def _align(paths: tuple[str, str], groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        both = _aligners.get(paths) or _aligners.setdefault(paths, Aligner(*paths))
        kinds = {"pairs": pa.int64(), "times": pa.int64()}
        for batch in slices(batches, 256):
            found = both.align(batch.column("text"), groups)
            cols = {"doc_id": batch.column("doc_id")}
            for name, col in found.items():
                if isinstance(col, tuple):
                    cols[name] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(col[0]))).astype(np.int32)), pa.array(col[1]).cast(kinds.get(name, pa.int32())))
                else:
                    cols[name] = pa.array(col)
            yield pa.RecordBatch.from_pydict(cols)

    return run


def align_tokens(docs: DataFrame, left_path: str, right_path: str, groups: bool = True) -> DataFrame:
    """For each row of docs (doc_id, text) the alignment of its ids of both tokenizers.

    left_path: a byte-level tokenizer's file, which encodes the text after one space; special tokens in
    texts are plain text. right_path: a piece model, which puts that space there itself. Result:
    doc_id; n_a, n_b (ids), n_groups, n_links (pairs of ids in one group, all of them); groups_sha256 (of
    `a1,a2|b1;a3|b2`); pairs (left id x size of the right vocabulary + right id, each once) and times
    (how often it is linked); with groups also a_ids, b_ids and, group by group, a_sizes, b_sizes.
    Null and empty texts, and texts that a side does not spell as they are (written space marks), have
    zeros, an empty digest and empty lists. Rows that repeat, and null ids, are rows of their own. A
    text of any length is read window by window; a group of any length costs its different ids only.
    Other columns are ignored; an empty table gives an empty result.
    """
    return docs.select("doc_id", "text").mapInArrow(_align((left_path, right_path), groups), TOTALS + LINKS + GROUPS * groups)


def link_counts(pairs: DataFrame, n_right: int) -> DataFrame:
    """(pair, docs, best) of the pairs of each document, a row each: how many documents hold it, and whether that is its left id's highest."""
    counts = stash(pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("docs")), "pair-counts")
    a = F.floor(F.col("pair") / n_right)
    most = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    ranked = stash(counts.withColumn("a", a).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "pair-ranks")
    drop_stash(counts)
    return ranked


def scored(found: DataFrame, n_right: int) -> DataFrame:
    """The rows of align_tokens(), each with n_best and count_sum over its links by corpus-wide counts of documents.

    The counts are one row for each pair that occurs; while their counted rows are within the bound for
    broadcasts, they are sent to the links; beyond it links are shuffled by pair, frequent pairs apart.
    """
    held = stash(found.withColumn("row", F.monotonically_increasing_id()), "aligned")
    ranked = link_counts(held.select(F.explode("pairs").alias("pair")), n_right)
    links = held.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    met = links.join(F.broadcast(ranked), "pair") if ranked.count() <= BROADCAST_ROWS else hot_join(links, ranked, ["pair"], "docs", "inner")
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    return held.drop("pairs", "times").join(sums, "row", "left").drop("row").fillna(0, ["n_best", "count_sum"])


def op11_alignment(spark: SparkSession, sf_dir: str, left_path: str | None = None, right_path: str | None = None) -> DataFrame:
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    left, right = left_path or public_tokenizers.path("byte_bpe_50k.json"), right_path or public_tokenizers.path("piece_bpe_32k.model")
    found = align_tokens(documents(spark, sf_dir), left, right, groups=False)
    out = scored(found, SentencePieceProcessor(model_file=right).get_piece_size())
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
