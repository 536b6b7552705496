"""Toxicity by compression distance: zstandard dictionaries of ordinary and of toxic text.

Both dictionaries are trained by zstandard. The ordinary one learns from the words and the longer
runs of ordinary documents, the toxic one from the words of toxic documents, each word once a
document and only those that toxic documents hold RATIO times as often as ordinary ones: what both
hold would fill the toxic dictionary and tell nothing. Each window of a text is compressed with the ordinary dictionary and with the ordinary one
followed by the toxic one; sharing the first part leaves in the difference only what the toxic
dictionary adds. A logistic curve over a document's length differences, fitted on labelled documents
that no dictionary has seen and weighted to the labels' share, gives the score. Of the sizes of
the toxic dictionary in TOXIC_BYTES the one whose curve fits best is taken.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import documents, held_out, slices

#: Labelled documents of each class that are learned from at most, whatever their length.
SAMPLE = 2000
#: Share of the sample that the dictionaries are made of; the rest fits the curve.
DICTIONARY_SHARE = 2 / 3
#: Bytes of the ordinary dictionary that words and longer runs are given, and of the toxic one.
WORD_BYTES, RUN_BYTES, TOXIC_BYTES = 65_536, 16_384, (1024, 2048)
#: A word teaches the toxic dictionary if this many toxic documents hold it, this many times as often as ordinary ones.
LEAST_DOCS, RATIO = 3, 8
#: The least letters of a word that a dictionary learns, and the least characters of its runs.
LEAST_LETTERS, RUN = 5, 160
#: Window lengths in characters, each ending at a word's end.
WINDOWS = (32, 56)
FEATURES = 8 * len(WINDOWS) + 1
THRESHOLD = 0.3

_WORDS = re.compile(r"[^\W\d_]+")
_SPACES = re.compile(r"[\x20\x09-\x0D]+")


def windows(text: str, size: int) -> list[bytes]:
    """The whole text, lower case, in runs of words of at least size characters; a long word is cut."""
    text = f" {_SPACES.sub(' ', text.lower()).strip()} "
    out, at, n = [], 0, len(text)
    while at < n - 1:
        end = text.find(" ", at + size)
        end = n - 1 if end < 0 else min(end, at + 8 * size)
        out.append(f" {text[at:end]} ".encode())
        at = end
    return out or [b"  "]


def _words(texts: list[str]) -> list[bytes]:
    """The longer words of each text, once a text."""
    return [f" {w} ".encode() for t in texts for w in sorted(set(_WORDS.findall(t.lower()))) if len(w) >= LEAST_LETTERS]


def _telling(bad: list[bytes], n_bad: int, good: list[bytes], n_good: int) -> list[bytes]:
    """The toxic documents' words that ordinary ones hold rarely; all of them if there are none."""
    a, b = Counter(bad), Counter(good)
    return [w for w in bad if a[w] >= LEAST_DOCS and a[w] * n_good >= RATIO * b[w] * n_bad] or bad


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary of the samples; where they are too few to train on, their end as it is."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Scorer:
    """Two dictionaries and the curve, as plain values that a task can carry."""

    def __init__(self, base: bytes, tail: bytes):
        self.base, self.tail = base or b"        ", tail or b"        "
        self.loss = 0.0
        self.mean = self.scale = self.weights = None
        self._pair = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_pair"} | {"_pair": None}

    def _compressors(self):
        if self._pair is None:
            level = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=0, write_checksum=0, write_dict_id=0)
            pair = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (self.base, self.base + self.tail)]
            for d in pair:
                d.precompute_compress(compression_params=level)
            self._pair = [zstandard.ZstdCompressor(dict_data=d, compression_params=level).compress for d in pair]
        return self._pair

    def features(self, text: str) -> list[float]:
        plain, toxic = self._compressors()
        out = []
        for size in WINDOWS:
            gains = sorted((len(plain(w)) - len(toxic(w)) for w in windows(text, size)), reverse=True)
            n, total = len(gains), sum(gains)
            over = [sum(1 for g in gains if g >= k) for k in (2, 3, 4)]
            out += [gains[0], sum(gains[:3]) / min(3, n), total / n, over[0] / n, over[2] / n, np.log1p(over[1]), np.log1p(over[2]), total / np.sqrt(n)]
        return [*out, np.log(n)]

    def fit(self, texts: list[str], marks: list[int], share: float) -> Scorer:
        x, y = np.array([self.features(t) for t in texts], float), np.array(marks, float)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        own = min(max(y.mean(), 1e-6), 1 - 1e-6)
        weight = np.where(y == 1, share / own, (1 - share) / (1 - own))
        w = np.zeros(z.shape[1])
        ridge = np.eye(len(w)) * 0.3
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w += np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - 0.3 * w)
        self.weights, p = w, 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        self.loss = float(-(weight * np.log(np.where(y == 1, p, 1 - p) + 1e-12)).mean())
        return self

    def fixed(self, share: float) -> Scorer:
        """The same score for every text."""
        p = min(max(share, 1e-3), 1 - 1e-3)
        self.mean, self.scale, self.weights = np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1)
        self.weights[-1] = np.log(p / (1 - p))
        return self

    def score(self, text: str) -> float:
        z = (np.array(self.features(text)) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30))))


def learn(toxic: list[str], plain: list[str], share: float) -> Scorer:
    """share: of toxic among the labelled documents. Without both classes every score is the share."""
    if not toxic or not plain:
        return Scorer(b"", b"").fixed(share)
    cut = [max(1, int(len(x) * DICTIONARY_SHARE)) for x in (toxic, plain)]
    bad, good = toxic[: cut[0]], plain[: cut[1]]
    common = _words(good)
    base = _trained(WORD_BYTES, common) + _trained(RUN_BYTES, [w for t in good for w in windows(t, RUN)])
    rest = [(t, 1) for t in toxic[cut[0] :]] + [(t, 0) for t in plain[cut[1] :]]
    if len({m for _, m in rest}) < 2:
        rest = [(t, 1) for t in toxic] + [(t, 0) for t in plain]
    texts, marks, words = [t for t, _ in rest], [m for _, m in rest], _telling(_words(bad), len(bad), common, len(good))
    fits = [Scorer(base, _trained(size, words)).fit(texts, marks, share) for size in TOXIC_BYTES]
    return min(fits, key=lambda s: s.loss)


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Learn from labelled rows outside the held-out fold: SAMPLE of each class in hash order.

    Conflicting labels of one doc_id count as toxic; labels without a document, null labels and null
    texts teach nothing. With one class only, or an empty table, every score is the labels' share.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    n, ones = marks.agg(F.count("*"), F.sum("toxic")).first()
    order = F.xxhash64("doc_id")
    # about four times the sample of either class by hash of the id, before any text is read
    keep = F.pmod(order, F.lit(1 << 30)) < F.when(F.col("toxic") == 1, F.lit(_bar(ones or 0))).otherwise(F.lit(_bar((n or 0) - (ones or 0))))
    some = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(marks.where(keep)), "doc_id").select("doc_id", "text", "toxic")
    picked = [[r.text for r in some.where(F.col("toxic") == k).orderBy(order, F.xxhash64("text")).limit(SAMPLE).select("text").collect()] for k in (1, 0)]
    return learn(*picked, share=(ones or 0) / max(1, n or 0))


def _bar(rows: int) -> int:
    """The hash bound that lets about four samples through: the broadcast ids stay under 5 * SAMPLE."""
    return int(min(1.0, 4 * SAMPLE / max(1, rows)) * (1 << 30))


def _score(scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = [scorer.score(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def score_toxicity(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text).

    Null texts are scored as empty ones, very long texts over all their windows; equal texts score
    alike, and rows that repeat an id are scored each. A null doc_id is held out. Other columns are
    ignored; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    scored = rows.mapInArrow(_score(scorer), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _drop(scorer: Scorer, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([scorer.score(t or "") < threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return run


def drop_toxic(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score threshold or more; the columns stay.

    Rows are judged one by one as in score_toxicity(), null and empty texts too; an empty table stays
    empty.
    """
    return docs.mapInArrow(_drop(scorer, threshold), docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
