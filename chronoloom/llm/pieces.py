"""Encoding with a piece model, each piece projected to bytes of the original text, and decoding.

A text is normalised by the model's compiled character map, the longest key first; of each byte of
the result the place in the original is kept. The normalised text is segmented by the model itself,
stripped of its own normaliser; since no merge joins two bytes that no piece holds side by side, a
long text is cut where that is sure. Widths of pieces then give their ends in the normalised text,
and the kept places their ends in the original.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import documents, slices
from chronoloom.llm.lexicon import SPACE, segments, spaced, together_in
from chronoloom.llm.texthash import string_bytes

PIECE_SCHEMA = "doc_id long, n_tokens long, ids array<int>, begins array<long>, ends array<long>"
#: Kinds of pieces in the model file, and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
BPE = 2
MARK = SPACE.encode()
#: A longer text is cut into parts of about so many bytes, where no merge can cross.
PART_BYTES = 1 << 16


class CharacterMap:
    """The compiled map: a double array of keys, whose values are places in a pool of zero-ended strings."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.pool = blob[4 + size :]
        self.memo: dict[int, bytes] = {}
        #: Bytes that begin no key.
        self.plain = [self._step(0, b) is None for b in range(256)]

    def _step(self, node: int, byte: int) -> tuple[int, int | None] | None:
        """The node after byte, and the value of the key that ends there; None if no key goes on so."""
        base = self.units[node]
        node ^= ((base >> 10) << ((base & 512) >> 6)) ^ byte
        if node >= len(self.units) or self.units[node] & 0x800000FF != byte:
            return None
        unit = self.units[node]
        leaf = node ^ ((unit >> 10) << ((unit & 512) >> 6))
        return node, self.units[leaf] & 0x7FFFFFFF if unit & 256 else None

    def longest(self, raw: bytes, at: int) -> tuple[bytes, int] | None:
        """What the longest key at this place is replaced by, and the key's length; None if there is no key."""
        node, best = 0, None
        for end in range(at, len(raw)):
            step = self._step(node, raw[end])
            if step is None:
                break
            node = step[0]
            if step[1] is not None:
                best = step[1], end + 1 - at
        if best is None:
            return None
        if best[0] not in self.memo:
            self.memo[best[0]] = self.pool[best[0] : self.pool.index(b"\0", best[0])]
        return self.memo[best[0]], best[1]


class Normaliser:
    """The model's normaliser. Results keep a space as one byte; escaping it is left to the encoder."""

    def __init__(self, spec, suffix: bool = False):
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.squeeze, self.suffix = spec.add_dummy_prefix and not suffix, spec.remove_extra_whitespaces, spec.add_dummy_prefix and suffix
        #: What counts as a space at the end of a text: also the mark itself, where spaces are written as marks.
        self.spaces = (b" ", MARK) if spec.escape_whitespaces else (b" ", b" ")

    def one(self, raw: bytes) -> tuple[bytes, list[int]]:
        """The normalised text, and for each of its bytes and its end the place in raw that it came from."""
        units, at = [], 0
        while at < len(raw):
            found = None if self.map is None or self.map.plain[raw[at]] else self.map.longest(raw, at)
            if found is None:
                lead = raw[at]
                n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                found = raw[at : at + n], n
            units.append((*found, at))
            at += found[1]
        out, places, stop = bytearray(), [], len(raw)
        if self.squeeze:
            lead = 0
            while lead < len(units) and not units[lead][0].strip(b" "):
                lead += 1
            units = units[lead:]
        if not units:
            return b"", [stop]
        if self.prefix:
            out += b" "
            places.append(units[0][2])
        after_space = self.squeeze
        for text, _, place in units:
            if after_space:
                text = text.lstrip(b" ")
            if text:
                out += text
                places += [place] * len(text)
                after_space = self.squeeze and text.endswith(b" ")
        if self.squeeze:
            while out.endswith(self.spaces):
                n = 1 if out[-1] == 32 else len(self.spaces[1])
                stop = places[-n]
                del out[-n:], places[-n:]
        if self.suffix:
            out += b" "
            places.append(stop)
        return bytes(out), [*places, stop]

    def many(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The normalised texts, their offsets, the place of each byte in its own original, and each text's last place."""
        if self.map is None and not self.squeeze and not self.suffix:
            if not self.prefix:
                return raw, off, np.arange(len(raw)) - np.repeat(off[:-1], np.diff(off)), np.diff(off)
            out, new = spaced(raw, off)
            return out, new, np.maximum(np.arange(len(out)) - np.repeat(new[:-1], np.diff(new)) - 1, 0), np.diff(off)
        whole = raw.tobytes()
        done = [self.one(whole[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        new = np.concatenate(([0], np.cumsum([len(t) for t, _ in done]))).astype(np.int64)
        places = [np.array(p[:-1], np.int64) for _, p in done]
        return np.frombuffer(b"".join(t for t, _ in done), np.uint8), new, np.concatenate([*places, np.zeros(0, np.int64)]), np.array([p[-1] for _, p in done], np.int64)


class PieceEncoder:
    """A piece model by its file's bytes."""

    def __init__(self, proto: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto.FromString(proto)
        self.normaliser = Normaliser(model.normalizer_spec, model.trainer_spec.treat_whitespace_as_suffix)
        self.library = SentencePieceProcessor(model_proto=proto)
        self.end, self.unknown = self.library.eos_id(), self.library.unk_id()
        self.kinds = kinds = [p.type for p in model.pieces]
        cuttable = model.trainer_spec.model_type == BPE and USER not in kinds
        self.together = together_in(p.piece for p in model.pieces if p.type in (NORMAL, UNUSED)) if cuttable else None
        self.texts = [p.piece for p in model.pieces]
        #: The bytes of a piece, a space being one; an unknown one has any number.
        self.widths = np.array([1 if k == BYTE else len(p.replace(SPACE, " ").encode()) for p, k in zip(self.texts, kinds)], np.int32)
        for flag in ("add_dummy_prefix", "remove_extra_whitespaces", "escape_whitespaces"):
            setattr(model.normalizer_spec, flag, False)
        model.normalizer_spec.precompiled_charsmap = b""
        model.normalizer_spec.name = "identity"
        self.bare = SentencePieceProcessor(model_proto=model.SerializeToString())

    def segment(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of ids of each normalised part, whose spaces are still one byte, all ids and their widths in bytes."""
        every = self.bare.encode([p.decode().replace(" ", SPACE) for p in parts], num_threads=1)
        sizes = np.fromiter(map(len, every), np.int64, len(every))
        ids = np.fromiter(chain.from_iterable(every), np.int32, int(sizes.sum()))
        width = self.widths[ids]
        ends = np.cumsum(sizes)
        odd = np.zeros(len(every), bool)
        # pieces that stand for other bytes than their own: unknown characters, a space mark that the text itself holds
        odd[np.searchsorted(ends, np.flatnonzero(ids == self.unknown), "right")] = True
        for k, part in enumerate(parts):
            if odd[k] or MARK in part:
                width[ends[k] - sizes[k] : ends[k]] = self._exact(part, every[k])
        return sizes, ids, width

    def _exact(self, word: bytes, ids: list[int]) -> list[int]:
        text = word.decode()
        pieces, at, out = self.bare.encode(text.replace(" ", SPACE), out_type=str), 0, []
        for i, piece in zip(ids, pieces):
            if i != self.unknown and self.widths[i] == 1 and piece.startswith("<0x"):
                out.append(1)
                continue
            done = sum(out)
            at = len(word[:done].decode())
            out.append(len(text[at : at + len(piece)].encode()))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids, begins, ends): the bytes of its original that each id stands for; the end id stands for none."""
        raw, off = string_bytes(texts)
        norm, new, places, stops = self.normaliser.many(raw, off)
        borders = [new[:1]]
        for a, b in zip(new[:-1].tolist(), new[1:].tolist()):
            if b - a > PART_BYTES:
                borders += [a + cut[-1:] for cut in segments(norm[a:b], np.zeros(1, np.int64), self.together, PART_BYTES)]
            elif b > a:
                borders.append(np.array([b]))
        borders = np.concatenate(borders).astype(np.int64)
        whole = norm.tobytes()
        sizes, ids, widths = self.segment([whole[a:b] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())])
        counts = np.bincount(np.searchsorted(new, borders[:-1], "right") - 1, sizes, len(off) - 1).astype(np.int64)
        ends = np.cumsum(widths, dtype=np.int64)
        begin = np.append(places, 0)[ends - widths]
        text_of = np.repeat(np.arange(len(counts)), counts)
        # a piece ends where the next one's original begins; the last of a text ends with it
        last = ends == new[1:][text_of]
        end = np.where(last, stops[text_of], np.append(places, 0)[ends])
        put = np.cumsum(counts)
        ids = np.insert(ids, put, self.end).astype(np.int32)
        size = np.diff(off)
        return counts + 1, ids, np.insert(begin, put, size), np.insert(end, put, size)

    def decode(self, counts: np.ndarray, ids: np.ndarray) -> list[str]:
        flat, out, at = ids.tolist(), [], 0
        for n in counts.tolist():
            out.append(self.library.decode(flat[at : at + n]))
            at += n
        return out


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of the model file at path, once a worker."""
    if path not in _encoders:
        with open(path, "rb") as f:
            _encoders[path] = PieceEncoder(f.read())
    return _encoders[path]


def _lists(counts: np.ndarray, flat: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(flat))


def _encode(path: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in slices(batches, 256):
            counts, ids, begins, ends = coder.encode(batch.column("text"))
            cols = [batch.column("doc_id"), pa.array(counts), *(_lists(counts, x) for x in (ids, begins, ends))]
            names = ["doc_id", "n_tokens", "ids", "begins", "ends"]
            if decoded:
                cols, names = [*cols, pa.array(coder.decode(counts, ids), pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode_pieces(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, begins, ends[, decoded]) of each row of docs (doc_id, text), by the model file at path.

    ids end with the model's end id. begins and ends are the bytes of the original text that an id
    stands for: several ids of one character that the model spells in bytes share out its bytes, what
    the normaliser adds stands for nothing, and the end id for none. A null text is an empty one and
    has the end id alone; rows that repeat, and null ids, are rows of their own; a text of any length is
    one row, encoded in parts. Other columns are ignored; an empty table gives an empty
    result. decoded: also what the library makes of the ids.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_encode(path, decoded), PIECE_SCHEMA + ", decoded string" * decoded)


def op13_pieces(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    found = encode_pieces(documents(spark, sf_dir), path or public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return found.select("doc_id", "n_tokens", sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))
