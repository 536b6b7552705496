"""Operators 11 to 13 against the libraries and brute-force versions, and on odd rows."""

import collections
import hashlib
import random
import re
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import alignment, common, lexicon, pieces, queries, structure

SCHEMA = "doc_id long, text string, ids string, part int, n_tokens string, text_ string"
ODD = ["<0x41>", "▁", "", None, " ", "  a  b ", "x" * 9000, "\n\n", "é" * 40, "a b  c", "a  b", "<|endoftext|> x", "a ▁b"]


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], SCHEMA)


def scrambled(n, most=40, seed=1):
    rng = random.Random(seed)
    signs = "abE éс▁ \n\t .,'①ﬁＡ́ 　\u0000日本😀0<>x\r"
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(most))) for _ in range(n)]


# ---- 13: pieces ----------------------------------------------------------------------------------


def piece_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def proto():
    with open(piece_path(), "rb") as f:
        return f.read()


@pytest.mark.parametrize("name", ["", "nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("part", [1 << 16, 64])
def test_pieces_equal_library(proto, name, squeeze, part, monkeypatch):
    from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    monkeypatch.setattr(pieces, "PART_BYTES", part)
    model = pb.ModelProto.FromString(proto)
    if name:
        spec = pb.NormalizerSpec.FromString(SentencePieceNormalizer(rule_name=name).serialized_normalizer_spec())
        model.normalizer_spec.precompiled_charsmap = spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = squeeze
    library, mine = SentencePieceProcessor(model_proto=model.SerializeToString()), pieces.PieceEncoder(model.SerializeToString())
    texts = scrambled(1500) + scrambled(20, 3000, 2) + ODD
    counts, ids, begins, ends = mine.encode(pa.array(texts, pa.string()))
    at = 0
    for text, n, back in zip(texts, counts.tolist(), mine.decode(counts, ids)):
        got = ids[at : at + n].tolist()
        want = library.encode(text or "") + [library.eos_id()]
        assert got == want and back == library.decode(want)
        b, e, size = begins[at : at + n], ends[at : at + n], len((text or "").encode())
        assert b[-1] == e[-1] == size and (b <= e).all() and (b[1:] == e[:-1]).sum() >= n - 2
        if not any(library.is_byte(i) for i in got):
            proto_pieces = library.encode(text or "", return_type="proto").pieces
            assert (b[:-1].tolist(), e[:-1].tolist()) == ([p.begin for p in proto_pieces], [p.end for p in proto_pieces])
        at += n


def test_spans_spell_the_text(proto):
    mine = pieces.PieceEncoder(proto)
    texts = scrambled(500, seed=5)
    counts, ids, begins, ends = mine.encode(pa.array(texts))
    at = 0
    for text, n in zip(texts, counts.tolist()):
        raw = text.encode()
        assert b"".join(raw[a:b] for a, b in zip(begins[at : at + n], ends[at : at + n])) == raw
        at += n


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op13_query(spark, sf_dir):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=piece_path())
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode(r.text or "") + [2]
        want.add((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    got = [tuple(r) for r in queries.QUERIES["op13_pieces"](spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert len(got) == len(want) and set(got) == want


def test_op13_odd_rows(spark):
    rows = [*enumerate(ODD), (None, "no id"), (None, None), (3, None), (3, None)]
    got = pieces.encode_pieces(frame(spark, rows), piece_path(), decoded=True)
    assert got.columns == ["doc_id", "n_tokens", "ids", "begins", "ends", "decoded"]
    assert got.count() == len(rows)
    assert [tuple(r)[1:] for r in got.where("doc_id = 3").collect()] == [(1, [2], [0], [0], "")] * 3
    assert pieces.encode_pieces(frame(spark, []), piece_path()).count() == 0


# ---- 11: alignment of two tokenizers -------------------------------------------------------------


def byte_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return alignment.Aligner(byte_path(), piece_path())


def plain_alignment(both, texts):
    """Each text's (a ids, b ids, groups) by byte offsets, from whole encodings; None where a side spells another text."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    left, right = Tokenizer.from_file(byte_path()), SentencePieceProcessor(model_file=piece_path())
    left.encode_special_tokens = True
    chars = alignment.byte_level()
    out = []
    for text in texts:
        raw = (" " + text).encode() if text else b""
        a = left.encode(" " + text, add_special_tokens=False).ids if text else []
        b = right.encode(text or "")
        spelled_a = [bytes(chars[c] for c in left.id_to_token(i)) for i in a]
        spelled_b = [bytes([int(right.id_to_piece(i)[1:-1], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
        if not text or b"".join(spelled_a) != raw or b"".join(spelled_b) != raw:
            out.append(None)
            continue
        ends = [[sum(map(len, s[: k + 1])) for k in range(len(s))] for s in (spelled_a, spelled_b)] if len(raw) < 300 else [list(accumulate(map(len, s))) for s in (spelled_a, spelled_b)]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        out.append((a, b, groups))
    return out


def plain_rows(plain):
    """The contract's columns without doc_id, from plain_alignment()."""
    docs = [collections.Counter((x, y) for a, b in (p[2] if p else ()) for x in a for y in b) for p in plain]
    count = collections.Counter(pair for d in docs for pair in d)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    rows = []
    for p, d in zip(plain, docs):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in p[2]) if p else None
        rows.append((len(p[0]) if p else 0, len(p[1]) if p else 0, len(p[2]) if p else 0, sum(d.values()), sum(m for (x, y), m in d.items() if count[x, y] == best[x]), sum(m * count[k] for k, m in d.items()), sha(said) if p else ""))
    return rows


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_transducer_closes_groups():
    t = alignment.Transducer([b"", b"ab", b"c", b"abcd", b"d"], [b"", b"a", b"bc", b"bcd", b"x", b"d"])
    assert t.groups([1, 2, 4], [1, 2, 5]) == [2, 2, 1, 1]
    assert t.groups([3], [1, 3]) == [1, 2] and t.groups([], []) == []
    assert t.groups([1, 2], [1, 3]) is None and t.groups([1], [4]) is None and t.groups([1], []) is None and t.groups([], [1]) is None
    assert t.groups([1, 2, 4], [1, 2, 5]) == [2, 2, 1, 1]


@pytest.mark.parametrize("window, links", [(1 << 21, 1024), (50, 1)])
def test_alignment_by_offsets(both, window, links, monkeypatch):
    both._forget()
    monkeypatch.setattr(alignment, "MOST_LINKS", links)
    monkeypatch.setattr(lexicon.segments, "__defaults__", (window,))
    texts = scrambled(600) + scrambled(15, 2000, 2) + ODD
    found = both.align(pa.array(texts, pa.string()), True)
    at = dict.fromkeys(("pairs", "times", "a_ids", "b_ids", "a_sizes", "b_sizes"), 0)
    for k, p in enumerate(plain_alignment(both, texts)):
        mine = {}
        for name in at:
            n = int(found[name][0][k])
            mine[name] = found[name][1][at[name] : at[name] + n].tolist()
            at[name] += n
        a, b, groups = p or ([], [], [])
        assert (mine["a_ids"], mine["b_ids"]) == (a, b), texts[k]
        assert (mine["a_sizes"], mine["b_sizes"]) == ([len(x) for x, _ in groups], [len(y) for _, y in groups])
        links = collections.Counter(x * both.n_right + y for x1, y1 in groups for x in x1 for y in y1)
        assert dict(zip(mine["pairs"], mine["times"])) == links and len(mine["pairs"]) == len(links)


def test_long_group_costs_its_ids(both):
    t = alignment.Transducer([b"aa"], [b"aaa"])
    assert t.groups([0] * 30_000, [0] * 20_000) == [3, 2] * 10_000
    found = both.align(pa.array(["q" * 50_000]), False)
    assert found["n_links"][0] > 0


def test_op11_query(spark, sf_dir, both):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = plain_rows(plain_alignment(both, [r.text for r in docs]))
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op11_alignment"](spark, sf_dir).collect()}
    assert len(got) == len(docs) and got == {r.doc_id: w for r, w in zip(docs, want)}


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_op11_odd_rows(spark, both, bound, monkeypatch):
    monkeypatch.setattr(alignment, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    texts = [*ODD, "the the cat", "the cat", "the cat", None]
    rows = [*zip([None, *range(1, len(texts) - 1), 1], texts)]
    want = plain_rows(plain_alignment(both, texts))
    found = alignment.align_tokens(frame(spark, rows), byte_path(), piece_path())
    got = alignment.scored(found, both.n_right)
    key = lambda i, t: (i is None, i or 0, t)
    assert sorted((key(r.doc_id, tuple(r[c] for c in COLUMNS)) for r in got.collect())) == sorted(key(i, w) for (i, _), w in zip(rows, want))
    assert alignment.scored(alignment.align_tokens(frame(spark, []), byte_path(), piece_path(), groups=False), both.n_right).count() == 0


# ---- 12: structure of conversations --------------------------------------------------------------

INK = re.compile("[^\x20\x09-\x0d]")
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(rows):
    """(cost, audit, repaired rows) of rows of (role, text, fault), by trying every edit from every state, backwards."""
    best = {s: (0, "", ()) if s in ("", "a") else None for s in NEXT}
    for at in range(len(rows), -1, -1):
        after = dict(best) if at < len(rows) else None
        if after is not None:
            role, text, fault = rows[at]
            new = {}
            for s in NEXT:
                ways = [(2 + after[s][0], "D" + after[s][1], after[s][2])] if after[s] else []
                extra = 5 if fault == "truncated" else 0
                if fault not in ("blank", "duplicate"):
                    kept = NEXT[s].get(role[:1])
                    for letter, price, name, to in (("K", extra, role, kept), *(("R", extra + 1, n, NEXT[s].get(n[0])) for n in ("user", "assistant"))):
                        if to and after[to]:
                            ways.append((price + after[to][0], letter + after[to][1], ((name, text), *after[to][2])))
                new[s] = min(ways) if ways else None
            best = new
        for _ in range(3):
            for s in NEXT:
                for n in ("user", "assistant"):
                    to = NEXT[s].get(n[0])
                    if to and best[to]:
                        way = (5 + best[to][0], "I" + best[to][1], ((n, ""), *best[to][2]))
                        best[s] = min(best[s], way) if best[s] else way
    return best[""]


def plain_report(turns):
    """The contract's rows from (conv_id, turn, role, text, gone) by conversation."""
    out = {}
    by = collections.defaultdict(list)
    for c, t, r, x, gone in turns:
        by[c].append((t, r if r is not None else " ", x if x is not None else " ", gone))
    for c, rows in by.items():
        rows = sorted((r for r in rows if not r[3]), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, found, count, broken = set(), [], collections.Counter(), 0
        for k, (_, role, text, _) in enumerate(rows):
            ink = INK.findall(text)
            fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            found.append((role, text, fault))
            broken += k > 0 and rows[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        numbers = {r[0] for r in rows if r[0] is not None}
        cost, audit, fixed = cheapest(found)
        out[c] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, count["blank"], count["duplicate"], count["truncated"], broken, cost, audit, sha("\n".join(f"{r}:{x}" for r, x in fixed)))
    return out


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
TURNS = "conv_id long, turn long, role string, text string, gone boolean, part string, fault int, n long"


def turn_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 9, 9) for r in rows], TURNS)


def reported(df):
    return {r.conv_id: tuple(r[c] for c in FIELDS) for r in df.collect()}


def random_turns(rng, conv, n, step=1):
    """Turns of one conversation without two different rows of one number and role."""
    roles = ["user", "assistant", "system", "tool", None, "unknown", "user", "assistant"]
    texts = ["Yes.", "no", "", " \n", "What?", None, *(f"text {k}." for k in range(6)), *(f"cut {k}" for k in range(3))]
    out = []
    for k in range(n):
        row = (conv, k * step if rng.random() < 0.9 else k * step + 1, rng.choice(roles), rng.choice(texts), rng.random() < 0.05)
        out += [row] * rng.choice([1, 1, 1, 1, 2])
    return out


def one_order(rows):
    """rows without those that differ from an earlier one of the same number and role: their order is not defined by the contract."""
    seen = {}
    return [r for r in rows if seen.setdefault((r[0], r[1], r[2] or " "), (r[3], r[4])) == (r[3], r[4])]


def test_layers_equal_every_edit():
    rng = random.Random(3)
    name = {0: "system", 1: "user", 2: "assistant", 3: "tool"}
    fault = {0: "", 1: "truncated", 2: "blank"}
    codes = [[rng.choice([0, 1, 1, 2, 2, 3]) + 4 * rng.choice([0, 0, 0, 1, 2]) for _ in range(rng.randrange(0, 12))] for _ in range(800)]
    sizes = np.array([len(c) for c in codes])
    costs, row, letter, turn, _ = structure.whole_rows(np.array([x for c in codes for x in c]), sizes)
    for k, c in enumerate(codes):
        want = cheapest([(name[x % 4], "t", fault[x // 4]) for x in c])
        got = structure.LETTERS[letter[row == k]].tobytes().decode()
        assert (int(costs[k]), got) == want[:2], c


def test_chunks_equal_every_edit(monkeypatch):
    monkeypatch.setattr(structure, "BLOCK", 3)
    rng = random.Random(4)
    name, fault = {0: "system", 1: "user", 2: "assistant", 3: "tool"}, {0: "", 1: "truncated", 2: "duplicate"}
    end = np.array([0, 10, 5, 0])
    for _ in range(60):
        codes = [rng.choice([0, 1, 1, 2, 2, 3]) + 4 * rng.choice([0, 0, 0, 1, 2]) for _ in range(rng.randrange(1, 20))]
        cut = rng.randrange(len(codes) + 1)
        parts = [np.array(p, np.int64) for p in (codes[:cut], codes[cut:])]
        ahead = np.minimum((structure.fold(parts[1]) + end[None]).min(axis=1), structure.INFINITE)
        ends, steps = structure.chunk_steps(parts[0], ahead)
        first = steps[0][0]
        second = structure.chunk_steps(parts[1], end)[1][ends[0]][0]
        want = cheapest([(name[x % 4], "t", fault[x // 4]) for x in codes])
        assert structure.LETTERS[np.concatenate([first, second])].tobytes().decode() == want[1], (codes, cut)


@pytest.mark.parametrize("small", [False, True])
def test_structure_by_brute_force(spark, small, monkeypatch):
    if small:
        monkeypatch.setattr(structure, "REPEATED_ROWS", 0)
        monkeypatch.setattr(common, "HOT_ROWS", 4)
    rng = random.Random(5)
    rows = [r for c in [None, *range(1, 150)] for r in random_turns(rng, c, rng.randrange(0, 9), rng.choice([1, 1, 2]))]
    rows += random_turns(rng, 500, 700) + random_turns(rng, 501, 70) + [(502, 1, "user", "Gone.", True), (503, None, "user", "Hi.", False), (503, None, "assistant", "Yes.", False)]
    rows = one_order(rows)
    rng.shuffle(rows)
    got = structure.repair_structure(turn_frame(spark, rows).repartition(3), gone="gone")
    assert got.columns == structure.PIECES
    assert reported(structure.report(got)) == plain_report(rows)
    assert got.groupBy("conv_id").agg(F.sum("cost")).count() == len({r[0] for r in rows})


def test_one_hot_conversation(spark, monkeypatch):
    rng = random.Random(6)
    rows = one_order(random_turns(rng, 7, 9000) + [(7, 4, "user", "Same.", False)] * 3000 + random_turns(rng, 8, 5))
    got = structure.repair_structure(turn_frame(spark, rows), gone="gone")
    assert got.where("conv_id = 7").count() > 2
    assert reported(structure.report(got)) == plain_report(rows)


def test_structure_of_nothing(spark):
    empty = turn_frame(spark, [])
    assert structure.report(structure.repair_structure(empty)).count() == 0
    assert structure.report(structure.repair_structure(structure.damaged(empty), gone="gone")).count() == 0


def test_long_texts_make_chunks(spark, monkeypatch):
    rows = [(1, k, ("user", "assistant")[k % 2], "y" * 3_000_000 + f"{k}.", False) for k in range(6)]
    got = reported(structure.report(structure.repair_structure(turn_frame(spark, rows))))
    assert got == plain_report(rows)


def test_op12_query(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    rows = []
    for c, t, role, text in turns:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(c, t, "user" if kind == 4 else role, text, kind == 0)] * (2 if kind == 3 else 1)
    got = reported(queries.QUERIES["op12_structure"](spark, sf_dir))
    assert got == plain_report(rows) and set(got) == {t.conv_id for t in turns}
