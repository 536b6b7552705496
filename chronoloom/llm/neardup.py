"""MinHash near-duplicates by an inverted join on signature coordinates.

A document's set holds its distinct shingles of consecutive words, A-Z folded. Each signature
coordinate is a pair of independent minima, so two documents share it with probability J * J.
Documents are posted under (coordinate, value). A pair above the threshold shares at least
MATCHES of the COORDS coordinates but for a chance under 1e-5, so it shares one of the first
COORDS - MATCHES + 1 (the prefix): only these are posted. Short posting lists give their pairs.
In a long list every member is paired with the list's most central document alone; what those
pairs leave apart is compared in blocks of bounded size. The other coordinates of a pair are
counted by probing the two signatures, and pairs below MATCHES are skipped. What remains is
confirmed on the full sets, so every reported link is exact. Documents of equal sets are one class,
told by a 128-bit digest of the whole sorted set, and are never expanded into pairs; everything
between signatures and components runs on class numbers, so ids may repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import documents, drop_stash, hot_join, slices, small, stash
from chronoloom.llm.texthash import U, mix, shingle_sets

COORDS, MATCHES = 32, 9
PREFIX = COORDS - MATCHES + 1
#: Lists of up to this many documents give all their pairs.
SHORT = 24
#: Hashes of a block: of documents that are left apart, and of documents they are compared with.
LEFT_HASHES, ALL_HASHES = 1 << 16, 1 << 19

_rng = np.random.Generator(np.random.PCG64(77))
_XOR = _rng.integers(0, 2**64, 2 * COORDS, dtype=U)
_MUL = _rng.integers(0, 2**64, 2 * COORDS, dtype=U) | U(1)
_SALT = _rng.integers(0, 2**64, COORDS, dtype=U)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of COORDS 64-bit values for each non-empty set; a value also tells its coordinate."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    mins = np.empty((2 * COORDS, len(sets)), U)
    for k in range(2 * COORDS):
        mins[k] = np.minimum.reduceat((flat ^ _XOR[k]) * _MUL[k], starts)
    return mix(mins[0::2] * U(0x9E3779B97F4A7C15) + mix(mins[1::2]) + _SALT[:, None]).T


def _digests(sets: list[np.ndarray]) -> tuple[list, list]:
    """Two longs that tell each set; none for an empty one."""
    both = [np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist() if len(s) else (None, None) for s in sets]
    return [x for x, _ in both], [y for _, y in both]


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, sigs, pending, held, k1, k2 = [], [], [], 0, [], []

            def flush():
                if any(map(len, pending)):
                    rows = iter(signatures([s for s in pending if len(s)]).view(np.int64))
                    sigs.extend(next(rows) if len(s) else None for s in pending)
                else:
                    sigs.extend(None for _ in pending)
                for out, got in zip((k1, k2), _digests(pending)):
                    out += got
                pending.clear()

            for s in shingle_sets(batch.column("text"), k):
                sizes.append(len(s))
                pending.append(s)
                held += len(s)
                if held > 60_000:
                    flush()
                    held = 0
            flush()
            cols = [pa.array(sizes, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sigs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n", "k1", "k2", "sig"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column("doc_id")
            part, at = [], 0
            for s in shingle_sets(batch.column("text"), k):
                part.append(s)
                if sum(map(len, part)) > 100_000 or at + len(part) == batch.num_rows:
                    cols = [pa.array(x, pa.int64()) for x in _digests(part)]
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), *cols, pa.array([x.view(np.int64) for x in part], pa.list_(pa.int64()))], ["doc_id", "k1", "k2", "hashes"])
                    at, part = at + len(part), []

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over links (a, b), for nodes that have a link.

    Alternates large-star and small-star steps; each writes its edges to the shared folder. The
    links never leave the cluster.
    """
    edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every edge now points down: (u, v) with v < u
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        step = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = stash(step, "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stash(edges)
        edges = new
        if now == seen:
            break
        seen = now
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) whose full sets reach num / den."""
    got = pairs.join(sets.select(F.col("c").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("c").alias("b"), F.col("hashes").alias("hb")), "b")
    both = F.size(F.array_intersect("ha", "hb"))
    return got.where(den * both >= num * (F.size("ha") + F.size("hb") - both)).select("a", "b")


def _compare(num: int, den: int):
    """Links of a block between documents of different components: as many as join the components."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        left, rest = block[block.side == 0], block[block.side == 1]
        if left.empty or rest.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        lens = left.hashes.str.len().to_numpy()
        flat, owner = np.concatenate(left.hashes.to_numpy()), np.repeat(np.arange(len(left)), lens)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        ids, a, b = left.c.to_numpy(), [], []
        names, code = np.unique(np.concatenate([left.root.to_numpy(), rest.root.to_numpy()]), return_inverse=True)
        mine, theirs, group = code[: len(left)], code[len(left) :], np.arange(len(names))
        for other, root, hashes in zip(rest.c.tolist(), theirs.tolist(), rest.hashes):
            lo, hi = np.searchsorted(flat, hashes, "left"), np.searchsorted(flat, hashes, "right")
            n = hi - lo
            where = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(owner[where], minlength=len(left))
            hit = np.flatnonzero((den * both >= num * (lens + len(hashes) - both)) & (group[mine] != group[root]))
            met, first = np.unique(group[mine[hit]], return_index=True)
            a += ids[hit[first]].tolist()
            b += [other] * len(met)
            group[np.isin(group, met)] = group[root]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Links: num / den or more of the union of two sets is shared. component_id is the smallest
    doc_id that links reach. A null or wordless text has an empty set and links with nothing; a row
    with a null doc_id gets no component and is kept; rows of one doc_id, each compared on its own
    text, share what any of them reaches, and repeated rows are all returned. A very long text is one
    set like any other. Other columns of docs are ignored. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    signed = stash(docs.mapInArrow(_sign(k), "doc_id long, n long, k1 long, k2 long, sig array<long>"), "signed")
    classes = signed.where("doc_id is not null and n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = stash(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    keyed = signed.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("k1")).alias("k1"), "k2")
    rows = stash(hot_join(keyed, classes.select("k1", "k2", "c", "size"), ["k1", "k2"], "size").select("doc_id", "n", "c"), "rows")
    drop_stash(signed)
    twice = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("c").alias("least"), F.count("*").alias("times")).where("times > 1 and least is not null")
    twice = stash(twice.select("doc_id", "least"), "twice")
    repeated = twice.limit(1).count() > 0

    posts = classes.select("c", F.explode(F.slice("sig", 1, PREFIX)).alias("list"))
    lists = posts.groupBy("list").agg(F.count("*").alias("size")).where("size > 1")
    posts = stash(hot_join(posts, lists, ["list"], "size", how="inner"), "posts")
    central = posts.groupBy("c").agg(F.sum("size").alias("score"))
    short = posts.where(F.col("size") <= SHORT)
    long = posts.where(F.col("size") > SHORT)
    pairs = short.select("list", F.col("c").alias("a")).join(short.select("list", F.col("c").alias("b")), "list").where("a < b").select("a", "b")
    heads = long.join(central, "c").groupBy("list").agg(F.max(F.struct("score", (-F.col("c")).alias("neg"))).alias("top"), F.first("size").alias("size"))
    heads = stash(heads.select("list", (-F.col("top.neg")).alias("head"), "size"), "heads")
    members = stash(hot_join(long.select("list", "c"), heads, ["list"], "size", how="inner").select("head", "c").distinct(), "members")
    star = members.where("head <> c").select(F.least("head", "c").alias("a"), F.greatest("head", "c").alias("b"))
    sig = lambda name: classes.select(F.col("c").alias(name), F.col("sig").alias(f"sig_{name}"))
    matches = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda x: x))
    pairs = stash(pairs.unionByName(star).distinct().join(sig("a"), "a").join(sig("b"), "b").where(matches >= MATCHES).select("a", "b"), "pairs")
    drop_stash(posts, heads)

    asked = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).unionByName(members.select("c")).unionByName(members.select(F.col("head").alias("c"))).distinct()
    asked = stash(asked.join(classes.select("c", "rep", "k1", "k2", "n"), "c"), "asked")
    full = docs.join(small(asked.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi").mapInArrow(_sets(k), "doc_id long, k1 long, k2 long, hashes array<long>")
    full = full.join(small(asked), ["k1", "k2"]).where("doc_id = rep").select("c", "n", "hashes")
    sets = stash(full.dropDuplicates(["c"]) if repeated else full, "sets")

    links = _confirmed(pairs, sets, num, den)
    if repeated:
        links = links.unionByName(rows.join(small(twice), "doc_id").where("c <> least").select(F.col("least").alias("a"), F.col("c").alias("b")).distinct())
    links = stash(links, "links")
    found = stash(components(links), "components")
    apart = stash(_left_apart(members, found, sets, num, den), "apart")
    drop_stash(pairs, members, asked, sets)
    if apart.limit(1).count():
        found = stash(components(links.unionByName(apart)), "components")

    least = found.withColumnRenamed("node", "c").join(classes.select("c", "rep"), "c").groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = classes.select("c", "rep", "size").join(found.withColumnRenamed("node", "c"), "c", "left").join(least, "root", "left")
    of_class = of_class.select("c", F.coalesce("component_id", "rep").alias("component_id"), "size")
    if repeated:
        rows = rows.join(small(twice), "doc_id", "left").withColumn("c", F.coalesce("c", "least"))
    named = hot_join(rows.select("doc_id", "n", "c"), of_class, ["c"], "size")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _left_apart(members: DataFrame, roots: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links inside a head's group between documents that the head's own links left apart.

    A block holds about LEFT_HASHES hashes of documents outside the head's component and ALL_HASHES
    of the group's; every outside document meets every member in exactly one block.
    """
    rooted = members.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    heads = members.select("head").distinct().join(roots.withColumnRenamed("node", "head"), "head", "left").select("head", F.coalesce("root", "head").alias("head_root"))
    heads = stash(heads, "head_roots")
    rooted = rooted.join(small(heads), "head").withColumn("out", (F.col("root") != F.col("head_root")) & (F.col("c") != F.col("head")))
    rooted = stash(rooted.join(sets.select("c", "n"), "c").select("head", "c", "n", "root", "out"), "rooted")
    groups = rooted.groupBy("head").agg(F.sum(F.when(F.col("out"), F.col("n"))).alias("outs"), F.sum("n").alias("all"), F.count("*").alias("times")).where("outs > 0 and times > 2")
    groups = stash(groups.select("head", F.ceil(F.col("outs") / LEFT_HASHES).cast("int").alias("nl"), F.ceil(F.col("all") / ALL_HASHES).cast("int").alias("na")), "groups")
    rooted = rooted.join(small(groups), "head").join(sets.select("c", "hashes"), "c")
    spot = lambda n: F.pmod(F.xxhash64("c"), F.col(n)).cast("int")
    rest = rooted.select("head", "c", "root", "hashes", F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("bl"), spot("na").alias("ba"), F.lit(1).alias("side"))
    left = rooted.where("out").select("head", "c", "root", "hashes", spot("nl").alias("bl"), F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("ba"), F.lit(0).alias("side"))
    found = rest.unionByName(left).groupBy("head", "bl", "ba").applyInPandas(_compare(num, den), "a long, b long")
    return found.distinct()


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without the rows whose doc_id is not the smallest of its component; the columns stay.

    Rows are judged as in near_duplicates(): rows of a null doc_id, and rows without words, stay.
    """
    dropped = stash(near_duplicates(docs, k, num, den).where("not kept").select("doc_id").distinct(), "dropped")
    return docs.join(small(dropped), "doc_id", "left_anti").select(docs.columns)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=4, num=80, den=100)
