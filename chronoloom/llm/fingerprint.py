"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A paragraph (line) hashes to a wide vector: four 32-bit lanes of its own hash, and LANES lanes that
sum a sign for each chunk of up to three words. The fingerprint of a document is the sum of its
paragraphs' vectors, modulo 2^32 and 2^16: the order of paragraphs does not matter, equal
multisets have equal fingerprints, and inserting or deleting a paragraph adds or subtracts its
vector. The inner product of two sign vectors estimates how many chunks the two texts share. While
chunks are counted, three lanes of 21 bits share one sum; no sum sees more chunks than that holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.llm.common import documents, small, stash

#: Hashes of a chunk, and what each gives: FIELDS lanes in each of SUMS sums.
HASHES, FIELDS, SUMS, BITS = 2, 3, 21, 21
LANES = HASHES * FIELDS * SUMS
#: A paragraph's chunks: three words each, words of over 24 characters in pieces.
CHUNK = r"[^\x20\x09-\x0D]{1,24}(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D]{1,24}){0,2}"
#: Documents of a run of neighbouring ids; quantiles of ids, at most, in each of two steps; parts of an id that many rows have.
RUN_DOCS, COARSE, FINE, TIES = 1000, 256, 4096, 64


def vectors(rows: DataFrame, by: list[str], text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """by, carry, vec: the fingerprint vector (4 + LANES numbers) of the texts of each group of rows.

    carry: numbers that are the same in all rows of a group.
    """
    lines = rows.select(*by, *carry, F.posexplode_outer(F.split(F.col(text), "\n")).alias("line_no", "line"))
    line_hash = F.when(F.length("line") > 0, F.xxhash64("line"))
    line_hash2 = F.when(F.length("line") > 0, F.xxhash64(F.lit(1), F.col("line")))
    parts = lines.select(*by, *carry, "line_no", line_hash.alias("lh"), line_hash2.alias("lh2"), F.posexplode_outer(F.regexp_extract_all("line", F.lit(CHUNK), F.lit(0))).alias("nth", "chunk"))
    first = F.coalesce("nth", F.lit(0)) == 0
    # at most 2^10 lines by 2^10 chunks are counted together
    piece = F.shiftleft(F.shiftright(F.coalesce("line_no", F.lit(0)), 10).cast("long"), 32) + F.shiftright(F.coalesce("nth", F.lit(0)), 10)
    hashed = parts.select(*by, *carry, piece.alias("piece"), F.when(first, F.col("lh")).alias("lh"), F.when(first, F.col("lh2")).alias("lh2"), *(F.when(F.col("chunk").isNotNull(), F.xxhash64(F.lit(10 + k), F.col("chunk"))).alias(f"h{k}") for k in range(HASHES)))
    low = lambda c: F.sum(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    high = lambda c: F.sum(F.shiftrightunsigned(F.col(c), 32))
    ones = F.lit(sum(1 << BITS * f for f in range(FIELDS)))
    packed = [F.sum(F.shiftrightunsigned(F.col(f"h{k}"), j).bitwiseAND(ones)).alias(f"p{k}_{j}") for k in range(HASHES) for j in range(SUMS)]
    kept = [F.first(c).alias(c) for c in carry]
    sums = hashed.groupBy(*by, "piece").agg(low("lh").alias("e0"), high("lh").alias("e1"), low("lh2").alias("e2"), high("lh2").alias("e3"), F.count("h0").alias("n"), *packed, *kept)
    lane = lambda k, j, f: F.shiftrightunsigned(F.col(f"p{k}_{j}"), BITS * f).bitwiseAND(F.lit((1 << BITS) - 1))
    every = [(k, j, f) for k in range(HASHES) for f in range(FIELDS) for j in range(SUMS)]
    wide = sums.groupBy(*by).agg(*(F.sum(f"e{i}").alias(f"e{i}") for i in range(4)), F.sum("n").alias("n"), *(F.sum(lane(*at)).alias(f"b{i}") for i, at in enumerate(every)), *kept)
    exact = [F.pmod(F.coalesce(F.col(f"e{i}"), F.lit(0)), F.lit(2**32)) for i in range(4)]
    signs = [F.pmod(F.coalesce(F.col(f"b{i}"), F.lit(0)) * 2 - F.col("n"), F.lit(2**16)) for i in range(LANES)]
    return wide.select(*by, *carry, F.array(*exact, *signs).alias("vec"))


def combine(a: Column, b: Column, remove: bool = False) -> Column:
    """The vector of both multisets together, or of a without b."""
    lanes = F.zip_with(a, b, lambda x, y: x - y if remove else x + y)
    return F.transform(lanes, lambda x, i: F.pmod(x, F.when(i < 4, F.lit(2**32)).otherwise(F.lit(2**16))))


def as_text(vec: Column) -> Column:
    """Hexadecimal: 8 digits for each exact lane, 4 for each sign lane."""
    return F.lower(F.array_join(F.transform(vec, lambda x, i: F.lpad(F.hex(x), F.when(i < 4, F.lit(8)).otherwise(F.lit(4)), F.lit("0"))), ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: shared chunks by the estimate of the inner product, over both lengths; equal vectors: 1."""
    signed = lambda v: F.transform(F.slice(v, 5, LANES), lambda x: (F.pmod(x + 32768, F.lit(65536)) - 32768).cast("double"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    x, y = signed(a), signed(b)
    top = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(a == b, F.lit(1.0)).when(top == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x, y) / top)))


def _runs(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs (doc_id, text, tie) with run, a number that grows with (doc_id, tie), null ids first; and how
    many runs a quantile of the ids has at most. A run has about RUN_DOCS rows, however the ids lie."""
    total, edges, nameless = docs.agg(F.count("*"), F.percentile_approx("doc_id", [k / COARSE for k in range(COARSE)], 10000), F.count_if(F.col("doc_id").isNull())).first()
    edges = edges or []
    bounds = sorted(set(edges))[:: max(1, COARSE * RUN_DOCS // max(1, total))]
    heavy = [b for b in bounds if edges.count(b) > 1 and total > COARSE * RUN_DOCS]
    upto = lambda array: F.size(F.filter(array, lambda b: b <= F.col("doc_id")))
    coarse = upto(F.array(*(F.lit(b).cast("long") for b in bounds)) if bounds else F.array().cast("array<long>"))
    placed = docs.withColumn("coarse", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(coarse))
    fine = min(FINE, -(-total // (COARSE * RUN_DOCS)))
    if fine > 1:
        inner = placed.groupBy("coarse").agg(F.percentile_approx("doc_id", [k / fine for k in range(fine)], 10000).alias("inner"))
        placed = placed.join(F.broadcast(stash(inner, "quantiles")), "coarse", "left")  # COARSE + 2 rows at most
        sub = F.coalesce(upto("inner"), F.lit(0))
    else:
        sub = F.lit(0)
    # rows of an id that fills quantiles, and of no id, by ranges of their hash: that id begins its quantile
    split = F.col("doc_id").isin(heavy) if heavy else F.lit(False)
    if nameless > RUN_DOCS:
        split = split | F.col("doc_id").isNull()
    tie = F.when(F.coalesce(split, F.lit(False)), F.least(F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * TIES), F.lit(TIES - 1))).otherwise(F.lit(TIES))
    per = (max(fine, 1) + 1) * (TIES + 1)
    run = (F.col("coarse") * F.lit(per) + sub * F.lit(TIES + 1) + tie).cast("long")
    return placed.select("doc_id", "text", "tie", run.alias("run")), per


def neighbours(docs: DataFrame) -> DataFrame:
    """run, at, ghost, doc_id, text, next_text: each document beside the next in descending doc_id.

    After the last comes the first. Ties go by a hash of the text, null ids come last, null texts
    are empty. Only runs of neighbouring ids are sorted; the first row of the next run stands at
    each run's end as a ghost, so that no row waits for another partition.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed, per = _runs(docs.withColumn("tie", F.xxhash64("text")))
    heads = stash(keyed.groupBy("run").agg(F.max(F.struct(F.col("doc_id"), F.col("tie"))).alias("head")).withColumn("part", F.floor(F.col("run") / per)), "heads")
    # the run above each: inside a quantile by a window, over the quantiles by a row for each of them
    lows = heads.groupBy("part").agg(F.min("run").alias("low")).orderBy("part").collect()
    over = [(r.part, lows[(k + 1) % len(lows)].low) for k, r in enumerate(lows)]
    over = docs.sparkSession.createDataFrame(over, "part long, over long")
    above = F.lead("run").over(W.partitionBy("part").orderBy("run"))
    heads = heads.withColumn("above", above).join(F.broadcast(over), "part")
    heads = stash(heads.select(F.col("run").alias("own"), F.col("head.doc_id").alias("head_id"), F.col("head.tie").alias("head_tie"), F.coalesce("above", "over").alias("above")), "heads")
    met = keyed.join(small(heads), F.col("run") == F.col("own"))
    is_head = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    places = F.array_compact(F.array(F.struct(F.col("run"), F.lit(0).alias("ghost")), F.when(is_head, F.struct(F.col("above").alias("run"), F.lit(1).alias("ghost")))))
    spread = met.select("doc_id", "text", "tie", F.explode(places).alias("p")).select("doc_id", "text", "tie", "p.run", "p.ghost").repartition("run")
    w = W.partitionBy("run").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    return spread.select("run", F.row_number().over(w).alias("at"), "ghost", "doc_id", "text", F.lead("text").over(w).alias("next_text"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    One row for each row of docs (doc_id, text), in the order of neighbours(): null texts are empty,
    a single document is its own next, equal texts have equal fingerprints, rows that repeat an id are
    ordered by a hash of their text. Texts are read whole, however long. Other columns are ignored; an
    empty table gives an empty result.
    """
    near = neighbours(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.when(F.col("ghost") == 0, F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)))
    near = near.withColumn("edited", edited).withColumn("sha", F.sha2("edited", 256))
    # the digest travels as five numbers: sums that carry texts would have to be sorted
    digits = [F.conv(F.substring("sha", 1 + 13 * k, 13), 16, 10).cast("long").alias(f"s{k}") for k in range(5)]
    both = F.array_compact(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.when(F.col("ghost") == 0, F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))))
    near = near.select("run", "at", "ghost", "doc_id", F.length("text").cast("long").alias("n_chars"), *digits, F.explode(both).alias("t"))
    carry = ("ghost", "doc_id", "n_chars", *(f"s{k}" for k in range(5)))
    vec = vectors(near.select("run", "at", *carry, "t.kind", "t.text"), ["run", "at", "kind"], "text", carry)
    both = vec.groupBy("run", "at").agg(*(F.first(c).alias(c) for c in carry), F.max(F.when(F.col("kind") == 0, F.col("vec"))).alias("vec"), F.max(F.when(F.col("kind") == 1, F.col("vec"))).alias("edited"))
    w = W.partitionBy("run").orderBy("at")
    out = both.withColumn("next", F.lead("vec").over(w)).where("ghost = 0")
    sha = F.lower(F.concat(*(F.lpad(F.hex(f"s{k}"), 13 if k < 4 else 12, "0") for k in range(5))))
    return out.select("doc_id", "n_chars", sha.alias("edited_sha256"), as_text(F.col("vec")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("vec"), F.col("edited")).alias("near_edited"), likeness(F.col("vec"), F.col("next")).alias("near_next"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(documents(spark, sf_dir))
