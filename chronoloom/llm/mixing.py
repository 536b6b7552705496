"""Mixing sources to target weights with Efraimidis-Spirakis sampling, in DataFrame functions only.

A source whose target is q of its sizes gets floor(q) complete epochs; the rest of the target is
filled by the documents of the smallest exponential keys -ln(u) / weight, prefix-summed to the word
budget. u comes from the md5 of the seed and the id, weight from the share of letters in the text.
No source is sorted as a whole: sizes are summed in BINS key ranges, and only the range in which the
budget ends is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoloom.llm.common import WORD, documents, fresh, numbered, small, stash

WEIGHTS = (5, 2, 1)
MOST = 3
BINS = 4096
#: Documents tried, in key order, after the first that does not fit.
LOOK = 256
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """1 less the share of ASCII digits and signs among the characters, 0.05 at least; empty: 0.05."""
    signs = F.regexp_count(text, F.lit(r"[!-@\[-`{-~]"))
    return F.coalesce(F.greatest(F.lit(0.05), 1 - signs / F.nullif(F.length(text), F.lit(0))), F.lit(0.05))


def exponential_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("long") + 1) / F.lit(float(2**48))
    return -F.log(u) / weight


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares by weight of the whole size.

    Weights repeat in the code point order of the sources, null last. Targets stop at most times a
    source's size and the excess is shared again by weight until none is above: the level at which
    sum(min(level * weight, most * size)) is the whole. The table has a row for each source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("ratio", F.col("source_size") * most / F.col("w"))
    by_ratio = W.orderBy("ratio").rangeBetween(W.unboundedPreceding, W.currentRow)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = ranked.withColumn("full", F.sum(F.col("source_size") * most).over(by_ratio)).withColumn("left", F.sum("w").over(every) - F.sum("w").over(by_ratio)).withColumn("whole", F.sum("source_size").over(every))
    # a source is full if the level that its being full leaves to the others is no lower than its ratio
    ranked = ranked.withColumn("is_full", F.when(F.col("left") > 0, (F.col("whole") - F.col("full")) / F.col("left") >= F.col("ratio")).otherwise(F.col("whole") >= F.col("full")))
    taken = F.coalesce(F.sum(F.when(F.col("is_full"), F.col("source_size") * most)).over(every), F.lit(0))
    open_w = F.sum(F.when(~F.col("is_full"), F.col("w"))).over(every)
    return ranked.select("source", "source_size", F.when(F.col("is_full"), (F.col("source_size") * most).cast("double")).otherwise((F.col("whole") - taken) * F.col("w") / open_w).alias("target"))


def _same(a: DataFrame, b: DataFrame, left: str = "source", right: str = "source_r"):
    return a[left].eqNullSafe(b[right])


def mixture(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: str = SEED, weight: str | None = None) -> DataFrame:
    """(row, doc_id, source, size, tie, source_size, target, taken) for each row of docs.

    weight: a column of positive quality weights; without one quality() of the text is taken. Sources
    of no words get 0 everywhere, null texts have none, and a null source is a source of its own. Texts
    of any length count whole. Ties of a key fall to the smaller doc_id, then to tie, a hash of the
    text, so that reruns agree however the rows lie in files; rows that repeat are each drawn. A null
    doc_id is drawn as the text "null". Other columns are ignored; an empty table gives an empty result. Past the first document that does not fit, the next
    LOOK documents in key order are still tried, each taken if it fits what is left; at the end the
    one of them whose size comes closest to what is left is taken too, if that brings the target nearer.
    """
    base = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"), exponential_key(F.col("doc_id"), F.col(weight) if weight else quality(F.col("text")), seed).alias("key"))
    base = stash(base.withColumn("row", F.monotonically_increasing_id()).withColumn("bin", F.least(F.floor((1 - F.exp(-F.col("key"))) * BINS), F.lit(BINS - 1)).cast("int")), "mix")
    bins = stash(base.groupBy("source", "bin").agg(F.sum("size").alias("size")), "bins")
    plan = targets(bins.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("need", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    plan = stash(plan.withColumnRenamed("source", "source_r"), "plan")
    small_plan = small(plan)

    w = W.partitionBy("source_r").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = bins.join(small_plan, _same(bins, plan)).select("source_r", "bin", "need", F.sum("size").over(w).alias("upto"), "size")
    last = run.where("upto > need").groupBy("source_r").agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("size")).alias("before")), "bin").alias("at"))
    last = stash(last.select("source_r", F.col("at.bin").alias("last_bin"), F.col("at.before").alias("before")), "last")
    edge = plan.join(last.withColumnRenamed("source_r", "s"), F.col("source_r").eqNullSafe(F.col("s")), "left").drop("s")
    edge = stash(edge.select("*", F.coalesce("last_bin", F.lit(BINS)).alias("edge_bin")).drop("last_bin"), "edge")

    small_edge = small(edge)
    joined = base.join(small_edge, _same(base, edge))
    inside = joined.where("bin = edge_bin")
    order = W.partitionBy("source_r").orderBy("key", F.col("doc_id").asc_nulls_last(), "tie", "row").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(order))
    fits = stash(inside.where("upto <= need").select("row", "source_r", "upto"), "fits")
    got = fits.groupBy("source_r").agg(F.max("upto").alias("upto"))
    gap = edge.join(got.withColumnRenamed("source_r", "s"), F.col("source_r").eqNullSafe(F.col("s")), "left").where("edge_bin < %d" % BINS)
    gap = stash(gap.select("source_r", "edge_bin", (F.col("need") - F.coalesce("upto", "before")).alias("gap")).where("gap > 0"), "gap")
    free = base.join(small(gap), _same(base, gap)).where("bin >= edge_bin and size > 0").join(fits.select("row"), "row", "left_anti")
    nth = W.partitionBy("source_r").orderBy("key", F.col("doc_id").asc_nulls_last(), "tie", "row")
    tried = free.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= LOOK)
    tried = tried.groupBy("source_r", "gap").agg(F.sort_array(F.collect_list(F.struct("nth", "row", "size"))).alias("docs"))
    start = F.struct(F.col("gap").alias("gap"), F.array().cast("array<long>").alias("rows"))
    step = lambda acc, d: F.when(d["size"] <= acc.gap, F.struct((acc.gap - d["size"]).alias("gap"), F.concat(acc.rows, F.array(d.row)).alias("rows"))).otherwise(acc)
    tried = tried.select("docs", F.aggregate("docs", start, step).alias("got"))
    rest = F.filter("docs", lambda d: ~F.array_contains("got.rows", d.row))
    close = F.array_min(F.transform(rest, lambda d: F.struct(F.abs(d["size"] - F.col("got.gap")).alias("off"), d.nth.alias("nth"), d.row.alias("row"))))
    tried = tried.select("got", close.alias("close"))
    extra = F.when(F.col("close.off") < F.col("got.gap"), F.concat("got.rows", F.array("close.row"))).otherwise(F.col("got.rows"))
    extra = tried.select(F.explode(extra).alias("row"))
    chosen = stash(fits.select("row").unionByName(extra).withColumn("chosen", F.lit(True)), "chosen")

    out = joined.join(small(chosen), "row", "left")
    more = (F.col("bin") < F.col("edge_bin")) | F.col("chosen").isNotNull()
    taken = F.col("size") * F.col("epochs") + F.when(more & (F.col("need") > 0), F.col("size")).otherwise(0)
    return out.select("row", "doc_id", "source", "size", "tie", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: str = SEED, weight: str | None = None) -> DataFrame:
    """The rows of docs, each as often as mixture() takes it; a text without words is never taken.

    Rows that agree in id, source, size and text share their numbers of copies, at most one more
    than epochs there are, and are dealt these by a running number. The columns stay.
    """
    cols, size, n, tie, nth = docs.columns, fresh(docs, "mix_size"), fresh(docs, "mix_n"), fresh(docs, "mix_tie"), fresh(docs, "mix_nth")
    plan = mixture(docs, weights, most, seed, weight).where("size > 0")
    plan = plan.groupBy("doc_id", "source", "size", "tie", (F.col("taken") / F.col("size")).cast("int").alias("n")).agg(F.count("*").alias("rows"))
    plan = plan.groupBy("doc_id", "source", "size", "tie").agg(F.sort_array(F.collect_list(F.struct("n", "rows")), False).alias(n))
    names = {c: fresh(docs, f"mix_{c}_of_plan") for c in ("doc_id", "source", "size", "tie")}
    plan = plan.where(F.element_at(n, 1)["n"] > 0).select(*(F.col(c).alias(other) for c, other in names.items()), n)
    keyed = docs.withColumn(size, words(F.col("text"))).withColumn(tie, F.xxhash64("text"))
    same = keyed.doc_id.eqNullSafe(plan[names["doc_id"]]) & keyed.source.eqNullSafe(plan[names["source"]])
    met = keyed.join(plan, same & (F.col(size) == F.col(names["size"])) & (F.col(tie) == F.col(names["tie"])))
    out = met.where(F.size(n) == 1).withColumn(n, F.element_at(n, 1)["n"]).select(*cols, n)
    several = met.where(F.size(n) > 1).select(*cols, size, tie, n)
    if several.limit(1).count():
        dealt = numbered(several, ["doc_id", "source", size, tie], nth)
        # the first row of parts whose rows, added up, reach the number
        upto = lambda k: F.aggregate(F.slice(n, 1, k), F.lit(0).cast("long"), lambda s, x: s + x["rows"])
        at = F.size(F.filter(F.transform(n, lambda x, i: upto(i + 1)), lambda total: total < F.col(nth))) + 1
        out = out.unionByName(dealt.withColumn(n, F.element_at(F.col(n), at)["n"]).where(F.col(n) > 0).select(*cols, n))
    return out.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(cols)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5('{SEED}/' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 1) / 281474976710656.0::DOUBLE)
      / coalesce(greatest(0.05::DOUBLE, 1 - length(regexp_replace(text, '[^!-@\\[-`{{-~]+', '', 'g'))::DOUBLE / nullif(length(text), 0)), 0.05::DOUBLE) AS key
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM base GROUP BY source),
r AS (SELECT *, source_size * {MOST} / w AS ratio FROM src),
c AS (SELECT *, sum(source_size * {MOST}) OVER (ORDER BY ratio) AS filled, sum(w) OVER () - sum(w) OVER (ORDER BY ratio) AS rest, sum(source_size) OVER () AS whole FROM r),
f AS (SELECT *, CASE WHEN rest > 0 THEN (whole - filled) / rest >= ratio ELSE whole >= filled END AS is_full FROM c),
t AS (SELECT source, source_size, CASE WHEN is_full THEN (source_size * {MOST})::DOUBLE
    ELSE (whole - coalesce(sum(source_size * {MOST}) FILTER (is_full) OVER (), 0))::DOUBLE * w / sum(w) FILTER (NOT is_full) OVER () END AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least({MOST}, floor(target / source_size)) ELSE 0 END::BIGINT AS epochs FROM t),
n AS (SELECT *, round(target - epochs * source_size)::BIGINT AS need FROM p),
k AS (SELECT b.*, n.source_size, n.target, n.epochs, n.need, sum(b.size) OVER (PARTITION BY b.source ORDER BY b.key, b.doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto
  FROM base b JOIN n ON b.source IS NOT DISTINCT FROM n.source),
g AS (SELECT source, any_value(need) - coalesce(max(upto) FILTER (upto <= need), 0) AS gap FROM k GROUP BY source),
o AS (SELECT k.source, k.doc_id, k.size, row_number() OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST) AS nth FROM k WHERE k.upto > k.need AND k.size > 0),
walk AS (SELECT source, 0::BIGINT AS nth, gap::BIGINT AS gap, NULL::BIGINT AS doc_id FROM g
  UNION ALL SELECT w.source, w.nth + 1, (CASE WHEN o.size <= w.gap THEN w.gap - o.size ELSE w.gap END)::BIGINT, CASE WHEN o.size <= w.gap THEN o.doc_id END
  FROM walk w JOIN o ON o.source IS NOT DISTINCT FROM w.source AND o.nth = w.nth + 1 WHERE w.nth < {LOOK}),
picked AS (SELECT doc_id FROM walk WHERE doc_id IS NOT NULL),
ends AS (SELECT source, min(gap) AS gap FROM walk GROUP BY source),
close AS (SELECT o.source, arg_min(o.doc_id, (abs(o.size - ends.gap), o.nth)) AS doc_id FROM o JOIN ends ON o.source IS NOT DISTINCT FROM ends.source
  WHERE o.nth <= {LOOK} AND o.doc_id NOT IN (SELECT doc_id FROM picked) AND abs(o.size - ends.gap) < ends.gap GROUP BY o.source),
e AS (SELECT doc_id FROM picked UNION SELECT doc_id FROM close)
SELECT k.doc_id, k.size, k.source_size, k.target,
  (k.size * k.epochs + CASE WHEN k.need > 0 AND (k.upto <= k.need OR e.doc_id IS NOT NULL) THEN k.size ELSE 0 END)::BIGINT AS taken
FROM k LEFT JOIN e ON k.doc_id = e.doc_id
"""
