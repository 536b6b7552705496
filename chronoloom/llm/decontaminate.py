"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Texts become lower-case words of letters and digits. A mask such as 11101001 reads the words of a
window at its ones and ignores the rest, so a substituted word at an ignored place does not break
the hit. Test hashes are joined with training hashes; each hit fixes an alignment, along which the
item's words are compared one by one. The document is contaminated if some WINDOW of the item's
words (the whole item if it is shorter) agrees in four fifths of its places or more. Each such
agreement of an item of SPAN words or more holds a seed: MASKS see to that where WINDOW words are
compared, SHORT_MASK with them where fewer are; tests try every substitution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import documents, fresh, small, stash

MASKS = ("11101001", "11010011", "10110101")
SPAN = 8
WINDOW = 13
#: A further mask of items under WINDOW words: MASKS alone miss a substituted first or last word of eight.
SHORT_MASK = "10111"
#: Agreeing words of a window, in percent; an item shorter than SPAN must agree in full.
AGREE = 80
#: Benchmark seeds (two longs and an int each) and words of items (a long each) up to which these are broadcast.
SEED_ROWS, ITEM_WORDS = 1_000_000, 8_000_000


def word_ids(text: Column) -> Column:
    """64-bit hashes of the words (letters and digits, lower case) of a text; null gives an empty array."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, keep: list[str], masks: list[tuple[str, Column]]) -> DataFrame:
    """keep, pos, seed: one row for each mask and each window of df.ids that the mask fits in.

    masks: each with the condition on df under which it is used.
    """
    span = max(len(m) for m, _ in masks)
    n = F.greatest(F.size("ids"), F.lit(1))
    shifted = [F.col("ids") if j == 0 else F.slice("ids", j + 1, n) for j in range(span)]
    zipped = F.arrays_zip(*(x.alias(f"w{j}") for j, x in enumerate(shifted)))
    uses = F.array(*(use for _, use in masks))
    rows = df.where(F.size("ids") > 0).select(*keep, uses.alias("uses"), F.posexplode(zipped).alias("pos", "w"))
    keys = []
    for k, (mask, _) in enumerate(masks):
        at = [F.col(f"w.w{j}") for j, bit in enumerate(mask) if bit == "1"]
        keys.append(F.when(F.col("uses")[k] & F.col(f"w.w{len(mask) - 1}").isNotNull(), F.xxhash64(F.lit(k), *at)))
    return rows.select(*keep, "pos", F.explode(F.array(*keys)).alias("seed")).where("seed is not null")


def masks_for(sizes: list[int]) -> list[tuple[str, Column]]:
    """The masks that items of these numbers of words need, each with the items that use it."""
    n = F.size("ids")
    out = [(m, n >= SPAN) for m in MASKS]
    if any(SPAN <= k < WINDOW for k in sizes):
        out.append((SHORT_MASK, (n >= SPAN) & (n < WINDOW)))
    return out + [("1" * k, n == k) for k in sorted(sizes) if k < SPAN]


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """leaks() for each row by its doc_id and the hash of its text, th."""
    items = benchmark.where("text is not null").select("item_id", word_ids(F.col("text")).alias("ids")).where(F.size("ids") > 0)
    items = stash(items.groupBy("ids").agg(F.min("item_id").alias("item_id")), "items")
    sizes = [r[0] for r in items.where(F.size("ids") < WINDOW).select(F.size("ids")).distinct().collect()]  # WINDOW - 1 values at most
    words = items.agg(F.sum(F.size("ids"))).first()[0] or 0
    masks = masks_for(sizes)
    of_items = _seeds(items, ["item_id"], masks).select("item_id", F.col("pos").alias("item_pos"), "seed")

    named = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    tokens = named.select("doc_id", "th", word_ids(F.col("text")).alias("ids"))
    hits = _seeds(tokens, ["doc_id", "th"], [(m, F.lit(True)) for m, _ in masks]).join(small(of_items, SEED_ROWS), "seed")
    hits = stash(hits.select("doc_id", "th", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct(), "hits")

    asked = small(hits.select(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th")).distinct())
    meets = lambda a, b: a.doc_id.eqNullSafe(b.hit_id) & (a.th == b.hit_th)
    again = named.join(asked, meets(named, asked), "left_semi").select("doc_id", "th", word_ids(F.col("text")).alias("ids"))
    right = hits.withColumnsRenamed({"doc_id": "hit_id", "th": "hit_th"})
    item = items.withColumnRenamed("ids", "item")
    both = again.join(right, meets(again, right)).join(F.broadcast(item) if words <= ITEM_WORDS else item, "item_id")
    first = F.greatest(F.lit(0), -F.col("shift"))
    last = F.least(F.size("item"), F.size("ids") - F.col("shift"))
    both = both.withColumn("first", first).withColumn("len", last - first).where("len > 0")
    same = F.zip_with(F.slice("item", F.col("first") + 1, F.col("len")), F.slice("ids", F.col("first") + F.col("shift") + 1, F.col("len")), lambda a, b: (a == b).cast("int"))
    both = both.withColumn("same", same).withColumn("compared", F.least(F.lit(WINDOW), F.size("item"))).where("len >= compared")
    run = lambda s: F.aggregate(F.slice("same", s + 1, F.col("compared")), F.lit(0), lambda x, y: x + y)
    both = both.withColumn("agreed", F.array_max(F.transform(F.sequence(F.lit(0), F.col("len") - F.col("compared")), run)))
    need = F.when(F.size("item") < SPAN, F.col("compared")).otherwise(F.ceil(F.col("compared") * AGREE / 100))
    overlap = F.aggregate("same", F.lit(0), lambda x, y: x + y) / F.size("item")
    found = both.where(F.col("agreed") >= need).select("doc_id", "th", "item_id", F.struct(overlap.alias("overlap"), "agreed", (-F.col("shift")).alias("back"), "compared").alias("best"))
    return found.groupBy("doc_id", "th", "item_id").agg(F.max("best").alias("best"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, pos, agreed, compared, overlap) for each contaminated document and item.

    pos: where the item would begin, in words; agreed of the compared places of the best window;
    overlap: share of all the item's words that agree there. Ties of overlap go to the window that
    agrees more, then to the later place. Nulls and empty texts, in documents and items, hit nothing,
    and an empty table on either side gives an empty result; whole texts are compared, however long.
    Items of equal words count as the one of the smallest item_id. Rows that repeat a doc_id are
    judged each by its own text, and reported once. Other columns are ignored.
    """
    found = _leaks(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    return found.select("doc_id", "item_id", (-F.col("best.back")).alias("pos"), "best.agreed", "best.compared", "best.overlap")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each contaminated doc_id: its number of items and the best of them (ties: the smallest)."""
    best = F.max(F.struct("overlap", (-F.col("item_id")).alias("item")))
    out = leaks(docs, benchmark).groupBy("doc_id").agg(F.count("*").alias("n_items"), best.alias("best"))
    return out.select("doc_id", "n_items", (-F.col("best.item")).alias("item_id"), F.col("best.overlap").alias("overlap"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows; each row is judged by its own text, as in leaks(). The columns stay."""
    names = {c: fresh(docs, f"bad_{c}") for c in ("doc_id", "th")}
    bad = small(stash(_leaks(docs, benchmark).select("doc_id", "th").distinct().withColumnsRenamed(names), "contaminated"))
    return docs.join(bad, docs.doc_id.eqNullSafe(bad[names["doc_id"]]) & (F.xxhash64(docs.text) == bad[names["th"]]), "left_anti").select(docs.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SQL_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"

OP10_SQL = f"""
WITH items AS (
  SELECT min(item_id) AS item_id, ids FROM (SELECT item_id, {_SQL_TOKENS} AS ids FROM benchmark WHERE text IS NOT NULL)
  WHERE len(ids) > 0 GROUP BY ids),
docs AS (SELECT doc_id, {_SQL_TOKENS} AS ids FROM documents),
masks AS (SELECT * FROM (VALUES {", ".join(f"({k}, {len(m)}, {SPAN}, {WINDOW - 1 if m == SHORT_MASK else 1 << 30}, {[j + 1 for j, b in enumerate(m) if b == '1']})" for k, m in enumerate((*MASKS, SHORT_MASK)))}) AS t(mask, span, least, most, places)
  UNION ALL SELECT 100 + n, n, n, n, range(1, n + 1) FROM range(1, {SPAN}) AS r(n)),
wanted AS (SELECT * FROM masks WHERE EXISTS (SELECT 1 FROM items WHERE len(ids) BETWEEN least AND most)),
item_seeds AS (SELECT item_id, pos, mask, list_transform(places, lambda p: ids[pos + p]) AS seed
  FROM (SELECT item_id, ids, mask, places, unnest(range(0, len(ids) - span + 1)) AS pos FROM items JOIN wanted ON len(ids) BETWEEN least AND most)),
doc_seeds AS (SELECT doc_id, pos, mask, list_transform(places, lambda p: ids[pos + p]) AS seed
  FROM (SELECT doc_id, ids, mask, places, unnest(range(0, len(ids) - span + 1)) AS pos FROM docs JOIN wanted ON len(ids) >= span)),
hits AS (SELECT DISTINCT d.doc_id, i.item_id, d.pos - i.pos AS shift FROM doc_seeds d JOIN item_seeds i ON d.mask = i.mask AND d.seed = i.seed),
places AS (SELECT h.doc_id, h.item_id, h.shift, len(i.ids) AS n, least({WINDOW}, len(i.ids)) AS compared, p.pos AS p,
    (d.ids[p.pos + h.shift + 1] = i.ids[p.pos + 1])::INT AS same
  FROM hits h JOIN docs d ON d.doc_id = h.doc_id JOIN items i ON i.item_id = h.item_id
  JOIN LATERAL (SELECT unnest(range(greatest(0, -h.shift), least(len(i.ids), len(d.ids) - h.shift))) AS pos) p ON true),
runs AS (SELECT *, sum(same) OVER w AS agreed, count(*) OVER w AS wide, sum(same) OVER (PARTITION BY doc_id, item_id, shift) AS total
  FROM places WINDOW w AS (PARTITION BY doc_id, item_id, shift ORDER BY p ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW)),
sized AS (SELECT *, CASE WHEN compared = {WINDOW} THEN agreed ELSE total END AS got FROM runs WHERE wide = compared),
found AS (SELECT doc_id, item_id, max(total / n) AS overlap FROM sized
  WHERE got >= CASE WHEN n < {SPAN} THEN compared ELSE ceil(compared * {AGREE} / 100.0) END GROUP BY 1, 2)
SELECT doc_id, count(*) AS n_items, arg_max(item_id, (overlap, -item_id)) AS item_id, max(overlap) AS overlap FROM found GROUP BY 1
"""
