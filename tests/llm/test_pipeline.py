"""The pipeline's stages on the small tables, against what each stage's operator says."""

import collections
import re
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F
from chronoloom.llm import decontaminate, mixing, toxicity

from test_operators import brute_components


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cols, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, sf_dir)
        rows = after.collect()
        if k < 4:
            assert after.columns == cols
        if name == "toxicity":
            assert len(rows) < before.count() and collections.Counter(r.doc_id for r in rows).most_common(1)[0][1] == 1
        if name == "near_duplicates":
            roots = brute_components([(r.doc_id, r.text) for r in before.collect()], 5)
            assert sorted(r.doc_id for r in rows) == sorted(i for i, (root, _) in roots.items() if i == root)
        if name == "decontamination":
            bad = {r.doc_id for r in decontaminate.contaminated(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
            assert bad and {r.doc_id for r in rows} == {r.doc_id for r in before.collect()} - bad
            words = lambda t: re.findall(r"\w+", t.lower())
            items = [" ".join(words(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            whole = {r.doc_id for r in before.collect() if any(f" {i} " in f" {' '.join(words(r.text))} " for i in items)}
            assert whole and whole <= bad
        if name == "mixing":
            want = {r.doc_id: r.taken // r["size"] for r in mixing.mixture(before).collect() if r.taken}
            assert collections.Counter(r.doc_id for r in rows) == want
        if name == "sharding":
            sizes = collections.Counter(r.shard for r in rows)
            assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 1 and len(rows) == before.count()
        before = after


def test_toxicity_stage_drops_what_the_operator_predicts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scorer = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_toxicity(docs, scorer).collect()
    assert any(toxicity.THRESHOLD <= r.score < 0.5 for r in scored)
    kept = collections.Counter(r.doc_id for r in corpus_pipeline.toxicity(spark, docs, sf_dir).collect())
    assert kept == collections.Counter(r.doc_id for r in scored if not r.predicted)


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 50 and {"doc_id", "text", "shard", "slot"} <= set(out.columns)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot string, th long, key double"


def odd_rows():
    long = " ".join(f"word{k % 977} other{k % 389}" for k in range(40_000))
    texts = [(1, None, None), (2, "", "a"), (3, " \n ", "a"), (4, "one word", "b"), (4, "another text of the same id", "b"), (None, "no id here", None), (None, "no id here", None), (None, None, None), (5, long, "c"), (6, long, "c"), (7, "tie tie tie", "a"), (8, "tie tie tie", "a")]
    return [(i, t, None, s, None, 3, "mine", 9, 0.5) for i, t, s in texts]


def test_stages_on_odd_rows(spark, sf_dir):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        if k < 4:
            assert out.columns == docs.columns and all(r.th == 9 and r.key == 0.5 for r in rows)
        if name == "near_duplicates":
            assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "2", "3", "4", "4", "None", "None", "None", "5", "7"])
        if name == "sharding":
            assert len(rows) == len(odd_rows()) and sorted({r.shard for r in rows}) == list(range(8)) and all(r.key == 0.5 for r in rows)


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_stages_with_columns_of_every_helper_name(spark, sf_dir):
    """Whatever name a stage gives a column of its own may be a column of the input."""
    home = Path(corpus_pipeline.__file__).parent / "chronoloom" / "llm"
    names = set()
    for module in ("common", "toxicity", "neardup", "decontaminate", "mixing", "sharding"):
        text = (home / f"{module}.py").read_text()
        names |= set(re.findall(r'(?:alias|withColumn|withColumnRenamed|fresh)\((?:\w+, )?f?"(\w+)"', text)) | set(re.findall(r'"((?:mix|sh|nu)_\w+|\w+_r|\w+_of_part)"', text))
    names |= {"doc_r", "source_r", "size_r", "tie_r", "sh_ends", "sh_start", "doc_id_of_part", "count", "mix_doc_id_of_plan"}
    names -= {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"}
    docs = spark.createDataFrame(odd_rows(), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(9).alias(n) for n in sorted(names)))
    docs = docs.unionByName(docs.where("doc_id = 4"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        assert rows and set(docs.columns) <= set(out.columns) and all(r[n] == 9 for r in rows for n in names), name
