from __future__ import annotations

import re
from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_dedup_and_decontamination import brute_hits, lower
from test_simhash_wide import brute_sets, brute_similar

from riskloom.llm import quality, scratch


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Rows after each stage, the first being all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = docs.limit(5).withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 100_000))
    out = [docs.unionByName(extra).withColumn("row", F.lit("clash")).withColumn("uid", F.lit(1))]
    for name, function in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        function(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_the_columns_of_documents(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])
    assert stages[-1].columns[: len(stages[0].columns)] == stages[0].columns


def test_quality_stage_equals_its_scores(spark, sf_dir, stages):
    model = quality.train(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = quality.score(stages[0], model, stages[0].columns).where("score >= 0.7").select("row.*")
    assert good.exceptAll(stages[1]).isEmpty() and stages[1].exceptAll(good).isEmpty()


def test_exact_stage_keeps_the_largest_id_of_each_text(stages):
    groups = defaultdict(list)
    for r in stages[1].collect():
        groups[lower(r.text)].append(-1 if r.doc_id is None else r.doc_id)
    kept = stages[2].collect()
    assert len(kept) == len(groups)
    assert all((-1 if r.doc_id is None else r.doc_id) == max(groups[lower(r.text)]) for r in kept)


def test_near_stage_equals_brute_force(stages):
    rows = stages[2].collect()
    ids = [10**9 if r.doc_id is None else r.doc_id for r in rows]
    smallest = brute_similar(brute_sets([r.text for r in rows]), ids)
    got = sorted(10**9 if r.doc_id is None else r.doc_id for r in stages[3].collect())
    assert got == sorted(smallest)


def test_decontamination_stage_equals_brute_force(spark, sf_dir, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = stages[3].collect()
    hits = brute_hits([(i, r.text) for i, r in enumerate(rows)], items)
    clean = sorted(str(r) for i, r in enumerate(rows) if not hits[i][4])
    assert sorted(str(r) for r in stages[4].collect()) == clean


def test_mixing_stage_meets_the_targets(stages):
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in stages[4].collect())
    taken = stages[5].agg(F.sum("mix_words")).first()[0]
    assert abs(taken - words) <= stages[4].select("source").distinct().count()


def test_overlapping_runs_keep_their_tables(spark, sf_dir):
    first, second = corpus_pipeline.run(spark, sf_dir), corpus_pipeline.run(spark, sf_dir)
    assert first.count() == second.count() > 50


def test_a_stage_frees_what_the_one_before_kept(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.exact(spark, docs, sf_dir)
    own = scratch._marked[kept.schema["doc_id"].metadata[scratch._MARK]]
    assert own.paths
    scratch.release_behind(kept, "doc_id")  # not written yet: it still reads its tables
    assert own.paths and kept.count() > 50
    kept.write.parquet(f"{tmp_path}/kept")
    corpus_pipeline.decontamination(spark, spark.read.parquet(f"{tmp_path}/kept"), sf_dir)
    assert not own.paths


def test_stages_take_empty_tables(spark, sf_dir):
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    assert all(function(spark, none, sf_dir).count() == 0 for _, function in corpus_pipeline.STAGES)
