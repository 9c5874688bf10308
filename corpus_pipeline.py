"""Corpus pipeline: each stage's result is written as Parquet and read as the next one's documents."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import decontaminate, exact_dedup, mixing, quality, scratch, simhash_wide


def stage(function):
    """What the stage that ``docs`` is the written result of keeps in the shared folder goes first. This one's own tables
    stay until its result, in turn, has been written and is read by a stage; other runs' tables are never touched."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.release_behind(docs, "doc_id")
        with scratch.scope(spark, keep=True) as own:
            return scratch.marked(function(spark, docs, sf_dir), own, "doc_id")

    return run_stage


@stage
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not reject.

    Null and empty texts score the sample's share of good documents; null ids are scored like others; with an empty
    ``labels`` table every score is 0.5, below the cut.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of texts that are equal after lower-casing A-Z, that with the largest id.

    Null texts are empty ones, null ids are smallest, and of rows repeated with the largest id one stays.
    """
    return exact_dedup.drop_copies(docs)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, that with the smallest id: five-word shingles, similarity 0.8 or more.

    Null and wordless texts are one class; null ids are largest; repeated rows are near copies.
    """
    return simhash_wide.drop_near_copies(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share too little with the benchmark to count as contaminated.

    Null and wordless texts are clean; with an empty ``benchmark`` table all documents are.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight, in shuffled shards; a document comes once for each time that it is drawn.

    A null source is a source of its own, last in order; documents without words are in no mix.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontamination),
    ("mixing", mix),
]

#: Trained scores, shingle fingerprints and hashed permutations have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; the last stage's tables and its input stay for the caller."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, function in STAGES[:-1]:
        path = scratch.folder(spark, f"pipeline-{name}")
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            scratch.remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
