"""From raw documents to packed batches: five stages over the whole corpus.

Each stage takes all that the one before kept and its decisions take effect. Between stages the
documents are written as Parquet and read again. Null texts, null ids, ties, repeated rows, empty
tables and further columns have the results that the operators' docstrings define.

SQL can express neither a trained classifier nor shingle hashes, so there is no SQL text; a
brute-force version in the tests stands for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlens.llm import mixing, near_sets, packing, quality, repeats
from wattlens.session import drop_paths, owned_stages, ship_package, work_path

ORACLE_SQL: str | None = None
PASSAGE = 240  # bytes from which a passage counts as a repeat: some fifty short words
_left: list[str] = []  # intermediate tables of the stage before


def _stage(step: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage owns its intermediate tables; they go when the next one starts, which reads written documents."""

    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        drop_paths(spark, _left)
        with owned_stages(into=_left):
            return step(spark, docs, sf_dir)

    return run_step


@_stage
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a rating above the lowest is a half or more."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.grade_documents(docs, model).filter("selected").select(*docs.columns)


@_stage
def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word shingles."""
    return near_sets.one_of_each(docs).select(*docs.columns)


@_stage
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that recur; a text that was nothing else is dropped.

    Bytes of a character cut in two go with the passage.
    """
    stripped = repeats.remove_repeats(docs, PASSAGE, 48, as_text=True)
    some_left = (F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes"))
    kept = stripped.filter(some_left).withColumn("text", F.col("kept"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_stage
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    taken = mixing.mix(docs).filter("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


@_stage
def packed_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length, bucket, batch, slot and padding of every document of the mix."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("near-duplicates", distinct_documents),
    ("repeats", without_repeats),
    ("mix", mixed_sources),
    ("packing", packed_batches),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the documents in ``sf_dir``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, step in STAGES:
        path = work_path(spark, name.replace(" ", "-"))
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        drop_paths(spark, before)
        before = [path]
    drop_paths(spark, _left)
    return docs
