"""The corpus pipeline: quality rules, exact and near deduplication, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents. A stage's result has a method release(), which deletes the tables it is read from; nothing
is deleted before it is called. No SQL is given for run(): the boosted trees, the near-duplicate classes, the mix and
the packing are tested against brute-force versions instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voltrace.llm.common import materialize, release_scratch, scratch_mark, with_scratch
from voltrace.llm.exact_dedup import one_of_each
from voltrace.llm.jaccard_join import one_of_each_class
from voltrace.llm.mixing import mix
from voltrace.llm.packing import best_fit_packing
from voltrace.llm.quality_rules import quality_rules
from voltrace.llm.queries import public_vocabulary

ORACLE_SQL = None


@with_scratch
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, labels, payload=docs.columns, prefix="_made_").filter("_made_kept").select(*docs.columns)


@with_scratch
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal without white space."""
    return one_of_each(docs)


@with_scratch
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five-word shingles, similarity 0.8 or more."""
    return one_of_each_class(docs, n=5, percent=80)


@with_scratch
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the shards draw them: moved to their shard (one or more partitions) and shuffled inside it."""
    columns, order = docs.columns, ("mix_shard", "mix_place")
    return mix(docs).repartitionByRange(*order).sortWithinPartitions(*order).select(*columns)


@with_scratch
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, as token ids, in training sequences."""
    return best_fit_packing(docs, public_vocabulary())


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources", mixed),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, begin = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_mark()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release_scratch(begin, keep=(docs,))  # what it was made of
    return STAGES[-1][1](spark, docs, sf_dir)
