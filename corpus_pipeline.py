"""A training corpus from `documents`: filter, deduplicate, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir) and decides on all that the stage before kept; all but
the last return the columns of documents, and other columns that docs has. In every stage a null
text counts as empty, repeated rows are decided alike (the join keeps one row of a group unless
they share its smallest doc_id), and an empty table gives no rows; a null doc_id is linked with
nothing and meets no label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from courtline.llm.feistel_shards import shard_rows
from courtline.llm.mixing import emit
from courtline.llm.ngram_join import one_of_each_group
from courtline.llm.quality import quality_filter
from courtline.llm.store import documents, stash
from courtline.llm.winnow import without_contaminated


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what fails the base rules or exceeds a risk-controlled cutoff."""
    return quality_filter(docs, documents(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies."""
    return one_of_each_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return without_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or thins documents towards the sources' targets."""
    return emit(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives every row of the mix its shard and slot."""
    return shard_rows(docs, keep=("text", "source", "lang", "n_chars"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mixing", source_mixing),
    ("sharding", sharding),
]

#: Hashes and iteration are beyond the SQL twin's reach; the test compares with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table is dropped when the next one's is written."""
    docs, drop = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        docs, discard = stash(stage(spark, docs, sf_dir))
        if drop:
            drop()
        drop = discard
    return STAGES[-1][1](spark, docs, sf_dir)
