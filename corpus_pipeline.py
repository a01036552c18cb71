"""A training corpus from documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

All stages keep columns that they don't know, whatever these are called, give an empty table for an empty
one, and read texts of any length whole. Rows are told by id and text: what befalls a row doesn't depend on
others that repeat its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import new_path, table
from turnlake.llm.queries import toxicity_lexicon

SHARDS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold. Null and empty texts are clean and stay; repeated rows stay or
    go together; without labels of both kinds nothing goes."""
    from turnlake.llm.toxicity import keep_clean

    return keep_clean(docs, toxicity_lexicon(spark, docs, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id. Rows without an id or without words stay, as do
    rows that repeat the id and text of the one that stays; ties are broken by the texts' digests."""
    from turnlake.llm.ngram_join import one_of_each

    return one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts stay; without items nothing goes."""
    from turnlake.llm.decontaminate import without_leaks

    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. A null source is one of its own; documents without words take no
    words, and are kept as often as their source's whole copies; rows that repeat an id are taken or left together."""
    from turnlake.llm.mixing import pareto_mix, word_count

    mixed = pareto_mix(docs, word_count(F.col("text")))
    repeated = mixed.where("copies > 0").withColumn("copies", F.explode(F.expr("sequence(1, cast(copies as int))")))
    return repeated.select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their place in it; null texts go with empty ones, repeated rows take a place each."""
    from turnlake.llm.sharding import minimax_shards

    return minimax_shards(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: SQL can't express the learned lexicon or the latent search; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
