"""The corpus pipeline: toxicity, line deduplication, near duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last keep the columns of documents. run() applies them in order, each reading
what the stage before it wrote to the shared folder.

Defined cases: a null text stays null and is packed as its end id alone; rows
with a null id are never copies of others and stay; rows of equal ids each stand
for themselves until the Jaccard stage, which drops rows by id; without labels of
both kinds no document is rejected; an empty table gives no rows; other columns
pass through up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelet.llm import decontaminate, jaccard, lines, packing, toxicity
from tracelet.llm.common import cut, table
from tracelet.llm.queries import tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.keep_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("jaccard_join", dedup_near),
    ("decontamination", decontaminate_benchmark),
    ("packing", pack),
]
ORACLE_SQL = None  # compression distance, alignment and the tokenizer aren't SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
