"""A corpus pipeline of five stages, each one operator of docloom.llm.

Each stage is a function of (spark, docs, sf_dir) and gets all that its predecessor kept. run() writes
every stage's result as Parquet in the shared folder and reads it again for the next.

1. language: documents whose language is not known with a probability of a half or more go;
2. toxicity: documents that score 0.7 or more go;
3. near_duplicates: of each class of near-duplicates the document with the smallest doc_id stays;
4. decontamination: documents that hold a window of a benchmark item go, however long they are;
5. packing: what is left is packed, a row per piece.

Null texts have no language, and so go first. Extra columns go along to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import decontam, langid, minhash, packing, toxicity
from docloom.llm.common import materialise, prepare, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.documents_packed(docs)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packed)]

#: The classifiers and the signatures are not expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
