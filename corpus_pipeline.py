"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; :func:`run` writes each stage's
result as Parquet to the shared folder and hands the reread table on. All but the last return the columns of documents.

* toxicity: documents judged toxic go
* near_duplicates: one document of each group of linked documents stays, the one with the smallest id
* personal_data: e-mail addresses, numbers and accounts are replaced by their kind, and ``n_chars`` follows
* mixture: documents are repeated or left out so that sources meet their weights
* packing: the mixture's token pieces get a sequence and an offset

Defined cases: a null or empty text passes every stage (neutral, no copy, nothing to mask, size 0, one piece); rows without an id are kept by the
first three stages, of rows that share one the second keeps one; columns of any name are carried through the first four stages; repeated rows
are one document after the second stage; an empty table stays empty; very long texts are whole in every stage, in one row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import documents, ship, staged
from barloom.llm.jaccard import jaccard_components
from barloom.llm.mixing import mix
from barloom.llm.packing import pack_documents
from barloom.llm.pii import redact
from barloom.llm.toxicity import toxicity


def keep(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is among ``ids``; the ids grow with the input, so they are joined by a shuffle."""
    return docs.join(ids.hint("merge"), "doc_id", "left_semi").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rated = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    toxic = rated.where("predicted = 1").select("doc_id").distinct()
    # an anti join keeps rows without an id
    return docs.join(toxic.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without an id are no document's copy and stay; of rows that share an id one stays."""
    parts = jaccard_components(docs.select("doc_id", "text"))
    first = keep(docs, parts.where("doc_id = component_id").select("doc_id").distinct())
    # the row travels as one struct, so that none of its columns can clash
    boxed = first.select(F.col("doc_id").alias("id"), F.struct("*").alias("doc"))
    same = Window.partitionBy("id").orderBy(F.xxhash64("doc"), "doc.text")
    one = boxed.withColumn("place", F.row_number().over(same)).where("place = 1").select("doc.*")
    return one.unionByName(docs.where("doc_id IS NULL"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", remove_personal_data),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]

#: Model fits, set joins and packing are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
