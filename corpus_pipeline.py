"""The corpus pipeline: each stage's result is written and read again as the next one's documents.

toxicity drops the documents that it predicts to be toxic; line dedup cleans texts of their host's boilerplate;
n-gram Jaccard join keeps the least id of each group of near duplicates; mixing takes each source's words to its
target; packing cuts what is left into sequences. All but the last return the columns of documents; extra columns
pass through. Null texts are kept until mixing, which takes no words of them. Documents of a null id are in no group.
Stages that send texts to Python workers bound the session's Arrow batches, as they are in memory beside the JVM's heap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm import jaccard, lines, mixing, packing, toxicity
from tarnlake.session import bound_batches, materialize, table


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return toxicity.keep_clean(docs, toxicity.fit_sample(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = lines.dedup_lines(docs, names=("__lines_in", "__lines_out"))
    n_chars = F.when(F.col("__lines_out") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).select(*_own(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    found = jaccard.jaccard_components(docs).where("doc_id <> component_id").select("doc_id")
    return docs.join(materialize(found, "copies"), "doc_id", "left_anti").select(*_own(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bound_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: The stages hold trained models and pieces of a tokenizer, so there is no SQL for them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
