"""The corpus pipeline: quality, near duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as
Parquet in the shared folder and hands what it reads back to the next. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import mixing, packing, quality, simhash, suffix
from quillon.llm.common import quoted, scratch, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier takes for good.

    Null texts count as empty; null or missing sources, languages and lengths are values of their own; repeated rows
    share their fate; without labels of both kinds all documents stay; an empty table gives none.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each group of documents alike by 0.8 or more in their five-word shingles.

    The first has the least doc_id, of equal ones the least hash of the text. Of rows alike in doc_id and text one stays;
    other texts under one doc_id are documents of their own; rows without a doc_id stay; texts without words are copies
    of one another; a text of under five words is one shingle; an empty table gives none.
    """
    return simhash.keep_first(docs, width=5, least=0.8)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes or more that stand earlier in the corpus; n_chars, if there, follows.

    Null texts become empty; rows without a doc_id come first; a document whose text is all found earlier stays, with an
    empty text; an empty table gives none.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    plain = docs.select("doc_id", "text", *[c.alias(f"r{n}") for n, c in enumerate(quoted(docs, *rest) if rest else [])])
    cut = suffix.dedup(plain, carry=[f"r{n}" for n in range(len(rest))], text="text")
    back = {"doc_id": F.col("doc_id"), "text": F.col("text")} | {c: F.col(f"r{n}") for n, c in enumerate(rest)}
    if "n_chars" in docs.columns:
        back["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut.select(*[back[c].alias(c) for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for each time that the mix takes a document, dealt to shards and shuffled.

    Null sources are one source; documents without words are taken as often as their block; repeated rows count once
    each; an empty table gives none.
    """
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with the sequence and the offset that best-fit decreasing gives them.

    A null or empty text is its end id; null doc_ids are kept; repeated rows are packed once each; an empty table gives none.
    A small cache of units: other stages' Python workers wait beside this one's.
    """
    return packing.pack_documents(docs, room=100_000).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL expresses the classifier, the near-duplicate groups or the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
