"""A corpus pipeline: score, deduplicate, mix and encode documents.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before kept, and returns a DataFrame. All
but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm import exact_dedup, minhash_dedup, mixing, quality_classifier, sentencepiece_codec
from trackweave.llm.common import bounded_batches, documents, held_out, new_folder, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from labelled documents that are not held out.

    Null texts are scored as empty ones, rows that repeat alike; an empty table gives no rows, and without labels all rows stay.
    """
    bounded_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    data = quality_classifier.train(docs.filter(~held_out(F.col("doc_id"))), labels)
    return quality_classifier.scored(docs, data).filter("predicted = 1").select(*docs.columns)


def ids_name_rows(docs: DataFrame) -> bool:
    """Whether each row has an id of its own."""
    n, ids = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    return n == ids


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def kept_rows(docs: DataFrame, groups: Callable[[DataFrame, str], DataFrame], group: str, first: Callable[[Column, Column], Column]) -> DataFrame:
    """One row of each group. ``groups`` takes docs and the name of a column of distinct ids, and gives doc_id, ``group`` and kept for each.

    Where ids are distinct, the rows marked as kept stay. Else each row gets a number and a hash of its values, in a written copy, and
    of a group the row that ``first`` (an aggregate of the id and of a struct of id, hash and number) picks stays.
    """
    bounded_batches(docs.sparkSession)
    of = unused(docs, "of")
    if ids_name_rows(docs):
        best = groups(docs, "doc_id").filter("kept").select(F.col("doc_id").alias(of))
        return docs.join(best, F.col("doc_id") == F.col(of), "left_semi")
    row, tie = unused(docs, "row_"), unused(docs, "tie_")
    rows = written(docs.withColumns({row: F.monotonically_increasing_id(), tie: F.xxhash64(*docs.columns)}), "numbered")
    known = groups(rows, row).select(F.col("doc_id").alias(of), F.col(group).alias("group_of"))
    members = rows.select("doc_id", F.struct("doc_id", tie, F.col(row).alias("number")).alias("who"), row).join(known, F.col(row) == F.col(of))
    best = members.groupBy("group_of").agg(first(F.col("doc_id"), F.col("who"))["number"].alias(of))
    return rows.join(best, F.col(row) == F.col(of), "left_semi").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows of equal texts the one with the largest id stays, and one only: nulls are least, equal ids are picked from by a hash.

    Null texts are empty ones; an empty table gives no rows; other columns may have any name.
    """
    return kept_rows(docs, exact_dedup.exact_groups, "keep_id", lambda _, who: F.max(who))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a similarity of 0.8 or more on five-word shingles, the one with the smallest id stays.

    Each row is a document of its own, also if its id repeats or is null; null is the last to stay. Empty and null texts are
    connected with nothing and stay; an empty table gives no rows; other columns may have any name.
    """
    return kept_rows(docs, minhash_dedup.near_groups, "component_id", lambda doc_id, who: F.min_by(who, F.struct(doc_id.isNull(), who)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the curriculum takes them, in training order: one row per copy, none for those that the mix leaves out.

    Null and empty texts have no words and are left out; a null source is one of its own; an empty table gives no rows; other columns
    may have any name.
    """
    position = unused(docs, "position_")
    copies = mixing.curriculum_mix(docs, carry=True).select("carried.*", F.explode("positions").alias(position))
    return copies.repartitionByRange(position, "doc_id").sortWithinPartitions(position, "doc_id").drop(position)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each row and the SHA-256 of the text that they decode to: doc_id, ids, n_tokens, decoded_sha256.

    Null texts are empty ones, which have no ids; rows that repeat an id are rows of their own; an empty table gives no rows.
    The ids are written before they are decoded: the tables of surfaces would else be in every plan of the encoding that
    the driver describes anew as its shuffles end.
    """
    bounded_batches(spark)
    vocabulary = sentencepiece_codec.Vocabulary.load(sentencepiece_codec.MODEL)
    coded = sentencepiece_codec.decode(written(sentencepiece_codec.encode(docs, vocabulary), "ids"), vocabulary)
    return coded.select("doc_id", "ids", "n_tokens", F.sha2(F.col("text"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_texts),
]

#: No SQL expresses a trained classifier or SentencePiece ids; tests check the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        path = new_folder(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
