"""A corpus from raw documents to token ids in five stages, each of which works on all that the one before kept.

Of an empty table every stage makes an empty table. Columns of documents may have any further names beside them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.llm import bpe, langid, mixing, near_dedup, substring
from barline.llm.scratch import cut

#: A document whose best language has a lower mean probability over its letters is rejected.
LEAST_SCORE = 0.4
#: Rows that Spark hands to a Python worker at a time: whole texts, so that workers and executors hold some MB of them.
BATCH_ROWS = 2000
#: The most times that mixing repeats a source; each is read in whole at least once.
REPETITION = 1.5


def _lean(spark: SparkSession) -> None:
    """Sets the session's batches to BATCH_ROWS rows, for this and the stages that follow."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def _packed(docs: DataFrame, *own: str) -> DataFrame:
    """docs as the columns `own` and one, rest, that holds all others, whose names thus meet no name of an operator."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(*own, F.struct(*rest, F.lit(None).cast("int").alias("_none")).alias("rest"))


def _whole(packed: DataFrame, names: list[str], *own: str) -> DataFrame:
    """The columns `names` from what _packed() made."""
    return packed.select(*[F.col(c) if c in own else F.col(f"rest.`{c}`") for c in names])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have letters and a language. Null, empty and letterless texts and those without a clear language go;
    rows that repeat stay or go alike; where no row has a lang nothing can be learned, and all go."""
    _lean(spark)
    told = langid.language_id(_packed(docs, "doc_id", "text", "lang")).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return _whole(told, docs.columns, "doc_id", "text", "lang")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near copies: five-word shingles alike from 0.8 on.

    Documents without words or without doc_id stay. Of rows that repeat a doc_id with the same text one stays, that of
    least hash of all columns. An id that names several texts keeps them all if one of them stays.
    """
    _lean(spark)
    told = near_dedup.near_duplicates(docs, 80).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or("kept").alias("_kept"), F.count("*").alias("_rows"))
    odd = cut(told.where("NOT _kept OR _rows > 1"), "gone")
    names = docs.columns
    again = docs.join(odd.where("_kept").select("doc_id"), "doc_id", "left_semi")
    first = Window.partitionBy("doc_id", "text").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in names]))
    again = again.withColumn("_place", F.row_number().over(first)).where("_place = 1")
    return docs.join(odd.select("doc_id"), "doc_id", "left_anti").select(*names).unionByName(again.select(*names))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document, or an earlier place, has; what is left without a word goes. A null
    or untouched text stays as it is, n_chars too; rows without doc_id stay; rows that repeat keep the same."""
    _lean(spark)
    own = ("doc_id", "text", "n_chars")
    told = substring.substring_dedup(_packed(docs, *own)).where("size(removed) = 0 OR text RLIKE '[^ \\\\x09-\\\\x0D]'")
    told = told.withColumn("n_chars", F.when(F.size("removed") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return _whole(told, docs.columns, *own)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at a temperature at which the rarest is read at most REPETITION times as often as the largest, each at least
    once; a null source is one of its own, and a source without text comes once."""
    row = docs.select("doc_id", "source", F.expr(mixing.TOKENS).alias("n"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return mixing.mix(row, repetition=REPETITION, tokens="n").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document, as often as the mixture has it; a null text is empty."""
    _lean(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE", tokens),
]

#: SQL has no recurrent networks, MinHash or merges: tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, "stage")
    return docs
