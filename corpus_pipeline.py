"""A corpus pipeline of five stages; each works on all that the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, decontaminate, language, line_dedup, ngram_jaccard
from cairn.llm.common import Scratch, fresh, quote, table


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a struct row of all other columns, whose names can then clash with nothing."""
    rest = [F.col(quote(c)) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(None).cast("int").alias(fresh(docs, "none"))).alias("row"))


def _unpacked(df: DataFrame, docs: DataFrame, **new) -> DataFrame:
    """The columns of docs again, with new values for some of them."""
    return df.select(*[new.get(c, F.col(c if c in ("doc_id", "text") else f"row.{quote(c)}")).alias(c) for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null, no letter); lang becomes the one with the largest share, however many the document holds."""
    good = language.language_id(docs, keep=tuple(docs.columns)).where("lang_pred <> 'und'")
    return good.select(*[F.col("lang_pred" if c == "lang" else f"row.{quote(c)}").alias(c) for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; a document of which nothing but white space is left goes."""
    out = line_dedup.dedup_lines(_packed(docs), short_repeats=True)
    left = (F.col("n_dropped") == 0) | F.col("text").rlike(r"\S")
    return _unpacked(out.where(left), docs, n_chars=F.length("text").cast("long"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that of the smallest doc_id (null is the largest), of each group of five-word shingle similarity 0.8 or more; rows without words stay."""
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1").limit(1).count()
    at = fresh(docs, "_row")
    rows = docs.withColumn(at, F.col("doc_id").cast("long"))
    if odd:
        #: rows in order of doc_id (nulls last) and text hash, then by all columns, with numbers that rise in this order; equal rows are equal sets of the join
        order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), *[F.col(quote(c)) for c in docs.columns if c != "doc_id"]]
        rows = Scratch(spark, "pipeline-rows").cut(docs.orderBy(*order).withColumn(at, F.monotonically_increasing_id()))
    groups = ngram_jaccard.ngram_jaccard_components(rows.select(F.col(at).alias("doc_id"), "text"), width=5, percent=80)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(at)).distinct()
    return rows.join(gone, at, "left_anti").select(*map(quote, docs.columns))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark items."""
    found = decontaminate.decontaminate(_packed(docs), table(spark, sf_dir, "benchmark"))
    return _unpacked(found.where(~F.col("contaminated")), docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.bpe_digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level BPE", token_stage),
]

#: Language mixtures and edit joins are not expressible in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
