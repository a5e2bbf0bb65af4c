"""From raw documents to packed training sequences, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import exact, packing, quality, secrets, simhash
from cadenza.llm.common import bitmap, new_path, spare, table, with_bit, written
from cadenza.llm.queries import tokenizer_path

#: No stage but the second can be expressed in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Each row is judged by its text alone, so equal texts stay or go together, whatever their ids; null
    texts are judged as empty ones and stay null; a score that equals the threshold stays; an empty table gives an empty result."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that tells rows apart, whatever ids they have, and its name. It stands for the row's file and place there (of 10^10 rows
    about three pairs would share one); rows that come from no file are numbered and written."""
    (row,) = spare(docs, "_row")
    try:
        return docs.withColumn(row, F.xxhash64("_metadata.file_path", "_metadata.row_index")), row
    except AnalysisException:  # not a table of files
        return written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) one document stays, that with the smallest id. Rows that share an id but not a text stay; null
    texts are empty ones; null ids go where another id is there."""
    rows, row = numbered(docs)
    stay = exact.exact_groups(rows, row_col=row).where("kept").select(F.col("row").alias(row))
    return rows.join(stay, row, "left_semi").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays, that with the smallest id. Rows that share an id but are not alike stay."""
    rows, row = numbered(docs)
    stay = simhash.near_groups(rows, row_col=row).where("kept").select(F.col("row").alias(row))
    return rows.join(stay, row, "left_semi").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; each secret in its text is replaced by a mark, and n_chars follows. Rows without a finding are as
    before, so null texts stay null; repeated rows are redacted each time; an empty table gives an empty result."""
    blob, spans, some = spare(docs, "_blob", "_spans", "_some")
    found = secrets.blob_findings(secrets.update_ledger(docs)).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    found = written(found, "findings")
    rows = docs.withColumn(blob, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    # only texts that may have findings are shuffled
    rows = with_bit(rows, blob, bitmap(found, blob), some)
    hit = rows.where(F.col(some)).join(found, blob, "left")
    clean = F.when(F.col(spans).isNull(), F.col("text")).otherwise(secrets.redacted(F.col("text"), F.col(spans)))
    hit = hit.withColumn("text", clean)
    hit = hit.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast("long"))
    return hit.select(*docs.columns).unionByName(rows.where(~F.col(some)).select(*docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences of 2048. Null and empty texts give one piece of the closing id; rows with null or
    repeated ids and repeated rows have pieces and places of their own; pieces of equal length go by id, which may be told apart by nothing
    but their tokens; other columns are left out; an empty table gives an empty result."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("redact_secrets", redact_secrets),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
