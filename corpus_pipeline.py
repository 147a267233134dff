"""From raw documents to packed training sequences, in stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and read
again as the documents of the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweave.llm.lines import drop_repeated_lines
from logweave.llm.neardup import drop_near_duplicates
from logweave.llm.packing import pack_documents
from logweave.llm.quality import quality
from logweave.llm.queries import table, tokenizer_path
from logweave.llm.secrets import redact
from logweave.llm.shared import written


def _as_before(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; where there is ``n_chars`` it follows the text."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*(F.col(f"`{c}`") for c in docs.columns))


def _set_aside(docs: DataFrame, *used: str) -> DataFrame:
    """The columns a stage uses, and all others in one struct, where no result's name meets theirs."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(*rest, F.lit(None).cast("int").alias("none")).alias("row"))


def _back(changed: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of ``docs``, in their order, after ``_set_aside``."""
    return changed.select(*(F.col(f"`{c}`") if c in used else F.col(f"row.`{c}`") for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and read like their language.

    A null or empty text has no words and goes. A null language, or one without a reference, is judged by
    the base rules alone. Repeated rows are judged one by one; an empty table stays empty.
    """
    judged = quality(_set_aside(docs, "text", "lang"))
    return _back(judged.where("kept"), docs, "text", "lang")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines removed; a document of which nothing is left goes.

    A null text goes, as it has nothing. Among equal rows the run stays in one of them.
    """
    cleaned = drop_repeated_lines(_set_aside(docs, "doc_id", "text"))
    left = cleaned.where((F.col("n_removed") == 0) | (F.btrim("text", F.lit(" \t\r\n\x0b\x0c")) != ""))
    return _as_before(_back(left, docs, "doc_id", "text"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, linked at a similarity of 0.8 or more.

    Null and empty texts link with nothing and stay; of rows equal in id and text one stays.
    """
    return drop_near_duplicates(docs, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by a mark. Null texts stay null; repeated rows are treated one by one."""
    return _as_before(_back(redact(_set_aside(docs, "text")), docs, "text"), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and the sequence each goes to; a null or empty text is one piece, the end token."""
    return pack_documents(docs.select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secrets", secret_scan),
    ("packing", packing),
]

# Packing and MinHash have no SQL form; tests/llm hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
