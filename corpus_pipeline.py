"""A training corpus from `documents`: quality rules, line dedup, near-duplicate documents, source mixture, packing.

Every stage is a function of (spark, docs, sf_dir), works on all rows of its predecessor and, but for the last, returns
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspan.llm import jaccard, lines, mixing, packing, quality
from mailspan.llm._common import table, written


def _numbered(docs: DataFrame) -> DataFrame:
    """`docs` under column names that no operator uses, so that none of its columns is taken for an operator's."""
    return docs.toDF(*(f"_{c}_{i}" for i, c in enumerate(docs.columns)))


def _name(docs: DataFrame, column: str) -> str:
    return f"_{column}_{docs.columns.index(column)}"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go. Null and empty texts have no words and go; equal rows get the same verdict; columns
    of any name keep their contents; an empty table stays empty."""
    wide = _numbered(docs)
    return quality.cascade(wide, _name(docs, "text")).filter("kept").select(*wide.columns).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and so do documents of which nothing is left. n_chars follows the text. Null texts stay as they are;
    rows of equal id and text lose the same lines; columns of any name keep their contents."""
    wide, text = _numbered(docs), _name(docs, "text")
    out = lines.dedup_lines(wide, _name(docs, "doc_id"), text)
    out = out.filter(rf"n_removed = 0 or {text} rlike '[^\\x20\\x09-\\x0D]'")
    if "n_chars" in docs.columns:
        n = _name(docs, "n_chars")
        out = out.withColumn(n, F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col(n)).cast(docs.schema["n_chars"].dataType))
    return out.select(*wide.columns).toDF(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays: that of the smallest id, one without an id only if all lack it.
    Rows of equal id and text are one document, of which one row stays; rows of equal id and other texts are others."""
    wide = _numbered(docs)
    return jaccard.one_of_each(wide, _name(docs, "doc_id"), _name(docs, "text")).select(*wide.columns).toDF(*docs.columns)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their weights: each document once at least, those of small sources again in later epochs. Null sources are
    one source; rows that agree in id, source and text are shown as often as one another; texts without words and long ones stay whole;
    columns of any name keep their contents; an empty table stays empty."""
    wide = _numbered(docs)
    ident, source, text = (_name(docs, c) for c in ("doc_id", "source", "text"))
    shown = mixing.mixed(wide, ident, source, text).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("source").alias("s"), F.col("epoch").alias("e")).distinct()
    same = wide[ident].eqNullSafe(F.col("d")) & wide[source].eqNullSafe(F.col("s")) & (F.coalesce(F.md5(wide[text].cast("binary")), F.lit("")) == F.col("h"))
    return wide.join(shown, same).select(*wide.columns).toDF(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, packed into sequences. Null and empty texts are an end id alone, long ones are cut into pieces,
    repeated rows are packed each, and ties in length go by a hash of the piece; other columns are ignored, whatever their names; an
    empty table gives no pieces."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources", source_mixture),
    ("best-fit packing", best_fit_packing),
]

#: SQL has no SimHash over the same hash, and no packing: the pipeline is tested against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
