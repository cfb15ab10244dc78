"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next one's documents. A stage works on all that the one before it kept. All
stages but the last return the columns of documents that they were given; any others go.

Defined cases: a null or empty text fails the quality rules; later stages, given one, pass it on,
and near dedup keeps one document of all without words. Rows of one id and rows without an id are
documents of their own to near dedup. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import decontaminate, lines, near, packing, quality
from loomlog.session import prepare, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# tokenised texts and hashed counts: no SQL gives these rows
ORACLE_SQL = None


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*(c for c in COLUMNS if c in docs.columns))


def _with_text(kept: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """The columns of documents with another text; the count of characters follows it."""
    changed = kept.drop("text").withColumnRenamed(text, "text")
    if "n_chars" in columns:
        kind = kept.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.length("text").cast(kind))
    return changed.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go."""
    docs = _documents(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judge(docs, quality.fit(docs, labels)).filter("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first; all documents stay."""
    docs = _documents(docs)
    return _with_text(lines.drop_recurring(docs), "kept_text", docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar texts stays, that with the smallest id.

    Texts are linked at a similarity of five-word shingles of 0.8 and more. Every row is a
    document of its own; of rows with one id the first stays, rows without an id come last.
    """
    return near.first_rows(_documents(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents beyond the coverage limit go; spans of a window and more are cut from others."""
    docs = _documents(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.scan(docs, items, texts=True)
    return _with_text(
        found.filter(~decontaminate.contaminated()), "clean_text", docs.columns
    )


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two length."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; every stage but the last is a written table."""
    prepare(spark)
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/stage{k}")
            docs = spark.read.parquet(f"{folder}/stage{k}")
    return docs
