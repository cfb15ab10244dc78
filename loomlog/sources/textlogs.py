"""Text log files as lines."""

from __future__ import annotations

import codecs
from collections.abc import Iterable, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.fixed import grammar
from loomlog.sources.ranges import read_ranges

# Rows of the split table, a path and five numbers each, that may be broadcast.
BROADCAST_SPLITS = 1_000_000


# -- which files (S2) -----------------------------------------------------------------------


def discover_logs(
    spark: SparkSession, roots: Iterable[str], limit: int | None = None
) -> list[str]:
    """The log files under some roots, each once, in root and path order.

    A folder is searched to any depth for names that look like logs and gives all of them, or
    the first ``limit`` in path order where one is asked for; a file named directly is taken
    whatever its name. Only the listing is read, never the files.
    """
    found = find_logs(spark, roots, limit)
    return [row.path for row in found.orderBy("root_no", "path").select("path").collect()]


def find_logs(spark: SparkSession, roots: Iterable[str], limit: int | None = None) -> DataFrame:
    """``(path, root_no)`` of the files that ``discover_logs`` gives, as a table: for roots with
    more files than a driver should hold as a list. ``root_no`` is the first root that has the file.
    """
    listed = [f for f in (_listing(spark, r, i) for i, r in enumerate(roots)) if f is not None]
    if not listed:
        return spark.createDataFrame([], "path string, root_no int")
    files = reduce(DataFrame.unionByName, listed)
    if limit is not None:
        rank = F.row_number().over(Window.partitionBy("root_no").orderBy("path"))
        files = files.withColumn("rank", rank).filter(F.col("rank") <= limit)
    return files.groupBy("path").agg(F.min("root_no").alias("root_no"))


def _listing(spark: SparkSession, root: str, number: int) -> DataFrame | None:
    try:
        files = (
            spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        )
    except AnalysisException:
        return None  # a root that does not exist is skipped
    name = F.lower(F.substring_index("path", "/", -1))
    suffix = reduce(lambda a, b: a | b, [name.endswith(s) for s in grammar.LOG_SUFFIXES])
    part = reduce(
        lambda a, b: a | b, [F.contains(name, F.lit(p)) for p in grammar.LOG_NAME_PARTS]
    )
    itself = F.endswith(F.col("path"), F.lit(root.rstrip("/")))
    return files.select("path", F.lit(number).alias("root_no")).filter(suffix | part | itself)


# -- lines (S1, S3-S7) ------------------------------------------------------------------------


@contextmanager
def _lenient_charsets(spark: SparkSession):
    """Every Java charset, and a mark instead of an error for undecodable bytes. The flags
    are read when an expression is built, so they need not outlive this block."""
    flags = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    before = {flag: spark.conf.get(flag, None) for flag in flags}
    try:
        for flag in flags:
            spark.conf.set(flag, "true")
        yield
    finally:
        for flag, value in before.items():
            spark.conf.unset(flag) if value is None else spark.conf.set(flag, value)


def decode_text(value: Column, encoding: str = "utf-8") -> Column:
    """Bytes as text; what cannot be decoded becomes U+FFFD.

    Encodings go by any name Python knows. Java knows its canonical names as well, but for
    the hyphen in ``utf-16-be`` and its kin.
    """
    name = codecs.lookup(encoding).name.replace("utf-16-", "utf-16").replace("utf-32-", "utf-32")
    if name in ("utf-8", "utf-8-sig"):
        return F.make_valid_utf8(value.cast("string"))
    return F.decode(value.cast("binary"), name)


def _wide(encoding: str) -> bool:
    """Are the line ends of an encoding wider than a byte?"""
    return codecs.lookup(encoding).name.startswith(("utf-16", "utf-32"))


def _scan(spark: SparkSession, paths: Sequence[str], encoding: str) -> DataFrame:
    """Lines with the file and the split they come from, and their running id.

    Sets ``spark.sql.files.minPartitionNum`` for the session where it is unset.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        # Splits must not change between the two passes of the numbering, as they would if
        # executors joined in between.
        spark.conf.set(
            "spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism)
        )
    lines = spark.read.text(list(paths))
    with _lenient_charsets(spark):
        return lines.select(
            decode_text(F.col("value"), encoding).alias("raw"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().alias("_id"),
        )


def _splits(lines: DataFrame) -> DataFrame:
    """One row per split: its first id, the lines of the file before it, and its file's."""
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        lines.groupBy("file", "_block", "_part")
        .agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
        .withColumns({
            "_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)),
            "_lines": F.sum("_rows").over(Window.partitionBy("file")),
        })
    )


def read_log_files(
    spark: SparkSession,
    paths: Sequence[str],
    encoding: str = "utf-8",
    tail: int | None = None,
    keep_blank: bool = False,
    numbers: bool = True,
    most: int | None = None,
    index: str | None = None,
) -> DataFrame:
    """``(raw, source, line_number, file)`` of text files.

    Line numbers are absolute and count blank lines. They come from a first pass that counts
    the lines of every split, which reads no column of the file; the lines themselves are
    never shuffled for it. ``tail`` keeps the last lines of each file, counted before blank
    ones are dropped; 0 or None keeps all. Without ``numbers`` the files are read once and
    line numbers are null.

    ``most`` guards against endless lines: no more characters of one are held or given (S8).
    ``index`` keeps the counts of the first pass in a folder, so that files that have not changed
    are read once from then on (S3). With either, and for encodings wider than a byte, files are
    read by fixed byte ranges in Python; see ``ranges``.
    """
    if most is not None or index is not None or _wide(encoding):
        found = read_ranges(spark, paths, encoding, tail, most, index, numbers).drop("cut")
        return found if keep_blank else drop_blank(found)
    lines = _scan(spark, paths, encoding)
    if not numbers:
        if tail:
            raise ValueError("a tail needs line numbers")
        bare = lines.select(
            "raw", F.col("file").alias("source"),
            F.lit(None).cast("bigint").alias("line_number"), "file",
        )
        return bare if keep_blank else drop_blank(bare)
    splits = _splits(lines)
    # Every split is a file of its own or starts a partition, which bounds their number. Up to
    # the bound the table of splits is sent to every task and the lines stay where they are;
    # beyond it lines meet their split by a shuffle, in which no split is larger than any other.
    if len(lines.inputFiles()) + lines.rdd.getNumPartitions() <= BROADCAST_SPLITS:
        splits = F.broadcast(splits)
    numbered = lines.join(splits, ["file", "_block", "_part"], "left")
    number = F.when(
        F.col("_first").isNotNull(), F.col("_id") - F.col("_first") + F.col("_before") + 1
    ).otherwise(F.raise_error(F.lit("the file splits changed while lines were numbered")))
    numbered = numbered.withColumn("line_number", number)
    if tail:
        numbered = numbered.filter(F.col("line_number") > F.col("_lines") - tail)
    if not keep_blank:
        numbered = drop_blank(numbered)
    return numbered.select("raw", F.col("file").alias("source"), "line_number", "file")


def drop_blank(df: DataFrame, text: str = "raw") -> DataFrame:
    """S5."""
    return df.filter(F.col(text).rlike(r"\S"))


def merge_sources(frames: Iterable[DataFrame]) -> DataFrame:
    """The lines of several inputs; each keeps its own source."""
    return reduce(DataFrame.unionByName, frames)


def cut_unterminated(text: Column, unterminated: Column) -> Column:
    """A line that has not ended yet is cut at 64 Ki characters; ended lines stay whole."""
    return F.when(
        unterminated, F.substring(text, 1, grammar.MAX_LINE_CHARS)
    ).otherwise(text)
