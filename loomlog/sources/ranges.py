"""Text files by byte range: guarded lines, wide encodings, an index of line numbers.

Files are cut at fixed byte offsets, whatever the cluster. A task reads the lines that begin in
its range, chunk by chunk; it never holds more of a line than the guard allows, and a range in the
middle of a huge line is only scanned. Line ends are looked for on whole code units of the file's
own charset, which its first bytes name where the encoding leaves the byte order open.

Fixed offsets make line counts worth keeping: the index holds, for every range of a file of a
certain size and time, the lines before it. A file that has not changed is never counted again.
"""

from __future__ import annotations

import codecs
import sys
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.fixed import grammar
from loomlog.sinks.versions import Versions

# The reader travels to Python workers by value, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_BYTES, CHUNK_BYTES = 32 << 20, 1 << 20
_LINES = "raw string, file string, block long, at long, cut boolean"
_KEY = ["file", "size", "modified", "block"]

# byte order marks, the longer ones first: bytes, charset
_MARKS = (
    (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"),
    (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"),
    (codecs.BOM_UTF8, "utf-8"),
)


def file_ranges(spark: SparkSession, paths: Sequence[str], width: int = RANGE_BYTES) -> DataFrame:
    """``(file, size, modified, block, stop)``: the ranges of the files, from a listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    listed = files.select(
        F.col("path").alias("file"), F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    ).filter("size > 0")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(width).cast("bigint"))
    return listed.withColumn("block", F.explode(starts)).withColumn(
        "stop", F.least(F.col("block") + width, F.col("size"))
    )


def _opened(uri: str):
    """An input file of any file system that Arrow knows; a bare path is a local one."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem().open_input_file(unquote(parts.path))
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def _charset(head: bytes, encoding: str) -> tuple[str, int]:
    """The charset of a file and the bytes of its mark, as Python reads ``encoding``."""
    name = codecs.lookup(encoding).name
    if name in ("utf-16", "utf-32"):
        for mark, charset in _MARKS:
            if charset.startswith(name) and head.startswith(mark):
                return charset, len(mark)
        return f"{name}-le", 0
    for mark, charset in _MARKS:
        if charset == name.removesuffix("-sig") and head.startswith(mark):
            return charset, len(mark)
    return name.removesuffix("-sig"), 0


def _range_lines(file, size: int, block: int, stop: int, encoding: str, most: int | None):
    """``(bytes, is cut)`` of every line that begins in the range, and the charset first.

    A line ends at a line feed, at a carriage return, or at both together.
    """
    charset, mark = _charset(file.read_at(4, 0), encoding)
    yield charset
    unit = 4 if charset.startswith("utf-32") else 2 if charset.startswith("utf-16") else 1
    kind = np.dtype(f"{'>' if charset.endswith('-be') else '<'}u{unit}")
    limit = None if most is None else 4 * most
    # from the unit before the range: whether the range begins with a line depends on it
    at = max(block - unit, mark if block <= mark else 0)
    begun = block <= mark < stop  # are we in a line that is ours?
    held, over, rest = bytearray(), False, b""

    def hold(piece: bytes) -> None:
        nonlocal over
        room = len(piece) if limit is None else limit - len(held)
        over = over or room < len(piece)
        held.extend(piece[:room] if room > 0 else b"")

    while at < size or rest:
        chunk = rest + file.read_at(min(CHUNK_BYTES, size - at), at)
        base, at = at - len(rest), min(size, at + CHUNK_BYTES)
        whole = len(chunk) if at >= size else len(chunk) // unit * unit
        units = np.frombuffer(chunk[: whole // unit * unit], kind)
        if at < size and len(units) and units[-1] == 13:
            units, whole = units[:-1], whole - unit  # its line feed may follow
        rest = chunk[whole:] if at < size else b""
        ends = np.flatnonzero((units == 10) | (units == 13))
        # of a carriage return and a line feed the second ends the line
        pair = np.zeros(len(ends), bool)
        pair[:-1] = (units[ends[:-1]] == 13) & (units[ends[1:]] == 10) & (np.diff(ends) == 1)
        text = 0
        for k, end in enumerate(ends.tolist()):
            if pair[k]:
                continue
            if begun:
                last = end - 1 if k and pair[k - 1] else end
                hold(chunk[text * unit : max(last, text) * unit])
                yield bytes(held), over
            held.clear()
            over, text = False, end + 1
            start = base + text * unit
            if start >= stop or start >= size:
                return
            begun = start >= block
        if begun:
            hold(chunk[text * unit : whole])
    if begun:
        yield bytes(held), over


def _read(encoding: str, most: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _opened(row["file"]) as file:
                    lines = _range_lines(
                        file, row["size"], row["block"], row["stop"], encoding, most
                    )
                    charset, at, texts, cuts, room = next(lines), 0, [], [], 0

                    def flushed():
                        n = len(texts)
                        return pa.record_batch({
                            "raw": pa.array(texts, pa.string()),
                            "file": pa.array([row["file"]] * n, pa.string()),
                            "block": pa.array([row["block"]] * n, pa.int64()),
                            "at": pa.array(range(at - n, at), pa.int64()),
                            "cut": pa.array(cuts, pa.bool_()),
                        })

                    for line, over in lines:
                        text = line.decode(charset, "replace")
                        cuts.append(over or (most is not None and len(text) > most))
                        texts.append(text if most is None else text[:most])
                        at, room = at + 1, room + len(line)
                        if len(texts) >= 10_000 or room >= 4 * CHUNK_BYTES:
                            yield flushed()
                            texts, cuts, room = [], [], 0
                    if texts:
                        yield flushed()

    return run


def range_lines(
    ranges: DataFrame, encoding: str = "utf-8", most: int | None = grammar.MAX_LINE_CHARS
) -> DataFrame:
    """``(raw, file, block, at, cut)``: the lines of ranges, numbered from 0 in each range."""
    codecs.lookup(encoding)
    cores = ranges.sparkSession.sparkContext.defaultParallelism
    # a range is some megabytes of work: dealt out evenly, as a listing has few partitions
    spread = ranges.select("file", "size", "block", "stop").repartition(4 * cores, "file", "block")
    return spread.mapInArrow(_read(encoding, most), _LINES)


def _counted(ranges: DataFrame, encoding: str) -> DataFrame:
    """``(file, size, modified, block, lines)`` of ranges, from one reading of them."""
    lines = range_lines(ranges, encoding, most=1).groupBy("file", "block").agg(F.count("*").alias("lines"))
    return ranges.select(*_KEY).join(lines, ["file", "block"], "left").select(
        *_KEY, F.coalesce("lines", F.lit(0)).alias("lines")
    )


def line_index(
    spark: SparkSession, ranges: DataFrame, path: str | None, encoding: str = "utf-8"
) -> DataFrame:
    """``(file, block, before, total)`` of the ranges: the lines of the file before each, and in all.

    With a ``path`` the counts are kept there, in the last of its versions: ranges of files that have
    the size and time they had are taken from it, and only others are read. Counts of other files stay;
    those of a file that has changed go.
    """
    if path is None:
        counts = _counted(ranges, encoding)
    else:
        store = Versions(path)
        before = store.whole(spark)
        if before:
            known = store.newest(spark)
            fresh = ranges.join(known, _KEY, "left_anti")
            if not fresh.isEmpty():
                kept = known.join(ranges.select("file").distinct(), "file", "left_anti").unionByName(
                    known.join(ranges.select(*_KEY), _KEY, "left_semi")
                )
                store.write(kept.unionByName(_counted(fresh, encoding)), before[-1] + 1)
        else:
            store.write(_counted(ranges, encoding), 0)
        counts = store.newest(spark).join(ranges.select(*_KEY), _KEY, "left_semi")
    of_file = Window.partitionBy("file")
    ahead = of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        "file", "block",
        F.coalesce(F.sum("lines").over(ahead), F.lit(0)).alias("before"),
        F.sum("lines").over(of_file).alias("total"),
    )


def read_ranges(
    spark: SparkSession,
    paths: Sequence[str],
    encoding: str = "utf-8",
    tail: int | None = None,
    most: int | None = grammar.MAX_LINE_CHARS,
    index: str | None = None,
    numbers: bool = True,
    width: int = RANGE_BYTES,
) -> DataFrame:
    """``(raw, source, line_number, file, cut)`` of text files, blank lines included.

    A line of more than ``most`` characters gives the first of them (``cut``); with None it stays
    whole. ``index`` names a folder for line counts that later reads take up. ``tail`` keeps the
    last lines of each file. ``utf-16`` and ``utf-32`` take the byte order from each file's mark and are
    little-endian without one; a mark is no part of the text. An empty file has no lines.
    """
    if width % 4:
        raise ValueError("a range must hold whole code units")
    ranges = file_ranges(spark, paths, width)
    if not numbers:
        if tail:
            raise ValueError("a tail needs line numbers")
        return range_lines(ranges, encoding, most).select(
            "raw", F.col("file").alias("source"), F.lit(None).cast("bigint").alias("line_number"),
            "file", "cut",
        )
    starts = line_index(spark, ranges, index, encoding)
    if tail:
        # ranges that end before the tail are not read again
        following = F.lead("before").over(Window.partitionBy("file").orderBy("block"))
        ends = F.coalesce(following, F.col("total"))
        starts = starts.withColumn("_ends", ends).filter(F.col("_ends") > F.col("total") - tail).drop("_ends")
        ranges = ranges.join(starts, ["file", "block"], "left_semi")
    found = range_lines(ranges, encoding, most).join(starts, ["file", "block"]).withColumn(
        "line_number", F.col("before") + F.col("at") + 1
    )
    if tail:
        found = found.filter(F.col("line_number") > F.col("total") - tail)
    return found.select("raw", F.col("file").alias("source"), "line_number", "file", "cut")
