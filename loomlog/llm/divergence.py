"""Source divergence audit: how far the term shares of sources lie apart, on a cube of cells.

Terms are counted per (language, source); a language keeps the terms that stand in enough of its
documents. A share is a whole number of billionths, smoothed, so all arithmetic is exact. The
distance of two sources is the sum of absolute differences over all kept terms.

The cube: the sources of a language are cut into blocks, its terms into blocks by hash. A slice
holds the shares of one block of sources for one block of terms; it is sent to every cell (source
block, source block, term block) it is part of. A cell is a task of its own and gives partial
distances of its pairs; these are summed along the term axis. What a cell holds is bounded by two
blocks of sources times one of terms, however large the corpus is.

Defined cases: a null text, language or source counts as empty. A group without terms, or a
language that keeps none, has its rows all the same (distance 0 where no term is kept). Repeated
rows count each time. Ties of value go by item. An empty table gives no rows. Columns beyond text,
lang and source are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.llm.flat import LOWER, flat, pieces, row_of, word_spans
from loomlog.session import shared_folder

LEAST_DOCUMENTS = 30
SCALE, SMOOTHING = 1_000_000_000, 5
TOP_TERMS = 50
SOURCE_BLOCK, TERM_BLOCK = 16, 1024
# counted rows a task gathers before it sends them on
HELD_ROWS = 1_000_000

# letters: ASCII letters and everything beyond ASCII
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[0x41:0x5B] = _IS_LETTER[0x61:0x7B] = _IS_LETTER[0x80:] = True

_COUNTED = "lang string, source string, term string, n long, docs long"


def _terms(column) -> tuple[pa.StringArray, np.ndarray]:
    """The distinct terms of a batch, and for each row and term its code and count."""
    data, offsets = flat(column)
    inside = _IS_LETTER[data]
    start, stop, first = word_spans(inside, offsets)
    ends = np.r_[0, np.cumsum(stop - start)].astype(np.int32)
    terms = pa.StringArray.from_buffers(
        len(start), pa.py_buffer(ends), pa.py_buffer(LOWER[data[inside]])
    ).dictionary_encode()
    codes = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return terms.dictionary, row_of(first) * max(1, len(terms.dictionary)) + codes


def _summed(parts: list[pa.Table]) -> pa.Table:
    keys = ["lang", "source", "term"]
    both = pa.concat_tables(parts).group_by(keys).aggregate([("n", "sum"), ("docs", "sum")])
    return both.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select([*keys, "n", "docs"])


def _count(batches):
    """Counts per (language, source, term), combined in the task before the shuffle."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        for piece in pieces(batch):
            lang, source = (
                piece.column(c).dictionary_encode() for c in ("lang", "source")
            )
            codes = [c.indices.to_numpy(zero_copy_only=False) for c in (lang, source)]
            words, keys = _terms(piece.column("text"))
            keys, n = np.unique(keys, return_counts=True)
            row, code = np.divmod(keys, max(1, len(words)))
            wide = len(source.dictionary)
            group = codes[0].astype(np.int64) * wide + codes[1]
            cells, at = np.unique(group[row] * max(1, len(words)) + code, return_inverse=True)
            group, code = np.divmod(cells, max(1, len(words)))
            found = pa.table(
                {
                    "lang": lang.dictionary.take(pa.array(group // wide)),
                    "source": source.dictionary.take(pa.array(group % wide)),
                    "term": words.take(pa.array(code)),
                    "n": np.bincount(at, n, len(cells)).astype(np.int64),
                    "docs": np.bincount(at, minlength=len(cells)).astype(np.int64),
                }
            )
            held.append(found)
            rows += len(found)
            if rows > HELD_ROWS:
                held = [_summed(held)]
                rows = len(held[0])
                if 2 * rows > HELD_ROWS:
                    yield from held[0].combine_chunks().to_batches(max_chunksize=50_000)
                    held, rows = [], 0
    if rows:
        yield from _summed(held).combine_chunks().to_batches(max_chunksize=50_000)


def term_counts(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``(lang, source, term, n, lang_n, leads)`` of every kept term that a group has.

    ``lang_n`` is the term's count in the language; ``leads`` is 1 in one row of each term.
    One shuffle by (language, term) serves both sums: a term has at most one row per source.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    term = Window.partitionBy("lang", "term")
    return (
        docs.select("text", *named)
        .mapInArrow(_count, _COUNTED)
        .repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .select(
            "lang",
            "source",
            "term",
            "n",
            F.sum("docs").over(term).alias("lang_docs"),
            F.sum("n").over(term).alias("lang_n"),
            (F.row_number().over(term.orderBy("source")) == 1).cast("int").alias("leads"),
        )
        .filter(F.col("lang_docs") >= least)
        .drop("lang_docs")
    )


def share(n: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a count, in whole billionths, without rounding on the way."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function(
        "div", F.lit(SCALE).cast("decimal(10,0)") * wide(n + SMOOTHING), wide(total + SMOOTHING * terms)
    )


def _cell(key, table):
    """Partial distances of the pairs of one cell; its two slices may be one and the same."""
    block_of = table["block"].to_pylist()
    shares, names = {}, {}
    for k, block in enumerate(block_of):
        base = np.array(table["base"][k].as_py(), np.int64)
        whole = np.repeat(base[:, None], table["terms"][k].as_py(), axis=1)
        cells = table["cells"][k].values
        at, slot, p = (cells.field(c).to_numpy(zero_copy_only=False) for c in ("at", "slot", "p"))
        whole[at, slot] = p
        shares[block], names[block] = whole, table["names"][k].as_py()
    left, right = min(block_of), max(block_of)
    sources, items, parts = [], [], []
    for i, source in enumerate(names[left]):
        apart = np.abs(shares[right] - shares[left][i]).sum(axis=1)
        first = i + 1 if left == right else 0
        sources += [source] * (len(apart) - first)
        items += names[right][first:]
        parts.append(apart[first:])
    parts = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    lang = pa.array([key[0].as_py()] * len(items), pa.string())
    columns = [lang, pa.array(sources, pa.string()), pa.array(items, pa.string()), pa.array(parts)]
    return pa.Table.from_arrays(columns, ["lang", "source", "item", "part"])


def audit(
    docs: DataFrame,
    least: int = LEAST_DOCUMENTS,
    source_block: int = SOURCE_BLOCK,
    term_block: int = TERM_BLOCK,
    top: int = TOP_TERMS,
) -> tuple[DataFrame, DataFrame]:
    """Distances of all pairs of a language's sources, and the terms that each source overuses.

    The first is ``(lang, source, item, value)`` with each pair both ways. The second is
    ``(lang, source, item, value, rank)``: terms whose share in the source is above the
    language's, by the difference.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    term_counts(docs, least).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    langs = counts.groupBy("lang").agg(
        F.sum("n").alias("lang_total"), F.sum("leads").alias("terms")
    )
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # one row per source: every pair of a language's sources is a row of the result anyhow
    (
        docs.select(*named)
        .distinct()
        .join(own, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .na.fill(0, ["total", "lang_total", "terms"])
        .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
        .withColumn("block", F.floor(F.col("place") / source_block).cast("int"))
        .withColumn("at", (F.col("place") % source_block).cast("int"))
        .write.parquet(f"{folder}/groups")
    )
    groups = spark.read.parquet(f"{folder}/groups")
    p = share(F.col("n"), F.col("total"), F.col("terms"))
    shares = counts.join(groups, ["lang", "source"]).withColumn("p", p)

    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    overused = (
        shares.select("lang", "source", F.col("term").alias("item"), (F.col("p") - q).alias("value"))
        .filter("value > 0")
        .withColumn("rank", F.row_number().over(by_value))
        .filter(F.col("rank") <= top)
    )

    # slices: the shares of a block of sources for a block of terms, terms numbered in their block
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") / term_block))
    term = Window.partitionBy("lang", "term_block").orderBy("term")
    whole_block = Window.partitionBy("lang", "term_block")
    cells = F.collect_list(F.struct("at", "slot", "p"))
    filled = (
        shares.withColumn("term_block", F.pmod(F.xxhash64("term"), blocks))
        .select("lang", "term_block", "term", "block", "at", "p")
        .withColumn("slot", F.dense_rank().over(term) - 1)
        .withColumn("block_terms", F.max("slot").over(whole_block) + 1)
        .groupBy("lang", "term_block", "block")
        .agg(F.max("block_terms").alias("block_terms"), cells.alias("cells"))
    )
    # a block of sources without any of the terms still has its smoothed shares
    sizes = (
        shares.filter("leads = 1")
        .groupBy("lang", F.pmod(F.xxhash64("term"), blocks).alias("term_block"))
        .agg(F.count("*").alias("terms"))
    )
    zero = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(0)
    faces = (
        groups.withColumn("base", zero)
        .groupBy("lang", "block")
        .agg(F.array_sort(F.collect_list(F.struct("at", "source", "base"))).alias("g"))
        .select(
            "lang",
            "block",
            F.col("g.source").alias("names"),
            F.col("g.base").alias("base"),
            (F.max("block").over(Window.partitionBy("lang")) + 1).alias("blocks"),
        )
    )
    empty = F.expr("cast(array() as array<struct<at:int,slot:int,p:bigint>>)")
    slices = (
        faces.join(sizes, "lang")
        .join(filled, ["lang", "block", "term_block"], "left")
        .select(
            "lang",
            "block",
            "term_block",
            "terms",
            "names",
            "base",
            F.coalesce("cells", empty).alias("cells"),
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
        )
    )
    partial = (
        slices.withColumn("left", F.least("block", "other"))
        .withColumn("right", F.greatest("block", "other"))
        .groupBy("lang", "left", "right", "term_block")
        .applyInArrow(_cell, "lang string, source string, item string, part long")
    )
    sums = partial.groupBy("lang", "source", "item").agg(F.sum("part").alias("value"))
    # languages that keep no term have pairs all the same, at distance 0
    bare = groups.filter("terms = 0").select("lang", "source")
    silent = bare.join(bare.withColumnRenamed("source", "item"), "lang").filter("source < item")
    once = sums.unionByName(silent.withColumn("value", F.lit(0).cast("long")))
    pairs = once.select(
        "lang",
        F.explode(
            F.array(
                F.struct("source", "item", "value"),
                F.struct(F.col("item").alias("source"), F.col("source").alias("item"), "value"),
            )
        ).alias("pair"),
    ).select("lang", "pair.*")
    return pairs, overused


def divergence(docs: DataFrame) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of both parts."""
    pairs, overused = audit(docs)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(by_value))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (
        ranked.withColumn("part", F.lit("pair"))
        .select(columns)
        .union(overused.withColumn("part", F.lit("term")).select(columns))
    )
