"""Rows by their place: last N, last N per source, positions, neighbours.

A source may hold a third of all rows, so nothing here sorts a whole source in one task.
Order numbers are cut into ranges of fixed width; ranges are counted first, and only rows of
one range are ever ranked together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_WIDTH = 65_536
# positions whose texts may be held together
CONTEXT_WIDTH = 1_024
# Up to this many rows a plain ordered limit is cheapest: every task keeps only its best.
ORDERED_LIMIT = 10_000


def _ranged(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_range", F.floor(F.col(order) / width))


def _range_counts(
    ranged: DataFrame, groups: Sequence[str], newest_first: bool, places: Sequence[str] = ()
) -> DataFrame:
    """Rows per range and the rows in the ranges ahead of it, group by group."""
    direction = F.desc if newest_first else F.asc
    ahead = (
        Window.partitionBy(*groups).orderBy(*(direction(c) for c in (*places, "_range")))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.groupBy(*groups, *places, "_range")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_ahead", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)))
    )


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join on equal keys; a missing key, such as a line without a source, equals
    another missing one."""
    renamed = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    joined = left.join(renamed, [left[k].eqNullSafe(renamed[f"_same_{k}"]) for k in keys])
    return joined.drop(*(f"_same_{k}" for k in keys))


def last_rows(
    df: DataFrame,
    n: int,
    order: str = "line_number",
    groups: Sequence[str] = (),
    width: int = RANGE_WIDTH,
    places: Sequence[str] = (),
) -> DataFrame:
    """The ``n`` rows with the highest order number, overall or per group.

    ``order`` must be numeric and unique within a group, or within ``places``, columns that
    are ordered before it, such as the file a line number counts in. Ranges that lie wholly in
    the tail are taken as they are; only the one range the cut falls into is ranked.
    """
    if not groups and n <= ORDERED_LIMIT:
        return df.orderBy(*(F.desc(c) for c in (*places, order))).limit(n)
    ranged = _ranged(df, order, width)
    keys = [*groups, *places, "_range"]
    wanted = _range_counts(ranged, groups, True, places).filter(F.col("_ahead") < n)
    rows = _same(ranged, wanted, keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return (
        rows.withColumn("_rank", F.col("_ahead") + rank)
        .filter(F.col("_rank") <= n)
        .select(*df.columns)
    )


def with_position(
    df: DataFrame,
    order: str = "line_number",
    groups: Sequence[str] = ("source",),
    name: str = "position",
    width: int = RANGE_WIDTH,
) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... by an order number that may have gaps."""
    ranged = _ranged(df, order, width)
    keys = [*groups, "_range"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    ranked = ranged.withColumn("_rank", rank)
    counts = _range_counts(ranged, groups, newest_first=False).drop("_rows")
    return _same(ranked, counts, keys).select(
        *df.columns, (F.col("_ahead") + F.col("_rank") - 1).alias(name)
    )


def with_context(
    df: DataFrame,
    target: Column,
    half: int,
    text: str = "raw",
    order: str = "line_number",
    groups: Sequence[str] = ("source",),
    name: str = "context",
    width: int = CONTEXT_WIDTH,
    position: str | None = None,
) -> DataFrame:
    """The target rows, each with the texts of up to ``half`` rows before and after it.

    Positions are cut into blocks; the ``half`` rows at each end of a block are also sent to the
    neighbouring block, so every window is complete within one. Windows of targets that overlap
    are an island: its texts are gathered once, and each target takes its slice of them. Texts out
    of reach of every target are not gathered. Numbering the positions reads ``df`` twice: give
    the ``position`` column of ``with_position`` where ``df`` is costly, as entries are that
    were not read from a table.
    """
    if position is None:
        placed = with_position(df, order, groups, "_position", width)
    else:
        placed = df.withColumn("_position", F.col(position))
    place = F.floor(F.col("_position") / width)
    within = F.col("_position") % width
    homes = F.array_compact(F.array(
        place,
        F.when((within < half) & (place > 0), place - 1),
        F.when(within >= width - half, place + 1),
    ))
    spread = placed.withColumns({"_target": target, "_home": place}).withColumn(
        "_window", F.explode(homes)
    )
    block = Window.partitionBy(*groups, "_window").orderBy("_position")
    islands = (
        spread.withColumn("_near", F.max("_target").over(block.rangeBetween(-half, half)))
        .filter("_near")
        .withColumn("_at", F.row_number().over(block))
    )
    own = F.col("_target") & (F.col("_home") == F.col("_window"))
    texts = F.transform(
        F.array_sort(F.collect_list(F.struct("_at", F.col(text).alias("text")))), lambda r: r["text"]
    )
    ahead = F.least(F.lit(half).cast("bigint"), F.col("_position")).cast("int")
    first = (F.col("_at") - ahead).alias("first")
    row = F.struct(*df.columns, first, (ahead + half + 1).alias("length"))
    gathered = islands.groupBy(*(F.col(g).alias(f"_by_{g}") for g in groups), "_window").agg(
        texts.alias("_texts"), F.collect_list(F.when(own, row)).alias("_rows")
    )
    return (
        gathered.select(F.explode(F.transform(
            "_rows",
            lambda r: F.struct(
                r.alias("row"), F.slice("_texts", r["first"], r["length"]).alias("context")
            ),
        )).alias("_found"))
        .select("_found.row.*", F.col("_found.context").alias(name))
        .select(*df.columns, name)
    )


def context_or_tail(
    df: DataFrame,
    target: Column,
    half: int,
    text: str = "raw",
    order: str = "line_number",
    groups: Sequence[str] = ("source",),
    name: str = "context",
    position: str | None = None,
) -> DataFrame:
    """W12 with its fallback: a group without any target gives its last row, with the last
    ``2 * half`` texts as its context."""
    found = with_context(df, target, half, text, order, groups, name, position=position)
    silent = df.groupBy(*groups).agg(F.max(F.coalesce(target, F.lit(False))).alias("_any")).filter("not _any")
    same = [df[g].eqNullSafe(silent[g]) for g in groups]
    tails = last_rows(df.join(silent, same, "left_semi"), 2 * half, order, groups)
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.struct(*df.columns).alias("row"))))
    ended = tails.groupBy(*(F.col(g).alias(f"_by_{g}") for g in groups)).agg(rows.alias("_rows")).select(
        F.element_at("_rows", -1)["row"].alias("_row"),
        F.transform("_rows", lambda r: r["row"][text]).alias(name),
    )
    return found.unionByName(ended.select("_row.*", name))
