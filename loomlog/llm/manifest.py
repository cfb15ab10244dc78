"""Merkle dataset manifest: leaf places by bitmap rank, trees by keyed arrays of slots.

A leaf is the digest of a row. Rows of a group stand in order of their id; nothing is sorted for
that. Ids of a group are bits of 64-bit words, merged by OR, and only words with a bit exist. A
directory holds the rows before each word, summed level by level over at most 4096 words at once. A
row's place is the directory's entry plus the number of bits below its own.

Levels are reduced in arrays: 1024 consecutive nodes meet under (group, block), give up to ten
levels and one node for the next stage. Going down again, every block adds its siblings to the
path that it was given, so a proof is made where its leaf is and is never shuffled.

Defined cases: rows without an id come first in their group, the null group is the first group. Rows
of one id stand by digest, equal digests in any order (they are equal). These rows have no bit of
their own: their word is counted by id, digest and input split, however many there are. A null column is
``-``. A group of one leaf is its own subtree; no rows give no rows. Columns beyond those hashed are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.session import shared_folder

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
# words of one directory step, nodes of one block, as powers of two
STEP, BLOCK = 12, 10
# the word of rows without an id: below that of the smallest long
_NO_ID = (-(1 << 63) >> 6) - 1
# which rows the audit changes
TAMPER_EVERY = 7


def _sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(columns: dict[str, Column] | None = None) -> Column:
    """The digest of a row: each column as byte count, colon and value, ``-`` where null."""
    columns = columns or {c: F.col(c) for c in COLUMNS}
    texts = [c.cast("string") for c in columns.values()]
    sizes = [F.octet_length(t).cast("string") for t in texts]
    return _sha(*(F.coalesce(F.concat(n, F.lit(":"), t), F.lit("-")) for n, t in zip(sizes, texts)))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def starts(counts: DataFrame, group: list[str], path: list[str]) -> DataFrame:
    """The rows (``n``) before each key, in the order of ``path`` within the group.

    Every window spans the children of one parent only; the steps are added up by joins.
    """
    found = None
    for k in range(len(path)):
        keys = group + path[: k + 1]
        window = Window.partitionBy(*keys[:-1]).orderBy(path[k])
        before = F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1))
        level = counts.groupBy(*keys).agg(F.sum("n").alias("n")).select(
            *keys, "n", F.coalesce(before, F.lit(0)).alias("start")
        )
        if found is not None:
            above = found.select(*keys[:-1], F.col("start").alias("above"))
            level = level.join(above, keys[:-1]).withColumn("start", F.col("start") + F.col("above"))
        found = level.select(*keys, "n", "start")
    return found


def _directory(rows: DataFrame, folder: str) -> DataFrame:
    """``(group, word, bits, n, start)``: the merged bitmaps and the rows before each word."""
    bit = F.expr("shiftleft(1L, cast(low as int))")
    words = _written(
        rows.groupBy("group", "word").agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n")),
        f"{folder}/words",
    )
    ends = words.agg(F.min("word"), F.max("word")).first()
    steps, shift = ["word"], 0
    if ends[0] is not None:
        # as many levels as the span of the ids needs
        while (ends[1] >> shift) - (ends[0] >> shift) >= 1 << STEP:
            shift += STEP
            words = words.withColumn(f"word{shift}", F.shiftright("word", shift))
            steps.insert(0, f"word{shift}")
    found = starts(words, ["group"], steps).select("group", "word", "start")
    return _written(
        words.select("group", "word", "bits", "n").join(found, ["group", "word"]),
        f"{folder}/directory",
    )


def place(rows: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` (group, id, leaf and any others) with their ``slot``; and ``n`` of each group."""
    rows = _written(
        rows.select(
            "*",
            F.coalesce(F.shiftright("id", 6), F.lit(_NO_ID)).alias("word"),
            F.coalesce(F.col("id").bitwiseAND(63), F.lit(0)).alias("low"),
            F.monotonically_increasing_id().alias("row"),
        ),
        f"{folder}/leaves",
    )
    directory = _directory(rows, folder)
    single = F.col("n") == F.bit_count("bits")
    own = [c for c in rows.columns if c not in ("word", "low", "row")]
    found = rows.join(directory, ["group", "word"])
    rank = F.expr("bit_count(bits & ~shiftleft(-1L, cast(low as int)))")
    placed = found.filter(single).select(*own, (F.col("start") + rank).alias("slot"))
    if not directory.filter(~single).isEmpty():
        # ids that repeat: their words are counted by id, digest and split of the written rows
        again = found.filter(~single).select(
            *own,
            "word",
            "low",
            "row",
            "start",
            F.substring("leaf", 1, 4).alias("head"),
            F.shiftright("row", 33).alias("split"),
        )
        path = ["low", "head", "leaf", "split"]
        counts = again.groupBy("group", "word", *path).agg(F.count("*").alias("n"))
        before = starts(counts, ["group", "word"], path).select(
            "group", "word", *path, F.col("start").alias("inside")
        )
        nth = F.row_number().over(Window.partitionBy("group", "word", *path).orderBy("row")) - 1
        placed = placed.union(
            again.withColumn("nth", nth)
            .join(before, ["group", "word", *path])
            .select(*own, (F.col("start") + F.col("inside") + F.col("nth")).alias("slot"))
        )
    return placed, directory.groupBy("group").agg(F.sum("n").alias("n"))


def _levels(nodes: Column, count: Column) -> Column:
    """All levels of a block, its nodes first: ``count`` times, every two nodes become one."""

    def above(levels: Column, _: Column) -> Column:
        last = F.element_at(levels, -1)
        pairs = F.sequence(F.lit(0), F.floor((F.size(last) - 1) / 2).cast("int"))
        one = lambda i: _sha(F.get(last, 2 * i), F.coalesce(F.get(last, 2 * i + 1), F.lit("")))
        return F.concat(levels, F.array(F.transform(pairs, one)))

    steps = F.slice(F.sequence(F.lit(1), F.lit(BLOCK)), F.lit(1), count)
    return F.aggregate(steps, F.array(nodes), above)


def grow(nodes: DataFrame, sizes: DataFrame, folder: str) -> tuple[list[DataFrame], DataFrame]:
    """Reduce ``(group, slot, node, ...)`` to one node per group.

    Returns the written stages ``(group, block, rows, levels)`` and ``(group, node)``.
    """
    depth = F.when(F.col("n") <= 1, 0).otherwise(F.length(F.bin(F.col("n") - 1)))
    depths = _written(sizes.select("group", depth.alias("depth")), f"{folder}/depths")
    deepest = depths.agg(F.max("depth")).first()[0] or 0
    stages: list[DataFrame] = []
    while True:
        done = BLOCK * len(stages)
        count = F.least(F.lit(BLOCK), F.greatest(F.lit(0), F.col("depth") - done))
        others = [c for c in nodes.columns if c not in ("group", "slot")]
        blocks = (
            nodes.groupBy("group", F.shiftright("slot", BLOCK).alias("block"))
            .agg(F.collect_list(F.struct("slot", *others)).alias("rows"))
            .join(depths, "group")
            .withColumn("rows", F.array_sort("rows"))
            .select("group", "block", "rows", _levels(F.col("rows.node"), count).alias("levels"))
        )
        stages.append(_written(blocks, f"{folder}/stage{len(stages)}"))
        top = F.element_at(F.element_at("levels", -1), 1)
        nodes = stages[-1].select("group", F.col("block").alias("slot"), top.alias("node"))
        if deepest <= BLOCK * len(stages):
            return stages, nodes.select("group", "node")


def _siblings(place: Column) -> Column:
    """What a node of a block is hashed with on each level: one of left and right is empty."""

    def step(level: Column, k: Column) -> Column:
        at = F.call_function("shiftright", place, k)
        odd = at % 2 == 1
        other = F.coalesce(F.get(level, F.when(odd, at - 1).otherwise(at + 1)), F.lit(""))
        return F.struct(
            F.when(odd, other).otherwise("").alias("left"),
            F.when(odd, F.lit("")).otherwise(other).alias("right"),
        )

    return F.transform(F.slice("levels", F.lit(1), F.size("levels") - 1), step)


def descend(stages: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The rows of the first stage with their path upward and the other columns of ``tops``.

    ``tops`` has one row per group with the path from its top upward.
    """
    above = tops.withColumn("block", F.lit(0).cast("long"))
    others = [c for c in tops.columns if c not in ("group", "path")]
    for stage in reversed(stages):
        row = stage.join(above, ["group", "block"]).select(
            "group", *others, "levels", "path", F.posexplode("rows").alias("at", "row")
        )
        above = row.select(
            "group", *others, "row.*", F.concat(_siblings(F.col("at")), "path").alias("path")
        ).withColumnRenamed("slot", "block")
    return above.withColumnRenamed("block", "slot")


def fold(node: Column, path: Column) -> Column:
    """The root that a node and its path lead to."""
    return F.aggregate(path, node, lambda acc, p: _sha(p["left"], acc, p["right"]))


def proof_digest(path: Column) -> Column:
    """One digest of all siblings of a path, from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def _in_order(groups: DataFrame, folder: str) -> DataFrame:
    """Groups with their place in bytewise order, from ranges of groups."""
    ranged = _written(
        groups.repartitionByRange("group").withColumn("range", F.spark_partition_id()),
        f"{folder}/ranged",
    )
    before = starts(
        ranged.groupBy("range").agg(F.count("*").alias("n")), [], ["range"]
    ).select("range", "start")
    nth = F.row_number().over(Window.partitionBy("range").orderBy("group")) - 1
    return ranged.withColumn("nth", nth).join(before, "range").select(
        F.col("group").alias("name"), (F.col("start") + F.col("nth")).alias("slot"), "node"
    )


def manifest(rows: DataFrame) -> DataFrame:
    """``rows`` (group, id, leaf and any others) with slot, subroot, root and path.

    ``group`` is null or a string, ``id`` null or a whole number; ``path`` leads from the
    leaf to the root of all groups.
    """
    folder = shared_folder(rows.sparkSession)
    # null before every name, and names in the order of their bytes
    key = F.coalesce(F.concat(F.lit("+"), F.col("group")), F.lit(""))
    placed, sizes = place(rows.withColumn("group", key), folder)
    stages, subroots = grow(placed.withColumnRenamed("leaf", "node"), sizes, f"{folder}/trees")
    ordered = _written(_in_order(subroots, folder), f"{folder}/subroots").withColumn(
        "group", F.lit("all")
    )
    size = ordered.groupBy("group").agg(F.count("*").alias("n"))
    above, root = grow(ordered, size, f"{folder}/top")
    no_path = F.expr("cast(array() as array<struct<left:string,right:string>>)")
    tops = descend(
        above, root.select("group", F.col("node").alias("root"), no_path.alias("path"))
    ).select(F.col("name").alias("group"), F.col("node").alias("subroot"), "root", "path")
    found = descend(stages, tops).withColumnRenamed("node", "leaf")
    return found.withColumn("group", F.expr("if(group = '', null, substr(group, 2))"))


def audit(docs: DataFrame, every: int = TAMPER_EVERY) -> DataFrame:
    """Manifest of documents, and what becomes of the root when some rows are changed.

    Where ``every`` divides the checksum of the id, a row gets one more character counted.
    """
    columns = {c: F.col(c) for c in COLUMNS}
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    rows = docs.select(
        F.col("lang").alias("group"),
        F.col("doc_id").cast("long").alias("id"),
        leaf(columns).alias("leaf"),
        F.when(hit & F.col("n_chars").isNotNull(), leaf({**columns, "n_chars": more})).alias("changed"),
    )
    folded = manifest(rows).select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
