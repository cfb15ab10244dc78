"""SimHash near-duplicates: fingerprints linked within a few bits through a Gray-order index.

Two fingerprints within four bits agree on at least one of five bands, so distinct fingerprints
are dealt out by band value. Within a bucket they are sorted by Gray rank; groups of neighbours
form nodes that hold the bits their members share, and nodes of nodes up to a root. A query
walks down from the root and leaves out every node whose shared bits differ from it in too many
places, and every node that is already in the query's own component. Each bucket gives a
spanning forest, not its pairs. Components are then joined over buckets by star rewriting.
Buckets over a bound are dealt again by shifted bands, which loses no link; one that stays over
it is cut into blocks, and every two blocks meet in a bucket of their own.

Defined cases: a null text, or one without words, has fingerprint zero, which links like any
other. A text below four words has one shingle. Documents with equal fingerprints are one
component; a null id is never a component's name unless all its ids are null. An empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.flat import LOWER, flat, pieces
from loomlog.session import shared_folder

SHINGLE, SEED = 4, 42
DISTANCE = 4
BANDS = DISTANCE + 1
# fingerprints in one bucket; larger ones are dealt again
BUCKET_ROWS = 200_000
LEVELS = 3
# names of hot components are sent so many ways; rounds that no graph needs
SALTS, MOST_ROUNDS = 16, 100
FAN = 8
# fingerprints of whole buckets that are indexed together
TOGETHER = 1_000_000
# pairs of a query and a code of its bucket that are looked at together, at most
PAIRS = 4_000_000


# -- fingerprints ------------------------------------------------------------------------------


def text_fingerprints(column) -> np.ndarray:
    """Per text: the bits that are set in over half of its shingles' hashes."""
    data, offsets = flat(column)
    raw = LOWER[data].tobytes()
    rows = len(offsets) - 1
    hashes, counts = [], np.zeros(rows, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(rows):
        words = raw[offsets[k] : offsets[k + 1]].split()
        if not words:
            continue
        joined = b" ".join(words)
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.r_[0, stops[:-1] + 1]
        n = max(1, len(words) - SHINGLE + 1)
        ends = stops[SHINGLE - 1 :] if len(words) >= SHINGLE else stops[-1:]
        hashes.append(
            np.fromiter(
                (digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends.tolist())),
                np.uint64,
                n,
            )
        )
        counts[k] = n
    out = np.zeros(rows, np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        every = np.concatenate(hashes)
        at = np.r_[0, np.cumsum(counts[full])[:-1]]
        bits = np.unpackbits(every.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        major = 2 * sums > counts[full, None]
        out[full] = np.packbits(major, axis=1).view(">u8").ravel()
    return out


def _fingerprints(batches):
    for batch in batches:
        for piece in pieces(batch, limit=1 << 20):
            found = text_fingerprints(piece.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*piece.drop_columns(["text"]).columns, pa.array(found.view(np.int64))],
                [n for n in piece.schema.names if n != "text"] + ["fp"],
            )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


# -- the index of a bucket ---------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of each pair; a component's label is its smallest member."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            return
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label[:] = further


class GrayIndex:
    """Nodes over the codes of many buckets, each bucket with its own root."""

    def __init__(self, bucket: np.ndarray, codes: np.ndarray) -> None:
        order = np.lexsort((gray_rank(codes), bucket))
        self.order, self.codes, bucket = order, codes[order], bucket[order]
        self.levels = []  # (first child, last child + 1, shared bits, their values, last code + 1)
        owner = bucket
        first = np.arange(len(codes))
        shared = np.full(len(codes), ~np.uint64(0))
        value, last = self.codes, first + 1
        while True:
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            if len(starts) == len(owner) and self.levels:
                break
            size = np.diff(np.r_[starts, len(owner)])
            within = np.arange(len(owner)) - np.repeat(starts, size)
            heads = np.flatnonzero(within % FAN == 0)
            ends = np.r_[heads[1:], len(owner)]
            ones = np.bitwise_and.reduceat(value | ~shared, heads)
            zeros = np.bitwise_and.reduceat(~value | ~shared, heads)
            same = (ones | zeros) & np.bitwise_and.reduceat(shared, heads)
            self.levels.append((heads, ends, same, ones & same, last[ends - 1]))
            owner, shared, value, last = owner[heads], same, ones & same, last[ends - 1]
        self.root = np.searchsorted(owner, bucket)  # buckets are sorted

    def _own(self, label: np.ndarray) -> list[np.ndarray]:
        """For each node the one component all its codes are in, else -1."""
        out, below = [], label
        for heads, *_ in self.levels:
            low = np.minimum.reduceat(below, heads)
            below = np.where(low == np.maximum.reduceat(below, heads), low, -1)
            out.append(below)
        return out

    def components(self, distance: int = DISTANCE) -> np.ndarray:
        """The label of each code in index order: the first code it is linked with."""
        label = np.arange(len(self.codes))
        own, stale, begin = None, True, 0
        pairs = np.cumsum(np.bincount(self.root)[self.root])
        while begin < len(self.codes):
            done = pairs[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(pairs, done + PAIRS, "right")))
            query = np.arange(begin, stop)
            begin = stop
            node = self.root[query]
            if stale:
                own = self._own(label)
            for depth in range(len(self.levels) - 1, -1, -1):
                heads, ends, shared, value, last = self.levels[depth]
                differ = np.bitwise_count((self.codes[query] ^ value[node]) & shared[node])
                keep = (differ <= distance) & (last[node] > query + 1)
                keep &= own[depth][node] != label[query]
                query, node = query[keep], node[keep]
                size = ends[node] - heads[node]
                query = np.repeat(query, size)
                node = np.repeat(heads[node], size) + (
                    np.arange(len(query)) - np.repeat(np.cumsum(size) - size, size)
                )
            near = (node > query) & (
                np.bitwise_count(self.codes[query] ^ self.codes[node]) <= distance
            )
            stale = bool(near.any())
            merge(label, query[near], node[near])
        return label


def _whole_buckets(batches):
    """The rows of a partition sorted by bucket, cut between buckets."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column("bucket").to_numpy(), batch.column("fp").to_numpy()))
        size += batch.num_rows
        if size >= TOGETHER:
            bucket, codes = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(bucket, bucket[-1]))
            if cut:
                yield bucket[:cut], codes[:cut].view(np.uint64)
            held, size = [(bucket[cut:], codes[cut:])], len(bucket) - cut
    if held:
        bucket, codes = (np.concatenate(x) for x in zip(*held))
        yield bucket, codes.view(np.uint64)


def _forest(batches):
    """Spanning links of all buckets of a partition."""
    for bucket, codes in _whole_buckets(batches):
        index = GrayIndex(bucket, codes)
        label = index.components()
        linked = np.flatnonzero(label != np.arange(len(label)))
        yield pa.record_batch(
            {
                "a": pa.array(index.codes[linked].view(np.int64)),
                "b": pa.array(index.codes[label[linked]].view(np.int64)),
            }
        )


def _band(level: int, band: int) -> F.Column:
    """The value of a band, after the bits were turned by a few places on later levels."""
    edges = [round(64 * k / BANDS) for k in range(BANDS + 1)]
    turn = (0, 6, 3)[level]
    width = edges[band + 1] - edges[band]
    low = (edges[band] + turn) % 64
    turned = F.shiftrightunsigned("fp", low)
    if low:
        turned = turned.bitwiseOR(F.shiftleft("fp", 64 - low))
    return turned.bitwiseAND(F.lit((1 << width) - 1))


def _dealt(rows: DataFrame, level: int) -> DataFrame:
    keys = F.array(*(F.xxhash64("bucket", F.lit(k), _band(level, k)) for k in range(BANDS)))
    return rows.select("fp", F.explode(keys).alias("bucket"))


def _in_blocks(rows: DataFrame, large: DataFrame, bucket_rows: int) -> DataFrame:
    """Large buckets as pairs of blocks of half the bound: any two fingerprints meet in one."""
    blocks = F.ceil(F.col("count") * 2 / bucket_rows)
    own, other = F.col("own"), F.col("other")
    return (
        rows.join(large.select("bucket", blocks.alias("blocks")), "bucket")
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .filter(own != other)
        .select("fp", F.xxhash64("bucket", F.least(own, other), F.greatest(own, other)).alias("bucket"))
    )


def links(nodes: DataFrame, bucket_rows: int = BUCKET_ROWS, levels: int = LEVELS) -> DataFrame:
    """``(a, b)``: links that span the components of distinct fingerprints, bucket by bucket."""
    rows = _dealt(nodes.select("fp", F.lit(0).cast("long").alias("bucket")), 0)
    dealt = None
    for level in range(1, levels + 1):
        large = rows.groupBy("bucket").count().filter(F.col("count") > bucket_rows)
        done = large.isEmpty()
        part = (rows if done else rows.join(large, "bucket", "left_anti")).select("fp", "bucket")
        dealt = part if dealt is None else dealt.unionByName(part)
        if done:
            break
        if level == levels:
            dealt = dealt.unionByName(_in_blocks(rows, large, bucket_rows))
        else:
            rows = _dealt(rows.join(large.select("bucket"), "bucket", "left_semi"), level)
            rows = rows.distinct()
    return (
        dealt.repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_forest, "a long, b long")
    )


# -- components --------------------------------------------------------------------------------


def components(edges: DataFrame, folder: str) -> DataFrame:
    """``(node, root)`` for every node of an edge that is not its component's smallest.

    Large and small stars in turn: every node hands its smallest neighbour to the larger ones,
    then to the smaller ones, until only stars are left. Each round is a written table.
    """
    spark = edges.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    def signature(df: DataFrame):
        return df.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()

    # a is the larger end
    now = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b")
        .distinct(),
        "round0",
    )
    before = signature(now)
    if not before[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for turn in range(1, MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(least, "a")
            .filter("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            small.select("a", F.col("m").alias("b"))
        )
        now = written(small.filter("a <> b").distinct(), f"round{turn}")
        after = signature(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")


def with_roots(nodes: DataFrame, folder: str) -> DataFrame:
    """Distinct fingerprints ``fp`` and the ``root`` of each one's component."""
    roots = components(links(nodes), folder)
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        *nodes.columns, F.coalesce("root", "fp").alias("root")
    )


def grouped(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every document."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    fingerprints(docs).write.parquet(f"{folder}/fingerprints")
    marked = spark.read.parquet(f"{folder}/fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = with_roots(nodes, folder).withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    # a component may hold most fingerprints: its name waits for them under several salts
    named = (
        rooted.groupBy("root")
        .agg(F.min("first").alias("component_id"), F.count("*").alias("size"))
        .filter("size > 1")
        .select("root", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    classes = rooted.join(named.withColumn("salt", F.col("salt").cast("long")), ["root", "salt"], "left").select(
        "fp", F.coalesce("component_id", "first").alias("component_id")
    )
    return marked.join(classes, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
