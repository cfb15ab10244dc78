"""Near duplicates: texts whose sets of five-word shingles are similar are linked.

Texts meet in two ways. Their SimHash fingerprints, those of ``simhash``, are linked within four
bits through its Gray-order index, and the sets of a component meet. At 0.8 fingerprints differ in
about 10 of 64 bits with a deviation of 3, and bands that lose no pair at 18 bits hold three
bits each: for what lies further apart each set has 128 minimum hashes in 32 bands of four, and
two sets meet where a band is equal. Of pairs at similarity 0.8 that fails for five in 10^8, of
more similar ones for fewer. What meets is compared by its exact
shingle sets, which workers map from the shared folder. Within a bucket a set is compared with
those that are not yet in its component, so a bucket gives a spanning forest of true links.
In a bucket over a bound all are compared with one leader first; who is not
like it meets all others of the bucket in blocks. No text is shuffled.

Defined cases: a text below five words has one shingle; texts without words are equal to each
other. Case is ignored, as in SimHash. Every row is a document of its own, whatever its id. An
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.flat import IS_WORD, LOWER, chain, flat, mix, pieces, prefix, span_hash, word_spans
from loomlog.llm.simhash import components, text_fingerprints, with_roots
from loomlog.llm.store import get, put, remove
from loomlog.session import shared_folder

SHINGLE = 5
# similarity as a fraction of whole numbers
SIMILAR = (4, 5)
BANDS, ROWS = 32, 4
# sets in one bucket; larger ones have a leader
BUCKET_ROWS = 2000
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_BAND = mix(np.arange(1 << 16, (1 << 16) + BANDS, dtype=np.uint64))


def shingle_sets(column, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, end to end, and the rows' offsets."""
    data, offsets = flat(column)
    data = LOWER[data]
    start, stop, first = word_spans(IS_WORD[data], offsets)
    words = span_hash(prefix(data), start, stop)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(words)) - first[row]
    value = np.zeros(len(words), np.uint64)
    for k in range(size):
        inside = place + k < count[row]
        at = np.flatnonzero(inside)
        value[at] = chain(value[at], words[at + k])
    # texts below the size have the one shingle that begins at their first word
    whole = (place == 0) | (place + size <= count[row])
    row, value = row[whole], value[whole]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(len(count) + 1))


def _names(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each set, as a long; that of an empty one is its own."""
    sums = np.r_[np.uint64(0), np.cumsum(mix(value), dtype=np.uint64)]
    size = np.diff(offsets).astype(np.uint64)
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + size).view(np.int64)


def _bands(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of band hashes for each set, none of which may be empty."""
    out = np.zeros((len(offsets) - 1, BANDS), np.uint64)
    if len(out):
        for k in range(BANDS * ROWS):
            least = np.minimum.reduceat(value * _FACTORS[k], offsets[:-1])
            band = k // ROWS
            out[:, band] = chain(out[:, band] if k % ROWS else _BAND[band], least)
    return out.view(np.int64)


def _signed(batches):
    """The name of each row's set, its SimHash fingerprint and the bands of sets that are not empty."""
    for batch in batches:
        for piece in pieces(batch):
            value, offsets = shingle_sets(piece.column("text"))
            full = np.diff(offsets) > 0
            bands = _bands(value, offsets[np.r_[full, True]])
            ends = np.r_[0, np.cumsum(np.where(full, BANDS, 0))].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *piece.drop_columns(["text"]).columns,
                    pa.array(_names(value, offsets)),
                    pa.array(text_fingerprints(piece.column("text")).view(np.int64)),
                    pa.ListArray.from_arrays(ends, bands.ravel()),
                ],
                [n for n in piece.schema.names if n != "text"] + ["fp", "mark", "bands"],
            )


# -- lists of rows that workers map -------------------------------------------------------------

# the rows of one table partition have these many bits of their number in common
_PART_BITS = 33


def _write_rows(folder: str):
    """Sorted row numbers by the partition they were numbered in; the input is sorted so."""

    def run(batches):
        held, current, parts = [], None, []

        def close():
            if held:
                put(folder, f"{current}.rows", np.concatenate(held))
                parts.append(current)
                held.clear()

        for batch in batches:
            rows = batch.column("near_row").to_numpy()
            part = rows >> _PART_BITS
            for one in np.unique(part):
                if one != current:
                    close()
                    current = int(one)
                held.append(rows[part == one])
        close()
        yield pa.record_batch({"part": pa.array(parts, pa.int64())})

    return run


def store_rows(rows: DataFrame, folder: str) -> None:
    """Store ``near_row`` numbers for ``listed``: a partition's rows are one array."""
    part = F.shiftright("near_row", _PART_BITS)
    dealt = rows.select("near_row", part.alias("part")).repartition("part")
    dealt.sortWithinPartitions("near_row").mapInArrow(_write_rows(folder), "part long").count()


def listed(folder: str, rows: np.ndarray) -> np.ndarray:
    """Which row numbers are stored; a partition without any has no array."""
    found = np.zeros(len(rows), bool)
    part = rows >> _PART_BITS
    for one in np.unique(part):
        try:
            own = get(folder, f"{one}.rows", np.int64)
        except FileNotFoundError:
            continue
        here = np.flatnonzero(part == one)
        at = np.minimum(np.searchsorted(own, rows[here]), len(own) - 1)
        found[here] = own[at] == rows[here]
    return found


def _write_sets(folder: str, wanted: str):
    """The sets of wanted rows in one array per piece of text, and where in it each set is."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                rows = piece.column("row").to_numpy()
                kept = listed(wanted, rows)
                if not kept.any():
                    continue
                piece = piece.filter(pa.array(kept))
                value, offsets = shingle_sets(piece.column("text"))
                file = int(piece.column("row")[0].as_py())
                put(folder, f"{file}.sets", value)
                yield pa.record_batch({
                    "fp": pa.array(_names(value, offsets)),
                    "file": pa.array(np.full(len(offsets) - 1, file)),
                    "start": pa.array(offsets[:-1].astype(np.int64)),
                    "stop": pa.array(offsets[1:].astype(np.int64)),
                })

    return run


def linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of similar sets that span the components of all such pairs."""
    size = np.array([len(s) for s in sets])
    ends = np.r_[0, np.cumsum(size)]
    known, word = np.unique(np.concatenate(sets), return_inverse=True)
    word = word.astype(np.uint32)
    top, low = SIMILAR
    mark = np.zeros(len(known), bool)
    left = np.argsort(size, kind="stable")
    pairs = []
    while len(left):
        waiting, left = [left[0]], left[1:]
        while waiting and len(left):
            one = waiting.pop()
            # only sets of a size that can be similar
            low_at = np.searchsorted(size[left] * low, top * size[one])
            high_at = np.searchsorted(size[left] * top, low * size[one], "right")
            near = left[low_at:high_at]
            if not len(near):
                continue
            own = word[ends[one] : ends[one + 1]]
            mark[own] = True
            length = size[near]
            begin = np.cumsum(length) - length
            at = np.arange(length.sum()) + np.repeat(ends[near] - begin, length)
            common = np.add.reduceat(mark[word[at]], begin, dtype=np.int64)
            mark[own] = False
            like = common * low >= top * (length + size[one] - common)
            found = near[like]
            pairs += [(int(one), int(other)) for other in found]
            waiting += found.tolist()
            left = np.r_[left[:low_at], near[~like], left[high_at:]]
    return pairs


def _confirmed(folder: str):
    """True links of all buckets of a partition, whose rows are sorted by bucket."""

    def judged(rows: np.ndarray):
        rows = np.unique(rows, axis=0)
        sets = [get(folder, f"{f}.sets", np.uint64)[a:b] for _, f, a, b in rows.tolist()]
        return rows[:, 0], linked(sets) if len(rows) > 1 else []

    def run(batches):
        held, current = [], None
        a, b = [], []

        def close():
            if held:
                names, found = judged(np.concatenate(held))
                a.extend(names[x] for x, _ in found)
                b.extend(names[y] for _, y in found)
                held.clear()

        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            place = np.stack([batch.column(c).to_numpy() for c in _PLACE], axis=1)
            if not len(bucket):
                continue
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            for x, y in zip(edges, [*edges[1:], len(bucket)]):
                if bucket[x] != current:
                    close()
                    current = bucket[x]
                held.append(place[x:y])
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
            a, b = [], []
        close()
        yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _like_leader(folder: str):
    """For each row, whether its set is similar to that of its bucket's leader."""

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in (*_PLACE, *_LEADER)]
            like = []
            for _, f, a, b, _, lf, la, lb in zip(*columns):
                one, other = (
                    get(folder, f"{file}.sets", np.uint64)[x:y] for file, x, y in ((f, a, b), (lf, la, lb))
                )
                common = len(np.intersect1d(one, other, assume_unique=True))
                top, low = SIMILAR
                like.append(common * low >= top * (len(one) + len(other) - common))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(like, pa.bool_())], [*batch.schema.names, "like"]
            )

    return run


_PLACE = ("fp", "file", "start", "stop")
_LEADER = tuple(f"leader_{c}" for c in _PLACE)


def _by_leaders(crowds: DataFrame, folder: str, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """Links of large buckets to leaders, and the rows left over.

    The smallest name of a bucket leads. Who is similar to it is linked and, but for the leader,
    leaves the bucket: similar to one another or not, the component holds them. But who leaves might
    have been the only link of another to it, so those linked stay as long as anybody is left
    who was not: they meet the rest in blocks. A bucket of copies ends after one round.
    """
    spark = crowds.sparkSession
    first = crowds.groupBy("bucket").agg(F.min(F.struct(*_PLACE)).alias("leader"))
    leaders = first.select("bucket", *(F.col(f"leader.{c}").alias(n) for c, n in zip(_PLACE, _LEADER)))
    kinds = "bucket long, " + ", ".join(f"{c} long" for c in (*_PLACE, *_LEADER)) + ", like boolean"
    # a large bucket is dealt out evenly: its rows need only the leader
    paired = crowds.join(leaders, "bucket").select("bucket", *_PLACE, *_LEADER)
    paired.repartition(F.xxhash64("bucket", "fp")).mapInArrow(_like_leader(f"{folder}/sets"), kinds).write.parquet(
        f"{folder}/led"
    )
    led = spark.read.parquet(f"{folder}/led")
    links = led.filter(F.col("like") & (F.col("fp") != F.col("leader_fp"))).select(
        F.col("fp").alias("a"), F.col("leader_fp").alias("b")
    )
    strange = led.filter(~F.col("like")).groupBy("bucket").agg(F.count("*").alias("strange"))
    rest = led.select("bucket", *_PLACE, "like").join(strange, "bucket")
    return links, rest


def _by_marks(signed: DataFrame, folder: str) -> DataFrame:
    """Sets by the component of their SimHash fingerprint, as buckets. Those with a fingerprint of
    their own that is linked with none stay out."""
    spark = signed.sparkSession
    nodes = signed.groupBy(F.col("mark").alias("fp")).agg(F.count("*").alias("sets"))
    with_roots(nodes, f"{folder}/simhash").write.parquet(f"{folder}/marks")
    marks = spark.read.parquet(f"{folder}/marks").withColumnRenamed("fp", "mark")
    shared = marks.groupBy("root").agg(F.sum("sets").alias("held")).filter("held > 1")
    met = marks.join(shared, "root", "left_semi").select("mark", F.xxhash64("root", F.lit("mark")).alias("bucket"))
    return signed.select("fp", "mark").join(met, "mark").select("fp", "bucket")


def links(
    signed: DataFrame, texts: DataFrame, folder: str, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """``(a, b)``: links of similar sets that span their components.

    ``signed`` has one row per set: name, a row that has it, its SimHash fingerprint and its
    bands. Texts are not shuffled: workers map the list of rows whose sets are wanted.
    """
    spark = signed.sparkSession
    dealt = signed.select("fp", F.explode("bands").alias("bucket")).unionByName(_by_marks(signed, folder))
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    sizes.write.parquet(f"{folder}/sizes")
    sizes = spark.read.parquet(f"{folder}/sizes")
    dealt.join(sizes, "bucket").write.parquet(f"{folder}/meeting")
    meeting = spark.read.parquet(f"{folder}/meeting")
    wanted = signed.join(meeting.select("fp").distinct(), "fp", "left_semi")
    store_rows(wanted.select(F.col("row").alias("near_row")), f"{folder}/wanted")
    texts.mapInArrow(
        _write_sets(f"{folder}/sets", f"{folder}/wanted"), "fp long, file long, start long, stop long"
    ).write.parquet(f"{folder}/places")
    placed = meeting.join(spark.read.parquet(f"{folder}/places"), "fp")
    small = placed.filter(F.col("size") <= bucket_rows).select("bucket", *_PLACE)
    found = None
    if not sizes.filter(F.col("size") > bucket_rows).isEmpty():
        crowds = placed.filter(F.col("size") > bucket_rows).select("bucket", *_PLACE)
        found, rest = _by_leaders(crowds, folder, bucket_rows)
        small = small.unionByName(_in_groups(rest, bucket_rows))
    confirmed = (
        small.repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_confirmed(f"{folder}/sets"), "a long, b long")
    )
    return confirmed if found is None else confirmed.unionByName(found)


def _in_groups(rest: DataFrame, bucket_rows: int) -> DataFrame:
    """What its leader does not hold, against everybody of its bucket.

    The strange ones are dealt into blocks of a third of the bound; every row of the bucket
    visits each block of strange ones in the company of a third of a bound of its like.
    """
    third = max(1, bucket_rows // 3)
    blocks = F.ceil(F.col("strange") / third)
    crowd = F.ceil(F.col("size") / third)
    sized = rest.join(
        rest.groupBy("bucket").agg(F.count("*").alias("size")), "bucket"
    ).withColumns({"blocks": blocks, "crowd": crowd})
    every = lambda n: F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    home = F.pmod(F.xxhash64("fp"), F.col("crowd"))
    # as one of the crowd: its own part, in every block
    among = sized.withColumn("part", home).withColumn("block", F.explode(every(F.col("blocks"))))
    # as a strange one: its own block, in every part
    strange = (
        sized.filter(~F.col("like"))
        .withColumn("block", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")))
        .withColumn("part", F.explode(every(F.col("crowd"))))
    )
    both = among.unionByName(strange, allowMissingColumns=False)
    return both.select(F.xxhash64("bucket", "block", "part").alias("bucket"), *_PLACE)


def _without(folder: str):
    def run(batches):
        for batch in batches:
            gone = listed(folder, batch.column("near_row").to_numpy())
            if not gone.all():
                yield batch.filter(pa.array(~gone))

    return run


def first_rows(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of ``docs`` that come first in their component, by id and place in the table.

    A row with an id comes before those without. The rows are numbered in a written table, which
    with the list of rows that go is all that stays in the shared folder.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    numbered = docs.withColumn("near_row", F.monotonically_increasing_id())
    numbered.write.parquet(f"{folder}/rows")
    numbered = spark.read.parquet(f"{folder}/rows")
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = numbered.select(F.col("near_row").alias("row"), F.col("doc_id").alias("id"), "text")
    texts.mapInArrow(
        _signed, f"row long, id {kind}, fp long, mark long, bands array<long>"
    ).write.parquet(f"{folder}/work/signed")
    signed = spark.read.parquet(f"{folder}/work/signed")
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "row")
    # rows of one set are one before anything is dealt or joined
    signed.groupBy("fp").agg(
        F.min(place).alias("first"), F.min("row").alias("row"), F.min("mark").alias("mark"),
        F.any_value("bands").alias("bands"),
    ).write.parquet(f"{folder}/work/distinct")
    distinct = spark.read.parquet(f"{folder}/work/distinct")
    found = links(distinct, texts.drop("id"), f"{folder}/work", bucket_rows)
    roots = components(found, f"{folder}/work")
    # the first row of each component, by the name of its root
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        F.coalesce("root", "fp").alias("root"), "first"
    )
    kept = rooted.groupBy("root").agg(F.min("first").alias("first"))
    gone = signed.select("row").join(kept.select(F.col("first.row").alias("row")), "row", "left_anti")
    store_rows(gone.select(F.col("row").alias("near_row")), f"{folder}/gone")
    remove(spark, f"{folder}/work")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema)
    return numbered.mapInArrow(_without(f"{folder}/gone"), kinds).select(*docs.columns)
