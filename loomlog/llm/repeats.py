"""Suffix-array dedup: bytes of strings that occur more than once, within and across documents.

A string counts when it has at least ``LENGTH`` bytes. Every such window holds an anchor, the
place of the smallest hash of ``GRAM`` bytes in it, and equal windows have equal anchors.
Anchors with the stretch of windows they stand for are combined in each task, then shuffled by hash. Anchors seen once end
there; equal stretches are settled by their hash; only unequal stretches around one anchor have
their bytes fetched and their windows put in suffix order, where a window is compared with the
next one before or after it for equality over ``LENGTH`` bytes. Lengths of longest previous
factors are not computed. With ``keep_first`` windows with an earlier match are removed; else
all that have a match anywhere, as the query asks.

Anchors and classes of windows come sorted, so a task holds a few of them, or one large one, and
not all that was dealt to it.

Rows are numbered in a written table, as ids may be null or repeated.

Defined cases: a null or empty text, or one below ``LENGTH`` bytes, loses nothing. Repeated
rows match each other, so with ``keep_first`` rows of equal id and text are judged as one.
Matches never cross documents. Texts stay whole: a cut text whose bytes end within a code
point is decoded with replacement signs. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.flat import (
    chain, flat, mix, pieces, prefix, row_of, span_hash, word_spans,
)
from loomlog.session import shared_folder

LENGTH, GRAM = 200, 100
_REACH = LENGTH - GRAM + 1  # places of an anchor in a window
# windows whose bytes are in memory at once: 200 bytes each
SLAB = 50_000
# bytes of text whose hashes are in memory at once, and of sorted rows that a task holds
PIECE, HELD = 1 << 20, 4 << 20
_NONE = ~np.uint64(0)
# windows of a stretch that travel together when bytes are compared
CLASS = 32
# a place packs 31 bits of the first window's start, 7 of the way from there to the anchor and 7
# of the number of windows
_COUNT_BITS, _START_BITS = 7, 31
_START_AT = 2 * _COUNT_BITS
_MARK = "id long, place long"


def pack_place(start, count, back=0) -> np.ndarray:
    return (start << _START_AT) | (back << _COUNT_BITS) | count


def unpack_place(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, count and way to the anchor."""
    low = (1 << _COUNT_BITS) - 1
    start = (place >> _START_AT) & ((1 << _START_BITS) - 1)
    return start, place & low, (place >> _COUNT_BITS) & low


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, offsets: np.ndarray):
    """Anchors of all windows: ``(row, hash, stretch hash, first window, windows, way back)``.

    Windows are numbered by their first byte in ``data``.
    """
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 6
    sums = prefix(data)
    at = np.arange(n - GRAM + 1)
    hashes = span_hash(sums, at, at + GRAM)
    low = np.uint64((1 << max(22, n.bit_length())) - 1)
    # the place in the low bits: of equal hashes the last one counts
    least = sliding_least((hashes & ~low) | (low - at.astype(np.uint64)), _REACH)
    chosen = (low - (least & low)).astype(np.int64)
    rows = np.searchsorted(offsets, np.arange(len(chosen)), "right") - 1
    valid = np.arange(len(chosen)) + LENGTH <= offsets[rows + 1]
    window = np.flatnonzero(valid)
    if not len(window):
        return (np.zeros(0, np.int64),) * 6
    place, rows = chosen[window], rows[window]
    heads = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (rows[1:] != rows[:-1])])
    first, count = window[heads], np.diff(np.r_[heads, len(window)])
    place = place[heads]
    stretch = chain(
        span_hash(sums, first, first + count - 1 + LENGTH), (place - first).astype(np.uint64)
    )
    return rows[heads], hashes[place], stretch, first, count, place - first


# anchors of a task that are combined before the shuffle
FLUSH_ROWS = 600_000
_PARTS = {"deal": "long", "anchor": "long", "stretch": "long", "id": "long", "place": "long",
          "many": "boolean", "settled": "boolean"}


def _ordered(anchor, stretch, ids, place, *more):
    """Rows by anchor, stretch and place in the table, with where anchors and stretches begin."""
    order = np.lexsort((place, ids, stretch, anchor))
    columns = [x[order] for x in (anchor, stretch, ids, place, *more)]
    new_anchor = np.r_[True, columns[0][1:] != columns[0][:-1]]
    new_stretch = new_anchor | np.r_[True, columns[1][1:] != columns[1][:-1]]
    return columns, new_anchor, new_stretch


def _combined(keep_first: bool, rows) -> pa.RecordBatch:
    """Equal stretches of a task settled on the spot: only the first of each has its anchor
    looked at by others, and carries word that there are more. The rest is dealt out evenly."""
    columns, _, new = _ordered(*(np.concatenate(x) for x in zip(*rows)))
    anchor, stretch, ids, place = columns
    many = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
    # rows of equal id and text are one where the first is kept
    same = np.r_[False, (ids[1:] == ids[:-1]) & (place[1:] == place[:-1])] & ~new
    at = np.flatnonzero(~(same & keep_first))
    new, many = new[at], many[at]
    deal = np.where(new, anchor[at], mix((ids[at] ^ place[at]).view(np.uint64)).view(np.int64))
    values = deal, anchor[at], stretch[at], ids[at], place[at], many, ~new
    return pa.record_batch([pa.array(v) for v in values], names=list(_PARTS))


def _anchors(keep_first: bool):
    def run(batches):
        held, size = [], 0
        for batch in batches:
            for piece in pieces(batch, limit=PIECE):
                data, offsets = flat(piece.column("text"))
                row, anchor, stretch, first, count, back = anchors(data, offsets)
                held.append(
                    (
                        anchor.view(np.int64),
                        stretch.view(np.int64),
                        piece.column("id").to_numpy()[row],
                        pack_place(first - offsets[row], count, back),
                    )
                )
                size += len(row)
                if size >= FLUSH_ROWS:
                    yield _combined(keep_first, held)
                    held, size = [], 0
        if size:
            yield _combined(keep_first, held)

    return run


def _groups(batches, key: str):
    """Rows that come sorted by a key as tables of whole groups, with ``HELD`` bytes and more."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < HELD or held[0].column(key)[0] == batch.column(key)[-1]:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        # the last group may go on
        whole = int(np.searchsorted(keys, keys[-1]))
        yield table.slice(0, whole)
        held = table.slice(whole).to_batches()
        size = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)


def _settle(keep_first: bool):
    """Of anchors in their order: what is settled by hash, and what needs its bytes."""

    def settled_and_asked(columns):
        columns, new_anchor, new = _ordered(*columns)
        anchor, stretch, ids, place, many = columns
        if keep_first:  # the same row from two tasks
            same = ~new & np.r_[False, (ids[1:] == ids[:-1]) & (place[1:] == place[:-1])]
            anchor, stretch, ids, place, many, new_anchor, new = (
                x[~same] for x in (anchor, stretch, ids, place, many, new_anchor, new)
            )
        of_stretch, of_anchor = np.cumsum(new) - 1, np.cumsum(new_anchor) - 1
        copies = np.bincount(of_stretch, 1 + many)[of_stretch]
        kinds = np.bincount(of_anchor, new)[of_anchor]
        singles = np.bincount(of_anchor, copies == 1)[of_anchor]
        settled = ~new if keep_first else copies > 1
        asked = new & (kinds > 1) & ((singles > 0) | keep_first)
        at = np.flatnonzero(settled | asked)
        return _marked(ids[at], place[at], settled[at], asked[at])

    def run(batches):
        for table in _groups(batches, "anchor"):
            _, *columns, settled = (c.to_numpy() for c in table.columns)
            if settled.any():
                _, _, ids, place, _ = (c[settled] for c in columns)
                yield _marked(ids, place, True, False)
            if not settled.all():
                yield settled_and_asked([c[~settled] for c in columns])

    return run


def _marked(ids, place, settled, asked) -> pa.RecordBatch:
    settled, asked = (np.broadcast_to(x, len(ids)) for x in (settled, asked))
    return pa.record_batch(
        {
            "id": pa.array(ids),
            "place": pa.array(place),
            "settled": pa.array(settled),
            "asked": pa.array(asked),
        }
    )


def _snippets(batches):
    """The bytes of the stretches asked for, dealt by what equal windows have in common.

    Equal windows have their anchor at the same offset. Windows of one class of offsets share
    all but ``CLASS - 1`` of their bytes, and the hash of those decides where they meet.
    """
    for batch in batches:
        for piece in pieces(batch, limit=PIECE):
            data, offsets = flat(piece.column("text"))
            wanted = piece.column("wanted")
            row = row_of(np.r_[0, np.cumsum(wanted.value_lengths().to_numpy())])
            place = wanted.flatten().to_numpy()
            ids = piece.column("id").to_numpy()[row]
            start, count, back = unpack_place(place)
            anchor = start + back + offsets[row]
            sums, raw = prefix(data), data.tobytes()
            for least in range(0, _REACH, CLASS):
                low = np.maximum(least, back - count + 1)
                high = np.minimum(least + CLASS - 1, back)
                at = np.flatnonzero(low <= high)
                if not len(at):
                    continue
                shared = anchor[at] - least
                deal = span_hash(sums, shared, shared + LENGTH - CLASS + 1) + np.uint64(least)
                begin, windows = anchor[at] - high[at], (high - low + 1)[at]
                yield pa.record_batch(
                    {
                        "deal": pa.array(deal.view(np.int64)),
                        "id": pa.array(ids[at]),
                        "place": pa.array(
                            pack_place(begin - offsets[row[at]], windows)
                        ),
                        "bytes": pa.array(
                            [
                                raw[x : x + n - 1 + LENGTH]
                                for x, n in zip(begin.tolist(), windows.tolist())
                            ],
                            pa.binary(),
                        ),
                    }
                )


def suffix_matches(windows: np.ndarray, position: np.ndarray, keep_first: bool) -> np.ndarray:
    """Which rows of bytes have a match: earlier by position, or any at all.

    Rows are put in suffix order, equal ones by position, so the previous smaller position of a
    row lies next to it if the longest previous factor reaches the full length.
    """
    order = np.lexsort((position, np.ascontiguousarray(windows).view(f"S{LENGTH}").ravel()))
    same = (windows[order[1:]] == windows[order[:-1]]).all(axis=1)
    found = np.zeros(len(windows), bool)
    found[order[1:]] = same
    if not keep_first:
        found[order[:-1]] |= same
    return found


def _shares(data: np.ndarray, first: np.ndarray, count: np.ndarray, parts: int) -> np.ndarray:
    """A number below ``parts`` for each window of rows that follow each other, by its hash."""
    found, low = [], 0
    while low < len(first):
        high = max(low + 1, int(np.searchsorted(first, first[low] + PIECE)))
        start, windows = first[low:high], count[low:high]
        sums = prefix(data[start[0] : start[-1] + windows[-1] - 1 + LENGTH])
        window = np.arange(windows.sum()) + np.repeat(
            start - start[0] - np.cumsum(windows) + windows, windows
        )
        share = span_hash(sums, window, window + LENGTH) % np.uint64(parts)
        found.append(share.astype(np.uint32))
        low = high
    return np.concatenate(found)


def _match(keep_first: bool):
    def slabs(data, deal, first, count):
        """Windows that may be equal, at most about ``SLAB`` of them together."""
        head = np.flatnonzero(np.r_[True, deal[1:] != deal[:-1]])
        total = np.cumsum(np.add.reduceat(count, head))
        ends = np.r_[head[1:], len(deal)]
        k = 0
        while k < len(head):
            done = total[k - 1] if k else 0
            stop = max(k + 1, int(np.searchsorted(total, done + SLAB, "right")))
            own = slice(head[k], ends[stop - 1])
            upto = np.cumsum(count[own])
            parts = -(-int(upto[-1]) // SLAB)
            if parts > 1:  # very many rows with the same bytes in common: equal windows hash alike
                share = _shares(data, first[own], count[own], parts)
            for part in range(parts):
                at = np.flatnonzero(share == part) if parts > 1 else np.arange(upto[-1])
                row = np.searchsorted(upto, at, "right")
                yield head[k] + row, first[own][row] + at - upto[row] + count[own][row]
            k = stop

    def matches(table):
        data, offsets = flat(table.column("bytes"))
        deal, ids, place = (table.column(c).to_numpy() for c in ("deal", "id", "place"))
        start, count, _ = unpack_place(place)
        # documents in order of their id, windows in order of their start
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((place, ids))] = np.arange(len(ids))
        every = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
        for owner, window in slabs(data, deal, offsets[:-1], count):
            if not len(owner):
                continue
            inner = window - offsets[owner]
            position = rank[owner] * 128 + inner
            hit = suffix_matches(every[window], position, keep_first)
            own, at = owner[hit], inner[hit]
            yield _runs(ids[own], pack_place(start[own] + at, 1))

    def run(batches):
        for table in _groups(batches, "deal"):
            yield from matches(table)

    return run


def _runs(ids: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Neighbouring single windows as one mark, as far as its count can go."""
    if not len(ids):
        return pa.record_batch({"id": pa.array(ids), "place": pa.array(place)})
    order = np.lexsort((place, ids))
    ids, place = ids[order], place[order]
    step = 1 << _START_AT
    joined = np.r_[False, (ids[1:] == ids[:-1]) & (place[1:] - place[:-1] == step)]
    head = np.flatnonzero(~joined)
    length = np.diff(np.r_[head, len(ids)])
    most = (1 << _COUNT_BITS) - 1
    parts = -(-length // most)
    at = np.repeat(head, parts)
    inner = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
    count = np.minimum(most, np.repeat(length, parts) - inner * most)
    return pa.record_batch(
        {
            "id": pa.array(ids[at]),
            "place": pa.array(place[at] + inner * most * step + count - 1),
        }
    )


def covered(data: np.ndarray, offsets: np.ndarray, marks) -> np.ndarray:
    """Which bytes lie in a marked window."""
    depth = np.zeros(len(data) + 1, np.int32)
    row = row_of(np.r_[0, np.cumsum(marks.value_lengths().fill_null(0).to_numpy())])
    start, count, _ = unpack_place(marks.flatten().to_numpy())
    start = start + offsets[row]
    np.add.at(depth, start, 1)
    np.add.at(depth, start + count - 1 + LENGTH, -1)
    return np.cumsum(depth[:-1]) > 0


def _cut(texts: bool):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, limit=PIECE):
                data, offsets = flat(piece.column("text"))
                gone = covered(data, offsets, piece.column("marks"))
                _, _, first = word_spans(gone, offsets)
                sums = np.r_[0, np.cumsum(gone)]
                digests, kept = [], []
                for a, b in zip(offsets[:-1], offsets[1:]):
                    part = data[a:b][~gone[a:b]].tobytes()
                    digests.append(hashlib.sha256(part).hexdigest())
                    if texts:
                        kept.append(part.decode("utf-8", "replace"))
                columns = {
                    "n_bytes": pa.array(np.diff(offsets)),
                    "n_removed": pa.array(sums[offsets[1:]] - sums[offsets[:-1]]),
                    "n_spans": pa.array(np.diff(first).astype(np.int64)),
                    "kept_sha256": pa.array(digests),
                }
                if texts:
                    columns["kept_text"] = pa.array(kept, pa.string())
                yield pa.record_batch({"doc_id": piece.column("doc_id"), **columns})

    return run


def _in_order(own: DataFrame, folder: str) -> DataFrame:
    """Rows numbered in order of their ids and digests; rows of equal id and text share a number."""
    spark = own.sparkSession
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    own.select("id", "doc_id", digest).write.parquet(f"{folder}/digests")
    slim = spark.read.parquet(f"{folder}/digests")
    # the ids of a range are above those of the ranges before it
    slim.select("doc_id", "digest").distinct().repartitionByRange(
        "doc_id", "digest"
    ).sortWithinPartitions("doc_id", "digest").withColumn(
        "number", F.monotonically_increasing_id()
    ).write.parquet(f"{folder}/order")
    order = spark.read.parquet(f"{folder}/order").withColumnRenamed("doc_id", "of")
    numbers = slim.join(
        order.withColumnRenamed("digest", "with"),
        F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("with")),
    ).select("id", "number")
    return own.join(numbers, "id").select("doc_id", "text", F.col("number").alias("id"))


def remove_repeats(docs: DataFrame, keep_first: bool = True, texts: bool = True) -> DataFrame:
    """Bytes removed from every document, the digest of the rest and, if wanted, the rest.

    The order of documents is that of their ids, of one id that of the texts' digests. Every row
    is a document of its own.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    docs.select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("id"),
    ).write.option("compression", "zstd").parquet(f"{folder}/rows")
    own = spark.read.parquet(f"{folder}/rows")
    if keep_first:
        own = _in_order(own, folder)
    spread = own.filter(F.octet_length("text") >= LENGTH).select("id", "text")
    parts = ", ".join(f"{name} {kind}" for name, kind in _PARTS.items())
    dealt = spread.mapInArrow(_anchors(keep_first), parts).repartition("deal")
    dealt.sortWithinPartitions("anchor").mapInArrow(
        _settle(keep_first), f"{_MARK}, settled boolean, asked boolean"
    ).write.parquet(f"{folder}/anchors")
    seen = spark.read.parquet(f"{folder}/anchors")

    asked = seen.filter("asked").groupBy("id").agg(F.collect_list("place").alias("wanted"))
    # rows of one number are the same to the match, and settled by hash already
    once = spread.join(asked, "id")
    if keep_first:
        once = once.dropDuplicates(["id"])
    matched = (
        once.select("id", "text", "wanted")
        .mapInArrow(_snippets, f"deal long, {_MARK}, bytes binary")
        .repartition("deal")
        .sortWithinPartitions("deal")
        .mapInArrow(_match(keep_first), _MARK)
    )
    marks = (
        seen.filter("settled")
        .select("id", "place")
        .unionByName(matched)
        .groupBy("id")
        .agg(F.collect_list("place").alias("marks"))
    )
    return (
        own.join(marks, "id", "left")
        .select("doc_id", "text", F.coalesce("marks", F.array().cast("array<long>")).alias("marks"))
        .mapInArrow(
            _cut(texts),
            f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, "
            "n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * texts,
        )
    )
