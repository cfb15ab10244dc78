"""LM scoring: an interpolated modified Kneser-Ney model of word n-grams of any order.

Counting is a Spark job of one pass over the training texts for the n-grams of all lengths, and
one for each shorter length, longest first. Such a pass reads the counts of the grams that are
longer by one back, memory-mapped, and sums up for each gram its distinct left neighbours and, as
a context, its followers and how many of them count once, twice or more often: a gram that
occurs c times adds 1/c at each occurrence. Counts are combined in every task before the
shuffle, and what was shuffled for a table is let go when the table is written. The tables are sorted
arrays of hashes, cut by the leading bits of the hash into files of bounded size in the shared
folder; a task merges one file at a time. The files of a large model are then joined, in order, into
``2 ** GROUP_BITS`` with a directory of small buckets of keys, so a look-up costs the same whatever
the size of the corpus. Scoring maps the files and looks up each batch's sorted keys. Words have 64-bit keys, longer grams the 40 bits that follow those of their file: of the
million keys of a file some thirty share theirs with another. A gram that occurs once has no row of
fields, as they follow from that.

A text begins with one start mark, so its first token has one word of context at most. A gram
that begins with it has no left neighbours; its occurrences stand for them.

Defined cases: a null or empty text has one token, its end. A null id counts as the empty text
for the split. Repeated rows count each time. Without training texts every score is 0.
Columns beyond the id and the text are not read.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.flat import (
    IS_WORD, LOWER, chain, distinct_keys, flat, pieces, prefix, sorted_keys, span_hash, word_spans,
)
from loomlog.llm.store import delete, exists, get, put, put_joined, read
from loomlog.session import shared_folder

END, START = np.uint64(1), np.uint64(2)
FLUSH_TOKENS = 3_000_000
# text bytes for each file of the model: about a million tokens
FILE_BYTES = 8 << 20
# the files of a model of more than 2 ** GROUP_BITS of them are joined by so many leading bits
GROUP_BITS = 6
# text bytes for each bucket of a joined file: fewer than two hundred tokens
BUCKET_BYTES = 1 << 10
SMOOTHING = 0.1
ORDER = 3
# of a gram: distinct left neighbours, its followers' counts, followers that count once, twice, more; uses
_FIELDS = 6
_BLOBS = "file int, keys binary, counts binary"


def tokens(column):
    """Hashes of the tokens, of the token before each, and the first token of each row."""
    data, offsets = flat(column)
    data = LOWER[data]
    start, stop, first = word_spans(IS_WORD[data], offsets)
    rows = len(first) - 1
    bounds = first + np.arange(rows + 1)
    right = np.full(len(start) + rows, END)
    right[np.arange(len(start)) + np.repeat(np.arange(rows), np.diff(first))] = span_hash(
        prefix(data), start, stop
    )
    left = np.empty_like(right)
    left[1:] = right[:-1]
    left[bounds[:-1]] = START
    return left, right, bounds


def grams(left: np.ndarray, right: np.ndarray, bounds: np.ndarray, order: int):
    """For each length from 2: where grams of it end, the grams, and their contexts.

    A gram never reaches beyond the start of its text.
    """
    place = np.arange(len(right)) - np.repeat(bounds[:-1], np.diff(bounds))
    at, context = np.arange(len(right)), left
    for size in range(2, order + 1):
        gram = chain(context, right[at])
        yield size, at, gram, context
        # the gram that ends at the token before is the next context
        whole = np.zeros(len(right), np.uint64)
        whole[at] = gram
        at = np.flatnonzero(place >= size - 1)
        context = whole[at - 1]


def file_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _blobs(keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted keys with their counts, one row for each file they belong to."""
    files, at = np.unique(file_of(keys, bits), return_index=True)
    ends = [*at[1:], len(keys)]
    return pa.record_batch(
        {
            "file": pa.array(files, pa.int32()),
            "keys": pa.array([keys[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()),
            "counts": pa.array([counts[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()),
        }
    )


def _split(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The 40 bits that follow the file's, as 32 and 8: five bytes a key on disk."""
    own = (keys << np.uint64(bits)) >> np.uint64(24)
    return (own >> np.uint64(8)).astype(np.uint32), own.astype(np.uint8)


def _joined(high: np.ndarray, low: np.ndarray, file: int, bits: int) -> np.ndarray:
    """Keys whose leading bits are those of before; the rest is zero."""
    own = (high.astype(np.uint64) << np.uint64(8)) | low
    own = (own << np.uint64(24)) >> np.uint64(bits)
    return own | (np.uint64(file) << np.uint64(64 - bits)) if bits else own


def _small_blobs(keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """As ``_blobs`` with short keys; most counts are one and take a byte, the others four more."""
    files, at = np.unique(file_of(keys, bits), return_index=True)
    high, low = _split(keys, bits)
    ends = [*at[1:], len(keys)]
    short = np.minimum(counts, 255).astype(np.uint8)
    bytes_ = lambda x, a, b: x[a:b].tobytes()
    long = [counts[a:b][counts[a:b] >= 255].astype(np.uint32).tobytes() for a, b in zip(at, ends)]
    spans = list(zip(at, ends))
    return pa.record_batch(
        {
            "file": pa.array(files, pa.int32()),
            "keys": pa.array([bytes_(high, *x) + bytes_(low, *x) for x in spans], pa.binary()),
            "counts": pa.array([bytes_(short, *x) + y for x, y in zip(spans, long)], pa.binary()),
        }
    )


def _unpacked(file: int, keys: bytes, counts: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(keys) // 5
    key = _joined(np.frombuffer(keys, np.uint32, n), np.frombuffer(keys, np.uint8, n, 4 * n), file, bits)
    count = np.frombuffer(counts, np.uint8, n).astype(np.int64)
    count[count == 255] = np.frombuffer(counts[n:], np.uint32)
    return key, count


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their rows of counts."""
    if not len(keys):
        return keys, counts
    order, keys = sorted_keys(keys)
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.add.reduceat(counts[order], at, axis=0)


def _count_grams(size: int, bits: int):
    """Occurrences of the grams of one length."""

    def run(batches):
        held, rows = [], 0

        def flush():
            every = np.concatenate(held)
            held.clear()
            return _small_blobs(*np.unique(every, return_counts=True), bits)

        for batch in batches:
            for piece in pieces(batch):
                *_, (_, _, gram, _) = grams(*tokens(piece.column("text")), size)
                held.append(gram)
                rows += len(gram)
                if rows >= FLUSH_TOKENS:
                    yield flush()
                    rows = 0
        if rows:
            yield flush()

    return run


def _count_neighbours(size: int, order: int, folder: str, bits: int, deep: int | None):
    """The fields of the grams of one length, from those longer by one."""

    def fields(piece):
        left, right, bounds = tokens(piece.column("text"))
        levels = {k: found for k, *found in grams(left, right, bounds, size + 1)}
        at, longer, _ = levels[size + 1]
        times = look_up_small(longer, folder, f"raw{size + 1}", bits, deep=deep)
        share = 1.0 / times
        counts = times
        if size + 1 < order:
            counts = gram_neighbours(longer, times, folder, size + 1, bits, deep)
        own_at, own = (np.arange(len(right)), right) if size == 1 else levels[size][:2]
        known, code = distinct_keys(np.append(own, START) if size == 1 else own)
        own_code = code[: len(own)]
        ended = np.full(len(right), -1)
        ended[own_at] = own_code
        # a context is the gram that ends one token earlier, or the start mark
        led = ended[at - 1]
        if size == 1:
            led[bounds[:-1]] = code[-1]
        table = np.empty((len(known), _FIELDS), np.float64 if size == 1 else np.float32)
        # the gram that a longer one ends with; those that begin a text have none
        table[:, 0] = np.bincount(ended[at], share, len(known))
        if size > 1:
            first = np.ones(len(right), bool)
            first[at] = False
            table[:, 0] += np.bincount(own_code, first[own_at], len(known))
        table[:, 1] = np.bincount(led, share * counts, len(known))
        kinds = np.bincount(4 * led + np.minimum(counts, 3), share, 4 * len(known))
        table[:, 2:5] = kinds.reshape(-1, 4)[:, 1:]
        table[:, 5] = np.bincount(own_code, minlength=len(known))
        if size > 1:
            again = look_up_small(known, folder, f"raw{size}", bits, deep=deep) > 1
            known, table = known[again], table[again]
        return known, table

    def run(batches):
        keys, sums, rows = [], [], 0

        def flush():
            # what was held of the pieces goes before the sums are made
            parts = np.concatenate(keys), np.concatenate(sums)
            keys.clear()
            sums.clear()
            return _blobs(*_summed(*parts), bits)

        for batch in batches:
            for piece in pieces(batch):
                known, table = fields(piece)
                keys.append(known)
                sums.append(table)
                rows += len(known)
                del known, table
                if rows >= FLUSH_TOKENS // 4:
                    yield flush()
                    rows = 0
        if rows:
            yield flush()

    return run


def _tallied(file: int, tally: np.ndarray, uses: np.ndarray) -> list[int]:
    """A file's keys, uses, and counts of counts."""
    return [file, int((uses > 0).sum()), int(uses.sum()), int(tally.sum())] + [
        int((tally == k).sum()) for k in (1, 2, 3, 4)
    ] + [int((tally > 2).sum())]


def _write_files(folder: str, name: str, bits: int, dtype=None):
    """Merge the parts of each file, which follow each other, write its arrays and report
    counts of counts. Without a ``dtype`` the parts are counted grams with short keys."""

    def run(batches):
        held, current, rows = [], None, []

        def close():
            if not held:
                return
            keys, counts = (np.concatenate(x) for x in zip(*held))
            held.clear()
            keys, counts = _summed(keys, counts)
            if dtype is None:
                high, low = _split(keys, bits)
                put(folder, f"{name}-{current}.high", high)
                put(folder, f"{name}-{current}.low", low)
                put(folder, f"{name}-{current}.short", np.minimum(counts, 255).astype(np.uint8))
                at = np.flatnonzero(counts >= 255)
                put(folder, f"{name}-{current}.long", np.stack([at, counts[at]]))
                rows.append(_tallied(current, counts, counts))
                return
            counts = np.rint(counts).astype(np.int64 if dtype is np.float64 else np.int32)
            put(folder, f"{name}-{current}.keys", keys)
            put(folder, f"{name}-{current}.counts", counts)
            rows.append(_tallied(current, counts[:, 0], counts[:, -1]))

        for batch in batches:
            for file, keys, counts in zip(*batch.columns):
                if file.as_py() != current:
                    close()
                    current = file.as_py()
                if dtype is None:
                    held.append(_unpacked(current, keys.as_py(), counts.as_py(), bits))
                else:
                    table = np.frombuffer(counts.as_py(), dtype).reshape(-1, _FIELDS)
                    held.append((np.frombuffer(keys.as_py(), np.uint64), table.astype(np.float64)))
        close()
        names = ["file", "types", "uses", "tally", "n1", "n2", "n3", "n4", "n3up"]
        kinds = [pa.int32()] + [pa.int64()] * 8
        yield pa.record_batch(
            [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 9, kinds)], names
        )

    return run


_FILE_ROWS = "file int, types long, uses long, tally long, n1 long, n2 long, n3 long, n4 long, n3up long"


_SMALL = {"high": np.uint32, "low": np.uint8, "short": np.uint8}


def _part(name: str) -> str:
    """The name of a table while its files are not joined."""
    return f"part-{name}"


def _join_group(folder: str, name: str, group: int, files: list[int], bits: int, deep: int, kinds):
    """Join the files of a group, one array at a time, and write where each bucket begins.

    The directory is written last: where it is there, the files may be gone already.
    """
    def parts(suffix, dtype):
        return (read(folder, f"{_part(name)}-{file}.{suffix}", dtype) for file in files)

    fine = deep - bits
    sizes = np.zeros((1 << (bits - GROUP_BITS), 1 << fine), np.int64)

    def leading(suffix, dtype):
        for file, part in zip(files, parts(suffix, dtype)):
            # the bits that follow those of the file
            own = part << np.uint64(bits) if dtype is np.uint64 else part
            bucket = own >> dtype(8 * own.itemsize - fine)
            sizes[file % len(sizes)] = np.bincount(bucket.astype(np.int64), minlength=1 << fine)
            yield part

    if not exists(folder, f"{name}-{group}.first"):
        for k, (suffix, dtype) in enumerate(kinds.items()):
            put_joined(folder, f"{name}-{group}.{suffix}", (parts if k else leading)(suffix, dtype))
        first = np.r_[0, np.cumsum(sizes)]
        if "high" in kinds:
            begins = first[:: 1 << fine]
            long = [x.reshape(2, -1) for x in parts("long", np.int64)]
            long = [x + [[begins[file % len(sizes)]], [0]] for file, x in zip(files, long)]
            put(folder, f"{name}-{group}.long", np.concatenate(long, axis=1))
        put(folder, f"{name}-{group}.first", first)
    for file in files:
        for suffix in (*kinds, "long"):
            delete(folder, f"{_part(name)}-{file}.{suffix}")


def _join_files(spark, folder: str, name: str, files: frozenset, bits: int, deep: int, kinds) -> frozenset:
    """Join the files of a table by their leading bits; the groups that have any."""
    by_group = {}
    for file in sorted(files):
        by_group.setdefault(file >> (bits - GROUP_BITS), []).append(file)

    def run(batches):
        for batch in batches:
            for group in batch.column(0).to_pylist():
                if group in by_group:
                    _join_group(folder, name, group, by_group[group], bits, deep, kinds)
            yield batch

    groups = spark.range(0, 1 << GROUP_BITS, numPartitions=1 << GROUP_BITS)
    groups.mapInArrow(run, "id long").collect()
    return frozenset(by_group)


def _by_file(ordered: np.ndarray, bits: int, files=None):
    """The files that hold sorted keys, each with the span of its keys."""
    file = file_of(ordered, bits)
    at = np.flatnonzero(np.diff(file, prepend=-1))
    for one, a, b in zip(file[at].tolist(), at, [*at[1:], len(ordered)]):
        if files is None or one in files:
            yield one, a, b


def _placed(stored: np.ndarray, wanted: np.ndarray, keys, folder: str, name: str, deep: int | None):
    """Where keys belong among those stored, and where those stored for them end.

    Of joined files a bucket is searched: all keys take a step at a time, so their reads of
    memory that is far apart overlap. ``deep`` is the leading bits of the keys of a bucket.
    """
    if deep is None:
        return np.searchsorted(stored, wanted), len(stored)
    first = get(folder, f"{name}.first", np.int64)
    bucket = (keys << np.uint64(GROUP_BITS)) >> np.uint64(64 - deep + GROUP_BITS)
    bucket = bucket.astype(np.int64)
    place, stop = first[bucket], first[bucket + 1]
    step = 1 << int((stop - place).max()).bit_length() >> 1
    while step:
        probe = place + (step - 1)
        less = stored[np.minimum(probe, len(stored) - 1)] < wanted
        less &= probe < stop
        place += step * less
        step >>= 1
    return place, stop


def look_up(
    keys, folder: str, name: str, bits: int, dtype, fields: int, files=None, only: int | None = None,
    deep: int | None = None,
) -> np.ndarray:
    """The counts of each key, or one of them ``only``; zeros for those that are not there.

    With ``deep`` the files are joined ones, and ``files`` their groups.
    """
    found = np.zeros((len(keys), fields) if only is None else len(keys), dtype)
    order, ordered = sorted_keys(keys)
    for file, a, b in _by_file(ordered, bits if deep is None else GROUP_BITS, files):
        stored = get(folder, f"{name}-{file}.keys", np.uint64)
        counts = get(folder, f"{name}-{file}.counts", dtype).reshape(-1, fields)
        wanted = ordered[a:b]
        place, _ = _placed(stored, wanted, wanted, folder, f"{name}-{file}", deep)
        place = np.minimum(place, len(stored) - 1)
        hit = stored[place] == wanted
        found[order[a:b][hit]] = counts[place[hit]] if only is None else counts[place[hit], only]
    return found


def look_up_small(
    keys: np.ndarray, folder: str, name: str, bits: int, files=None, deep: int | None = None
) -> np.ndarray:
    """Occurrences of grams with short keys, zero for those that are not there."""
    found = np.zeros(len(keys), np.int64)
    order, ordered = sorted_keys(keys)
    high, low = _split(ordered, bits)
    for file, a, b in _by_file(ordered, bits if deep is None else GROUP_BITS, files):
        own, rest = get(folder, f"{name}-{file}.high", np.uint32), get(folder, f"{name}-{file}.low", np.uint8)
        place, stop = _placed(own, high[a:b], ordered[a:b], folder, f"{name}-{file}", deep)
        stop = np.broadcast_to(stop, len(place))
        near = np.minimum(place, len(own) - 1)
        hit = (own[near] == high[a:b]) & (place < stop)
        open_ = np.flatnonzero(hit)
        hit[open_] = same = rest[near[open_]] == low[a:b][open_]
        # of the few keys with equal first bits one may have the last ones too
        open_ = open_[~same]
        while len(open_):
            place[open_] += 1
            open_ = open_[place[open_] < stop[open_]]
            open_ = open_[own[place[open_]] == high[a:b][open_]]
            same = rest[place[open_]] == low[a:b][open_]
            hit[open_[same]] = True
            open_ = open_[~same]
        there = np.flatnonzero(hit)
        at = place[there]
        counts = get(folder, f"{name}-{file}.short", np.uint8)[at].astype(np.int64)
        many = np.flatnonzero(counts == 255)
        if len(many):
            where, more = get(folder, f"{name}-{file}.long", np.int64).reshape(2, -1)
            counts[many] = more[np.searchsorted(where, at[many])]
        found[order[a:b][there]] = counts
    return found


def gram_neighbours(
    keys: np.ndarray, times: np.ndarray, folder: str, size: int, bits: int, deep: int | None = None
):
    """The left neighbours of grams of two words and more; one that occurs once has one."""
    found = np.minimum(times, 1)
    again = np.flatnonzero(times > 1)
    found[again] = look_up(
        keys[again], folder, f"grams{size}", bits, np.int32, _FIELDS, only=0, deep=deep
    )
    return found


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float, float]:
    """Discounts of counts 0, 1, 2 and more, from the counts of counts.

    Where one of those is missing, as in tiny corpora, a fixed discount of 0.5, 1 and 1.5.
    """
    if not (n1 and n2 and n3 and n4):
        return 0.0, 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return 0.0, *(min(max(d, 0.0), float(k)) for k, d in enumerate(raw, 1))


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the few numbers that hold for the whole corpus."""

    folder: str
    bits: int
    deep: int | None  # leading bits of the buckets of joined files
    order: int
    files: dict  # table -> the files it has, or the groups of joined ones
    tokens: int  # N
    types: int  # V
    pair_types: int
    discounts: dict  # length -> discounts of counts 0, 1, 2 and more
    word_rest: float  # the probability that discounting leaves for unseen words

    def words(self, keys: np.ndarray) -> np.ndarray:
        """The fields of words."""
        return look_up(
            keys, self.folder, "grams1", self.bits, np.int64, _FIELDS, self.files["grams1"],
            deep=self.deep,
        )

    def times(self, size: int, keys: np.ndarray) -> np.ndarray:
        name = f"raw{size}"
        return look_up_small(keys, self.folder, name, self.bits, self.files[name], self.deep)

    def after(self, size: int, fields: np.ndarray):
        """Of contexts of one length: the sum of their followers' counts, and the probability
        that discounting leaves for others."""
        cut = self.discounts[size + 1]
        left = fields[:, 2] * cut[1] + fields[:, 3] * cut[2] + fields[:, 4] * cut[3]
        return fields[:, 1], left / np.maximum(fields[:, 1], 1)

    def led(self, size: int, keys: np.ndarray):
        """The counts of grams of two words and more, below the order, and what ``after`` gives.

        One that occurs once has one neighbour on either side, and a single follower.
        """
        times = self.times(size, keys)
        counts = np.minimum(times, 1)
        total, rest = counts.copy(), counts * self.discounts[size + 1][1]
        name, again = f"grams{size}", np.flatnonzero(times > 1)
        fields = look_up(
            keys[again], self.folder, name, self.bits, np.int32, _FIELDS, self.files[name],
            deep=self.deep,
        )
        counts[again] = fields[:, 0]
        total[again], rest[again] = self.after(size, fields)
        return counts, total, rest

    def word_probability(self, neighbours: np.ndarray) -> np.ndarray:
        """P(word) from its number of distinct left neighbours; the unknown word has none."""
        even = self.word_rest / (self.types + 1)
        if not self.pair_types:
            return np.full(len(neighbours), even)
        kept = neighbours - np.array(self.discounts[1])[np.minimum(neighbours, 3)]
        return np.maximum(kept, 0) / self.pair_types + even

    def probabilities(self, left: np.ndarray, right: np.ndarray, bounds: np.ndarray):
        """P(token | the tokens before it) and how often each token was seen in training."""
        words, code = distinct_keys(right)
        ended = self.words(words)  # the fields of the gram that ends at each token
        seen = ended[:, 5][code]
        likely = self.word_probability(ended[:, 0])[code]
        # a context is the gram that ended one token earlier; only what begins a text is looked up
        opening, at = np.unique(left[bounds[:-1]], return_inverse=True)
        totals, rests = np.zeros(len(right) + 1, np.int64), np.zeros(len(right) + 1)
        for held, own, begun in zip(
            (totals, rests), self.after(1, ended), self.after(1, self.words(opening))
        ):
            held[1:] = own[code]
            held[bounds[:-1]] = begun[at]
        for size, at, gram, _ in grams(left, right, bounds, self.order):
            d, total, rest = np.array(self.discounts[size]), totals[at], rests[at]
            if size < self.order:
                counts, totals[at + 1], rests[at + 1] = self.led(size, gram)
            else:
                counts = self.times(size, gram)
            direct = np.maximum(counts - d[np.minimum(counts, 3)], 0) / np.maximum(total, 1)
            likely[at] = np.where(total > 0, direct + rest * likely[at], likely[at])
        return likely, seen


def _totals(report: DataFrame) -> tuple[list[int], frozenset]:
    rows = report.collect()  # one row of nine numbers for each file
    return [sum(r[k] for r in rows) for k in range(1, 9)], frozenset(
        r["file"] for r in rows
    )


@contextmanager
def shuffles_let_go(spark):
    """Spark removes the shuffle files of a query when it ends, as its table has been written."""
    flag = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(flag, None)
    spark.conf.set(flag, "true")
    try:
        yield
    finally:
        spark.conf.unset(flag) if before is None else spark.conf.set(flag, before)


def fit(
    training: DataFrame, text: str = "text", order: int = ORDER, file_bytes: int = FILE_BYTES
) -> Model:
    """Count the training texts and write the model's arrays to the shared folder."""
    if order < 2:
        raise ValueError("a model has an order of two or more")
    spark = training.sparkSession
    texts = training.select(F.col(text).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(24, max(0, int(size / file_bytes).bit_length()))
    fine = max(1, int(file_bytes / BUCKET_BYTES).bit_length() - 1)
    deep = bits + fine if bits > GROUP_BITS else None
    folder = f"{shared_folder(spark)}/ngrams"
    files, discounted = {}, {}

    def counted(job, name, dtype=None):
        parts = texts.mapInArrow(job, _BLOBS).repartition("file").sortWithinPartitions("file")
        own = name if deep is None else _part(name)
        sums, files[name] = _totals(
            parts.mapInArrow(_write_files(folder, own, bits, dtype), _FILE_ROWS)
        )
        if deep is not None:
            kinds = _SMALL if dtype is None else {"keys": np.uint64, "counts": np.uint8}
            files[name] = _join_files(spark, folder, name, files[name], bits, deep, kinds)
        return sums

    once = {}
    with shuffles_let_go(spark):
        for length in range(2, order + 1):
            top = counted(_count_grams(length, bits), f"raw{length}")
            once[length] = top[3]
        discounted[order] = discounts(*top[3:7])
        for length in range(order - 1, 0, -1):
            job = _count_neighbours(length, order, folder, bits, deep)
            sums = counted(job, f"grams{length}", np.float64 if length == 1 else np.float32)
            # grams that occur once are not in the table; each of them counts one
            discounted[length] = discounts(sums[3] + once.get(length, 0), *sums[4:7])
    types, uses, tally, n1, n2, n3, n4, n3up = sums
    kept = discounted[1]
    rest = (kept[1] * n1 + kept[2] * n2 + kept[3] * n3up) / tally if tally else 1.0
    return Model(folder, bits, deep, order, files, uses, types, tally, discounted, rest)


def _score(model: Model):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                left, right, bounds = tokens(piece.column("text"))
                likely, seen = model.probabilities(left, right, bounds)
                base = np.log10(
                    (seen + SMOOTHING) / (model.tokens + SMOOTHING * (model.types + 1))
                )
                at = bounds[:-1]
                n = len(at)
                likely = np.add.reduceat(np.log10(likely), at)
                yield pa.record_batch(
                    {
                        "doc_id": piece.column("doc_id"),
                        "held_out": piece.column("held_out"),
                        "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                        "n_known": pa.array(np.add.reduceat((seen > 0).astype(np.int64), at)),
                        "train_tokens": pa.array(np.full(n, model.tokens, np.int64)),
                        "base_score": pa.array(np.add.reduceat(base, at)),
                        "score": pa.array(likely),
                        "perplexity": pa.array(10.0 ** (-likely / np.diff(bounds))),
                    }
                )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Log10 probability and perplexity of every text of ``(doc_id, held_out, text)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(
        _score(model),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double, perplexity double",
    )


def scored_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Learn from nine tenths of the documents by a checksum of their id, score all of them."""
    place = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10
    split = docs.select("doc_id", "text", (place == 0).alias("held_out"))
    return score(split, fit(split.filter(~F.col("held_out")), order=order))
