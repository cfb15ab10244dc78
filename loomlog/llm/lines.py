"""Line dedup: recurring line templates found by a fixed-depth tree.

A line goes down the tree by its number of words and its first words, with words that hold a
digit as wildcards. In a leaf, a word that more than a third of the lines have at its place is part
of the template and any other word a variable field; a line that has less than half of its words
beyond the first ones in common with that stays as it is. Shares do not depend on how much is read.

A template recurs when it stands in three different surroundings (the lines before and after it),
for lines of fifty words and more in two, and in at least a quarter as many as documents. Both are
counted over documents of different text, so copies of a document change nothing; lines of near
copies have the same surroundings and are left to near-duplicate removal. Lines of recurring
templates are dropped from all documents but the first.

Leaves, shared words and lines to drop are sorted hash arrays in the shared folder that workers
map, as in the language model. Texts are read three times and never shuffled; the words of a form
are shuffled once, their keys are counted once, and what was shuffled for a table is let go when the
table is written.

Defined cases: a null or empty text has no lines and stays as it is. Blank lines are never
dropped. A document all of whose lines would be dropped is left alone. Of repeated rows with the
smallest id each counts as the first; a null id is never the first. Without recurring lines
nothing changes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.flat import (
    IS_WORD, chain, flat, mix, pieces, prefix, row_of, span_hash, word_spans,
)
from loomlog.llm.kneser_ney import look_up, shuffles_let_go
from loomlog.llm.store import put, remove
from loomlog.session import shared_folder

DEPTH = 3
# surroundings that short and long lines must have, and what is long
LEAST_PLACES, LONG_PLACES, LONG_WORDS = 3, 2, 50
# one in so many lines of a leaf must have a word, and more, for it to be part of a template
SHARED = 3
# of the documents with a template, at least one in so many has surroundings of its own
OWN_PLACES = 4
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_WILD = np.uint64(0x2A2A2A2A2A2A2A2A)
_STEP = np.uint64(0x9E3779B97F4A7C15)
KEYS_PER_FILE = 1 << 20
SLICE_WORDS = 1 << 18


class Lines:
    """The lines of a batch that have a word: places, leaves, forms and surroundings."""

    def __init__(self, column) -> None:
        self.data, self.offsets = flat(column)
        data = self.data
        sums = prefix(data)
        word_start, word_stop, _ = word_spans(IS_WORD[data], self.offsets)
        words = span_hash(sums, word_start, word_stop)
        digits = np.r_[0, np.cumsum(_DIGIT[data])]
        words = np.where(digits[word_stop] > digits[word_start], _WILD, words)
        start, stop, first = word_spans(data != 10, self.offsets)
        begin, end = np.searchsorted(word_start, start), np.searchsorted(word_start, stop)
        full = begin < end
        self.row = row_of(first)[full]
        self.start, self.stop = start[full], stop[full]
        self.begin, self.size = begin[full], (end - begin)[full]
        self.words = words
        # the form: all words with their places; sums wrap around
        inner = np.arange(len(words)) - np.repeat(self.begin, self.size)
        self.inner = inner.astype(np.uint64)
        placed = np.r_[np.uint64(0), np.cumsum(mix(words + self.inner * _STEP), dtype=np.uint64)]
        self.form = mix(placed[self.begin + self.size] - placed[self.begin] + self.size.astype(np.uint64))
        self.leaf = mix(self.size.astype(np.uint64) * _STEP)
        for k in range(DEPTH):
            has = self.size > k
            word = words[np.where(has, self.begin + k, 0)] if len(words) else words
            self.leaf = np.where(has, chain(self.leaf, word), self.leaf)
        before = np.zeros(len(self.form), np.uint64)
        after = before.copy()
        same = self.row[1:] == self.row[:-1]
        before[1:][same] = self.form[:-1][same]
        after[:-1][same] = self.form[1:][same]
        self.around = chain(before, after)
        # the text as a whole: copies have the same
        self.content = span_hash(sums, self.offsets[:-1], self.offsets[1:])[self.row]


def _first_by(*keys: np.ndarray) -> np.ndarray:
    """Indexes of the first row, by the first key, for each combination of the others."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys[1:]:
        ordered = key[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    return order[new]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _leaves(batches):
    """One row for each leaf of a document."""
    for batch in batches:
        for piece in pieces(batch):
            found = Lines(piece.column("text"))
            at = _first_by(found.start, found.leaf, found.row)
            yield pa.record_batch(
                {
                    "leaf": _signed(found.leaf[at]),
                    "around": _signed(found.around[at]),
                    "content": _signed(found.content[at]),
                }
            )


def _forms(folder: str, bits: int, files: frozenset):
    """Lines in leaves of several surroundings: one row for each form of a document."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                found = Lines(piece.column("text"))
                if not len(found.row):
                    continue
                live = look_up(found.leaf, folder, "leaves", bits, np.int64, 2, files)[:, 1] > 0
                at = np.flatnonzero(live)
                at = at[_first_by(found.start[at], found.form[at], found.row[at])]
                words = [
                    found.words[b : b + n].view(np.int64)
                    for b, n in zip(found.begin[at], found.size[at])
                ]
                ids = piece.column("doc_id").take(pa.array(found.row[at]))
                yield pa.record_batch(
                    {
                        "leaf": _signed(found.leaf[at]),
                        "form": _signed(found.form[at]),
                        "around": _signed(found.around[at]),
                        "content": _signed(found.content[at]),
                        "doc_id": ids,
                        "words": pa.array(words, pa.list_(pa.int64())),
                    }
                )

    return run


def _write_keys(folder: str, name: str, bits: int):
    """Sorted keys, each with its number and a one that shows it is there, by file."""

    def run(batches):
        held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        files = []
        if held:
            file, key, value = (np.concatenate(x) for x in zip(*held))
            key = key.view(np.uint64)
            for one in np.unique(file):
                own = np.flatnonzero(file == one)
                own = own[np.argsort(key[own])]
                put(folder, f"{name}-{one}.keys", key[own])
                put(folder, f"{name}-{one}.counts", np.stack([value[own], own * 0 + 1], axis=1))
                files.append(one)
        yield pa.record_batch({"file": pa.array(files, pa.int32())})

    return run


def _stored(rows: DataFrame, folder: str, name: str) -> tuple[int, frozenset]:
    """Store ``(key, value)`` rows of distinct keys; the bits of the files and which there are."""
    with shuffles_let_go(rows.sparkSession):
        bits = min(24, int(rows.count() / KEYS_PER_FILE).bit_length())
        file = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)
        dealt = rows.select(file.alias("file"), "key", "value").repartition("file")
        written = dealt.mapInArrow(_write_keys(folder, name, bits), "file int").collect()
    return bits, frozenset(r["file"] for r in written)


def recurring() -> F.Column:
    """The rule on distinct surroundings and documents of distinct text."""
    least = F.when(F.col("n_words") >= LONG_WORDS, LONG_PLACES).otherwise(LEAST_PLACES)
    return (F.col("places") >= least) & (OWN_PLACES * F.col("places") >= F.col("docs"))


def _places(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """Distinct surroundings and documents of each key, from rows that are distinct by text.

    The smallest of each of ``more`` is kept.
    """
    least = [F.min(c).alias(c) for c in more]
    return (
        rows.groupBy(key, "around")
        .agg(F.count("*").alias("docs"), *least)
        .groupBy(key)
        .agg(F.count("*").alias("places"), F.sum("docs").alias("docs"), *least)
    )


def _written(df: DataFrame, path: str) -> DataFrame:
    with shuffles_let_go(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _slices(batch: pa.RecordBatch):
    """Slices of lines with about ``SLICE_WORDS`` words each, whole lines always.

    Yields the slice, the line of each word, and the key of each word in its leaf and place.
    """
    sizes = pc.list_value_length(batch.column("words")).to_numpy().astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_WORDS, "right")))
        piece, size = batch.slice(start, stop - start), sizes[start:stop]
        line = np.repeat(np.arange(stop - start), size)
        place = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
        word = piece.column("words").flatten().to_numpy().view(np.uint64)
        leaf = piece.column("leaf").to_numpy().view(np.uint64)
        yield piece, line, place, chain(chain(leaf[line], place.astype(np.uint64)), word)
        start = stop


def _leaf_sizes(piece: pa.RecordBatch, stored: tuple) -> np.ndarray:
    folder, bits, files = stored
    return look_up(
        piece.column("leaf").to_numpy().view(np.uint64), folder, "sizes", bits, np.int64, 2, files
    )[:, 0]


def _word_counts(sizes: tuple):
    """The lines that have a word at its place, summed up by slice, with the size of the leaf.

    In a leaf of less than ``SHARED`` lines each word is shared, so none is counted.
    """

    def run(batches):
        for batch in batches:
            for piece, line, _, key in _slices(batch):
                leaf_n = _leaf_sizes(piece, sizes)[line]
                at = np.flatnonzero(leaf_n >= SHARED)
                keys, first, code = np.unique(key[at], return_index=True, return_inverse=True)
                n = piece.column("n").to_numpy()[line[at]]
                yield pa.record_batch(
                    {
                        "key": _signed(keys),
                        "n": pa.array(np.bincount(code, n, len(keys)).astype(np.int64)),
                        "leaf_n": pa.array(leaf_n[at[first]]),
                    }
                )

    return run


def _shaped(sizes: tuple, shared: tuple):
    """A form's template: its shared words with their places, if they are half of its later ones."""

    def run(batches):
        folder, bits, files = shared
        for batch in batches:
            for piece, line, place, key in _slices(batch):
                fixed = _leaf_sizes(piece, sizes)[line] < SHARED
                open_ = np.flatnonzero(~fixed)
                held = look_up(key[open_], folder, "shared", bits, np.int64, 2, files)
                fixed[open_] = held[:, 1] > 0
                rows = piece.num_rows
                n_words = np.bincount(line, minlength=rows)
                n_fixed = np.bincount(line[fixed & (place >= DEPTH)], minlength=rows)
                # every line has a word; sums wrap around
                begin = np.cumsum(n_words) - n_words
                mark = np.add.reduceat(np.where(fixed, key, np.uint64(0)), begin)
                leaf = piece.column("leaf").to_numpy().view(np.uint64)
                form = piece.column("form").to_numpy().view(np.uint64)
                half = 2 * n_fixed >= n_words - DEPTH
                yield pa.record_batch(
                    {
                        "form": _signed(form),
                        "n_words": pa.array(n_words),
                        "template": _signed(np.where(half, chain(leaf, mark), form)),
                    }
                )

    return run


def templates(docs: DataFrame, folder: str) -> tuple[int, frozenset]:
    """Store the forms of all recurring templates with the first document of each."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    leaves = texts.mapInArrow(_leaves, "leaf long, around long, content long").distinct()
    # no template recurs in a leaf that has one surrounding only
    live = _places(leaves, "leaf").filter(F.col("places") >= LONG_PLACES).select(
        F.col("leaf").alias("key"), F.lit(1).cast("long").alias("value")
    )
    bits, files = _stored(_written(live, f"{folder}/leaves.parquet"), folder, "leaves")

    lines = _written(
        texts.mapInArrow(
            _forms(folder, bits, files),
            "leaf long, form long, around long, content long, doc_id long, words array<long>",
        ),
        f"{folder}/forms.parquet",
    )
    # a form once for each text that has it, however often that was copied
    forms = _written(
        lines.groupBy("leaf", "form", "content", "around").agg(F.min("doc_id").alias("first")),
        f"{folder}/distinct.parquet",
    )
    counts = forms.groupBy("form").agg(F.count("*").alias("n"))
    variants = _written(
        lines.groupBy("leaf", "form").agg(F.any_value("words").alias("words")).join(counts, "form"),
        f"{folder}/variants.parquet",
    )
    remove(spark, f"{folder}/forms.parquet")
    leaf_sizes = forms.groupBy(F.col("leaf").alias("key")).agg(F.count("*").alias("value"))
    leaf_sizes = _written(leaf_sizes, f"{folder}/sizes.parquet")
    sizes = (folder, *_stored(leaf_sizes, folder, "sizes"))
    # a word is counted by one key for leaf, place and word, and looked up by it: nothing waits for a leaf
    shared = _written(
        variants.mapInArrow(_word_counts(sizes), "key long, n long, leaf_n long")
        .groupBy("key")
        .agg(F.sum("n").alias("n"), F.max("leaf_n").alias("leaf_n"))
        .filter(SHARED * F.col("n") > F.col("leaf_n"))
        .select("key", F.col("n").alias("value")),
        f"{folder}/shared.parquet",
    )
    shared = (folder, *_stored(shared, folder, "shared"))
    shaped = _written(
        variants.mapInArrow(_shaped(sizes, shared), "form long, n_words long, template long"),
        f"{folder}/shaped.parquet",
    )
    known = _places(
        forms.select("form", "around", "first").join(shaped, "form"), "template", "first", "n_words"
    ).filter(recurring())
    dropped = shaped.join(known.drop("n_words"), "template").groupBy("form").agg(
        F.coalesce(F.min("first"), F.lit(-(1 << 63))).alias("value")
    )
    dropped = _written(
        dropped.select(F.col("form").alias("key"), "value"), f"{folder}/dropped.parquet"
    )
    return _stored(dropped, folder, "dropped")


def _drop(folder: str, bits: int, files: frozenset, texts: bool):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                column = piece.column("text")
                found = Lines(column)
                rows = len(found.offsets) - 1
                ids = piece.column("doc_id").cast(pa.int64())
                known = ids.is_valid().to_numpy(zero_copy_only=False)[found.row]
                own = ids.fill_null(0).to_numpy()[found.row]
                held = look_up(found.form, folder, "dropped", bits, np.int64, 2, files)
                gone = (held[:, 1] > 0) & ~(known & (held[:, 0] == own))
                lines = np.bincount(found.row, minlength=rows)
                dropped = np.bincount(found.row, gone, rows).astype(np.int64)
                whole = dropped == lines
                dropped[whole] = 0
                gone &= ~whole[found.row]
                ends = found.offsets[1:]
                keep = np.ones(len(found.data), bool)
                # a line goes with its end
                after = np.minimum(found.stop + 1, ends[found.row])
                for a, b in zip(found.start[gone], after[gone]):
                    keep[a:b] = False
                out = [
                    (found.data[a:b][keep[a:b]] if n else found.data[a:b]).tobytes()
                    for a, b, n in zip(found.offsets[:-1], ends, dropped)
                ]
                columns = {
                    "n_lines": pa.array(lines, pa.int64()),
                    "n_dropped": pa.array(dropped),
                }
                names = [n for n in piece.schema.names if n != "text"]
                own_columns = [piece.column(n) for n in names]
                if texts:
                    kept = [
                        None if not valid else t.decode("utf-8")
                        for t, valid in zip(out, column.is_valid().to_pylist())
                    ]
                    columns["kept_text"] = pa.array(kept, pa.string())
                else:
                    columns["kept_sha256"] = pa.array(
                        [hashlib.sha256(t).hexdigest() for t in out]
                    )
                yield pa.RecordBatch.from_arrays(
                    own_columns + list(columns.values()), [*names, *columns]
                )

    return run


def drop_recurring(docs: DataFrame, texts: bool = True) -> DataFrame:
    """The documents' other columns with lines, dropped lines and the rest or its digest.

    ``doc_id`` is a whole number. A column of the input with the name of a result is left out.
    """
    folder = f"{shared_folder(docs.sparkSession)}/lines"
    own = docs.drop("n_lines", "n_dropped", "kept_text", "kept_sha256")
    bits, files = templates(own, folder)
    kept = own.drop("text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    last = "kept_text string" if texts else "kept_sha256 string"
    return own.mapInArrow(
        _drop(folder, bits, files, texts), f"{kinds}, n_lines long, n_dropped long, {last}"
    )
