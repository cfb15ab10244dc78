"""Quality rules: a hashed n-gram log-likelihood ratio between trusted and raw text.

Words and runs of signs, lower-cased, and their pairs are hashed into a fixed number of buckets.
The counts of all documents make one multinomial, those of trusted documents the other. A
document's ratio is the mean of log(trusted / raw) over its n-grams, so its length does not
matter, and a fixed threshold decides. Trusted documents are a bounded sample of labelled rows;
the raw counts cover every document.

Defined cases: a null or empty text has no words and fails the base rules. Repeated rows count
each time. Without labels, or without a labelled document, both multinomials are even and the
ratio is 0. A null label or id trusts nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.flat import (
    IS_ALNUM,
    IS_WORD,
    LOWER,
    chain,
    flat,
    mix,
    pieces,
    prefix,
    repeated,
    row_of,
    span_hash,
    sum_by_row,
    word_spans,
)

BUCKETS = 1 << 14
TRUSTED_ROWS = 50_000
LEAST_RATIO = -0.25
LEAST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5
# fixed values: the characters that count as symbols
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_ROW_SALT = np.uint64(0xD6E8FEB86659FD93)


def ngram_buckets(column) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram of a batch, and the first n-gram of each row."""
    data, offsets = flat(column)
    data = LOWER[data]
    inside, alnum = IS_WORD[data], IS_ALNUM[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = alnum[1:] != alnum[:-1]
    start, stop, first = word_spans(inside, offsets, cut)
    single = span_hash(prefix(data), start, stop)
    row = row_of(first)
    within = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
    pair = chain(single[:-1], single[1:])[within]
    both = np.concatenate([single, pair])
    rows = np.concatenate([row, row[1:][within]]) if len(row) else row
    order = np.argsort(rows, kind="stable")
    buckets = (both >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)[order]
    return buckets, np.searchsorted(rows[order], np.arange(len(first)))


def base_columns(column) -> dict[str, np.ndarray]:
    """Words, their characters, symbols, repeated lines and repeated words of each text."""
    data, offsets = flat(column)
    inside = IS_WORD[data]
    start, stop, first = word_spans(inside, offsets)
    rows, row = len(first) - 1, row_of(first)
    sums = prefix(data)

    # a code point has one byte that is not a continuation
    letters = sum_by_row(inside & ((data & 0xC0) != 0x80), offsets)
    symbols = sum_by_row(_SYMBOLS[data], offsets)

    line_start, line_stop, line_first = word_spans(data != 10, offsets)
    words_before = np.searchsorted(start, np.r_[line_start, line_stop])
    full = words_before[: len(line_start)] < words_before[len(line_start) :]
    line_row = row_of(line_first)[full]
    lines = span_hash(sums, line_start[full], line_stop[full])
    _, later = repeated(mix(lines + line_row.astype(np.uint64) * _ROW_SALT))

    words = span_hash(sums, start, stop)
    covered = np.zeros(len(words), bool)
    if len(words) >= WINDOW:
        windows = words[: len(words) - WINDOW + 1]
        for k in range(1, WINDOW):
            windows = chain(windows, words[k : len(words) - WINDOW + 1 + k])
        at = np.flatnonzero(row[: len(windows)] == row[WINDOW - 1 :])
        again, _ = repeated(
            mix(windows[at] + row[at].astype(np.uint64) * _ROW_SALT)
        )
        for k in range(WINDOW):
            covered[at[again] + k] = True
    return {
        "n_words": np.diff(first),
        "word_chars": letters,
        "n_symbols": symbols,
        "n_dup_lines": np.bincount(line_row[later], minlength=rows).astype(np.int64),
        "n_repeat_words": sum_by_row(covered, first),
    }


def _count(batches):
    raw, trusted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for piece in pieces(batch):
            buckets, first = ngram_buckets(piece.column("text"))
            raw += np.bincount(buckets, minlength=BUCKETS)
            good = piece.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            trusted += np.bincount(
                buckets[np.repeat(good, np.diff(first))], minlength=BUCKETS
            )
    used = np.flatnonzero(raw)
    yield pa.record_batch(
        {
            "bucket": pa.array(used, pa.int32()),
            "raw": pa.array(raw[used]),
            "trusted": pa.array(trusted[used]),
        }
    )


def trusted_ids(labels: DataFrame, bound: int = TRUSTED_ROWS) -> DataFrame:
    """Ids of documents labelled good and not toxic, about ``bound`` of them at most.

    Which ones is decided by a hash of the id, so nothing is sorted and any size is safe.
    """
    good = labels.filter("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id")
    n = good.count()
    share = int(min(1.0, bound / max(n, 1)) * (1 << 30))
    return good.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).distinct()


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRUSTED_ROWS) -> np.ndarray:
    """The weight log(trusted / raw) of each bucket, from the counts of every document."""
    ids = F.broadcast(trusted_ids(labels, bound).withColumn("trusted", F.lit(True)))
    flagged = docs.select("doc_id", "text").join(ids, "doc_id", "left")
    counts = (
        flagged.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
        .mapInArrow(_count, "bucket int, raw long, trusted long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
    )
    both = np.zeros((2, BUCKETS))
    for bucket, raw, trusted in counts.collect():  # at most BUCKETS rows
        both[:, bucket] = raw, trusted
    if not both[1].any():
        return np.zeros(BUCKETS)
    shares = (both + 1) / (both.sum(axis=1, keepdims=True) + BUCKETS)
    return np.log(shares[1] / shares[0])


def _judge(weights: np.ndarray, least: float):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                text = piece.column("text")
                found = base_columns(text)
                buckets, first = ngram_buckets(text)
                ratio = sum_by_row(weights[buckets], first) / np.maximum(np.diff(first), 1)
                failed = (found["n_words"] < LEAST_WORDS) | (
                    100 * found["n_repeat_words"] > MOST_REPEATED * found["n_words"]
                )
                yield pa.RecordBatch.from_arrays(
                    [piece.column(k) for k in range(piece.num_columns)]
                    + [pa.array(v, pa.int64()) for v in found.values()]
                    + [pa.array(failed), pa.array(ratio), pa.array(~failed & (ratio >= least))],
                    [*piece.schema.names, *found, "base_failed", "ratio", "kept"],
                )

    return run


JUDGED = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, ratio double, kept boolean"
)


def judge(docs: DataFrame, weights: np.ndarray, least: float = LEAST_RATIO) -> DataFrame:
    """The documents' own columns with the base figures, the ratio and the verdict.

    A column of the input that has the name of a result is left out.
    """
    names = [c.split()[0] for c in JUDGED.split(", ")]
    own = docs.drop(*names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(_judge(weights, least), f"{kinds}, {JUDGED}")


def judged_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The verdict on every document, without the texts."""
    found = judge(docs.select("doc_id", "text"), fit(docs, labels))
    return found.drop("text")
