"""Packing: documents cut into pieces of power-of-two length, by the binary form of their length.

A document of n tokens gives n // 1024 pieces of 1024 and one piece for each further bit of n,
longest first. Every piece is a sequence of its own, so none holds two documents and none needs
padding; sequences of equal length go to one bucket. Nothing is shuffled.

Defined cases: a null or empty text has one token, the end of text. Repeated documents are
packed each time. A text that holds the spelling of a special token gets that token, as the
tokenizers library gives it.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.flat import pieces, worker_cache

MOST = 1024
END_TOKEN = 0
VOCABULARY = "byte_bpe_50k"


def vocabulary_files(name: str = VOCABULARY) -> tuple[str, str, str]:
    """The tokenizer's file, the same vocabulary as ranks, and the pattern that splits words."""
    import public_tokenizers

    return (
        public_tokenizers.path(f"{name}.json"),
        public_tokenizers.path(f"{name}.tiktoken"),
        public_tokenizers.PATTERN,
    )


def _encoder(name: str, files):
    """Text to ids. Both libraries give the same ids; the faster one knows no special tokens,
    so texts with their spelling go to the other."""
    held = worker_cache()
    if ("encoder", name) not in held:
        import tiktoken
        from tokenizers import Tokenizer

        whole, ranked, pattern = files(name)
        exact = Tokenizer.from_file(whole)
        special = [t.content for t in exact.get_added_tokens_decoder().values()]
        with open(ranked, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> list[int]:
            if any(s in text for s in special):
                return exact.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        held["encoder", name] = encode
    return held["encoder", name]


def piece_lengths(n: int, most: int = MOST) -> list[int]:
    """Powers of two that add up to n, the longest first, none above ``most``."""
    rest = n % most
    bits = range(most.bit_length() - 2, -1, -1)
    return [most] * (n // most) + [1 << k for k in bits if rest >> k & 1]


def _cut(name: str, files, most: int, ids: bool):
    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                encode = _encoder(name, files)
                owner, starts, lengths, sums, totals, kept = [], [], [], [], [], []
                for row, text in enumerate(part.column("text").to_pylist()):
                    tokens = np.array([*encode(text or ""), END_TOKEN], "<u4")
                    at = 0
                    for length in piece_lengths(len(tokens), most):
                        own = tokens[at : at + length]
                        owner.append(row)
                        starts.append(at)
                        lengths.append(length)
                        sums.append(zlib.crc32(own.tobytes()))
                        totals.append(len(tokens))
                        if ids:
                            kept.append(own.astype(np.int32))
                        at += length
                columns = {
                    "doc_id": part.column("doc_id").take(pa.array(owner, pa.int64())),
                    "start": pa.array(starts, pa.int64()),
                    "length": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array(sums, pa.int64()),
                    "doc_tokens": pa.array(totals, pa.int64()),
                }
                if ids:
                    columns["ids"] = pa.array(kept, pa.list_(pa.int32()))
                yield pa.record_batch(columns)

    return run


def pack(
    docs: DataFrame, ids: bool = True, most: int = MOST, name: str = VOCABULARY,
    files=vocabulary_files,
) -> DataFrame:
    """One row per sequence: its document, place, length, bucket, and token ids if wanted.

    ``files`` finds the vocabulary's files on the machine of the worker that calls it.
    """
    if most & (most - 1):
        raise ValueError("the longest length must be a power of two")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    cut = docs.select("doc_id", "text").mapInArrow(
        _cut(name, files, most, ids), schema + ", ids array<int>" * ids
    )
    return cut.withColumns(
        {
            "sequence_id": F.monotonically_increasing_id(),
            "offset": F.lit(0).cast("long"),
            "bucket": F.log2(F.col("length")).cast("int"),
        }
    )


def write_buckets(sequences: DataFrame, path: str) -> None:
    """Sequences of equal length in one folder each, so that batches need no padding."""
    sequences.write.partitionBy("bucket").parquet(path)
