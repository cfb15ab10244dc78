"""Benchmark decontamination: documents streamed through generalised suffix automata.

Distinct item texts are dealt into blocks of bounded size; one task builds the automaton of
each block and stores it in the shared folder. A document's words run through an automaton that
gives at each word the longest run of words that ends there and lies in some item, and the items
that hold it. Runs of a whole window (13 words, or a whole shorter item) are hits.

Every four words in a row of an item (fewer, if a block has a shorter one) are a seed. The seeds of
all blocks are one table of sorted arrays that workers map; a stretch of a document without a
seed of a block cannot hold a window of it. So a block's automaton is loaded only where its seeds are
found, once for some megabytes of text, and the cost does not grow with the number of blocks.

Defined cases: a null or empty text has no words and is clean; an item without words finds
nothing. Items of equal text are found together, each under its own id; a null item id is
written as an empty string. Repeated documents are judged one by one. Without items every document is
clean. Long texts are streamed whole.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.flat import (
    IS_ALNUM, LOWER, chain, flat, pieces, prefix, span_hash, sum_by_row, word_spans, worker_cache,
)
from loomlog.llm.store import get, put
from loomlog.session import shared_folder

WINDOW = 13
SEED_WORDS = 4
# bytes of item text for each automaton: some tens of thousands of words
BLOCK_BYTES = 1 << 20
# bytes of text that are looked at together, so that a block is loaded once for them
WALK_BYTES = 8 << 20
SEEDS_PER_FILE = 1 << 20
# a document is contaminated when one word in so many is hit
COVERAGE = 20


def words_of(column):
    """Hashes of the normalised words of a batch with their bytes' places."""
    data, offsets = flat(column)
    lowered = LOWER[data]
    start, stop, first = word_spans(IS_ALNUM[lowered], offsets)
    return span_hash(prefix(lowered), start, stop), start, stop, first, offsets


class Automaton:
    """All runs of words of a set of items, as one suffix automaton."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.step: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.whole: dict[int, list] = {}  # items of a run of a whole window, by state
        self.short: dict[int, list] = {}  # (words, item) of items below a window, by state
        self.shortest = window

    def _state(self, length: int, step: dict, link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def _fork(self, state: int, word: int, target: int) -> int:
        """Split off the runs that the target's longer ones do not share."""
        twin = self._state(self.length[state] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = twin
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = twin
            state = self.link[state]
        return twin

    def _extend(self, last: int, word: int) -> int:
        target = self.step[last].get(word)
        if target is not None:
            if self.length[target] == self.length[last] + 1:
                return target
            return self._fork(last, word, target)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.step[last]:
            self.step[last][word] = new
            last = self.link[last]
        if last >= 0:
            target = self.step[last][word]
            if self.length[target] == self.length[last] + 1:
                self.link[new] = target
            else:
                self.link[new] = self._fork(last, word, target)
        return new

    def add(self, words: list) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def advance(self, state: int, matched: int, word: int) -> tuple[int, int]:
        """The longest run that ends with this word, given that of the word before."""
        step, link = self.step, self.link
        while state and word not in step[state]:
            state = link[state]
            matched = self.length[state]
        if word in step[state]:
            return step[state][word], matched + 1
        return 0, 0

    def windows_at(self, state: int) -> int:
        """The state of the last window of a run: the shortest suffix that is long enough."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def name(self, words: list, item: int) -> None:
        """Note which states stand for windows of an item. All items must have been added."""
        if len(words) < self.window:
            self.shortest = min(self.shortest, len(words))
        state = 0
        for place, word in enumerate(words):
            state = self.step[state][word]
            if place + 1 >= self.window:
                at = self.windows_at(state)
                held = self.whole.setdefault(at, [])
                if not held or held[-1] != item:
                    held.append(item)
        if 0 < len(words) < self.window:
            self.short.setdefault(state, []).append((len(words), item))

    def hits(self, words: list):
        """``(last word, words covered, items)`` of every window in a run of words."""
        state = matched = 0
        for place, word in enumerate(words):
            state, matched = self.advance(state, matched, word)
            if matched >= self.window:
                yield place, matched, self.whole[self.windows_at(state)]
            if self.short:
                at, reach = state, matched
                while at > 0:
                    for size, item in self.short.get(at, ()):
                        if size <= reach:
                            yield place, size, (item,)
                    at = self.link[at]
                    reach = self.length[at]


def seeds(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of so many words in a row, at each place where they fit."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    keys = words[: len(words) - size + 1]
    for k in range(1, size):
        keys = chain(keys, words[k : len(words) - size + 1 + k])
    return keys


def build(items: list[tuple[list, int]], window: int = WINDOW) -> tuple[Automaton, int, np.ndarray]:
    """The automaton of items ``(word hashes, key)``, the seeds' size and the seeds, sorted."""
    machine = Automaton(window)
    for words, _ in items:
        machine.add(words)
    for words, key in items:
        if words:
            machine.name(words, key)
    size = min(SEED_WORDS, machine.shortest)
    found = [seeds(np.array(words, np.uint64), size) for words, _ in items if words]
    return machine, size, np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _build_blocks(folder: str, window: int):
    """Store the automaton of each block; ``(block, size, keys)`` of its seeds."""

    def run(batches):
        blocks: dict[int, list] = {}
        for batch in batches:
            words, _, _, first, _ = words_of(batch.column("text"))
            for k, (block, key) in enumerate(
                zip(batch.column("block").to_pylist(), batch.column("text_key").to_pylist())
            ):
                own = words[first[k] : first[k + 1]].tolist()
                if own:
                    blocks.setdefault(block, []).append((own, key))
        for block, items in blocks.items():
            machine, size, known = build(items, window)
            packed = pickle.dumps(vars(machine), protocol=5)
            put(folder, f"block-{block}", np.frombuffer(packed, np.uint8))
            yield pa.record_batch({
                "block": pa.array([block], pa.int32()),
                "size": pa.array([size], pa.int32()),
                "keys": pa.array([known.view(np.int64)], pa.list_(pa.int64())),
            })

    return run


def _write_seeds(folder: str):
    """The seeds of a file, sorted, with the block of each; a seed of several blocks repeats."""

    def run(batches):
        held, current, names = [], None, []

        def close():
            if held:
                key, block = (np.concatenate(x) for x in zip(*held))
                held.clear()
                order = np.argsort(key.view(np.uint64), kind="stable")
                put(folder, f"seeds-{current[0]}-{current[1]}.keys", key[order])
                put(folder, f"seeds-{current[0]}-{current[1]}.blocks", block[order])
                names.append(current)

        for batch in batches:
            size, file, key, block = (c.to_numpy() for c in batch.columns)
            edges = np.flatnonzero(
                np.r_[True, (size[1:] != size[:-1]) | (file[1:] != file[:-1])]
            ) if len(size) else []
            for a, b in zip(edges, [*edges[1:], len(size)]):
                if (int(size[a]), int(file[a])) != current:
                    close()
                    current = int(size[a]), int(file[a])
                held.append((key[a:b], block[a:b]))
        close()
        columns = zip(*names) if names else ([], [])
        yield pa.record_batch([pa.array(c, pa.int32()) for c in columns], ["size", "file"])

    return run


def _automaton(folder: str, block: int) -> Automaton:
    held = worker_cache()
    if held.get("block", (None,))[0] != (folder, block):  # one at a time is in memory
        machine = Automaton()
        vars(machine).update(pickle.loads(get(folder, f"block-{block}", np.uint8)))
        held["block"] = (folder, block), machine
    return held["block"][1]


@dataclass(frozen=True)
class Seeds:
    """The stored seeds: bits of a key that name its file, and the files of each size."""

    folder: str
    bits: int
    files: dict

    def found(self, words: np.ndarray):
        """``(block, size, places)`` of every block with a seed among the words."""
        for size, files in self.files.items():
            keys = seeds(words, size)
            order = np.argsort(keys) if self.bits else np.arange(len(keys))
            ordered = keys[order]
            own = (ordered >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else ordered * 0
            held, at = np.unique(own, return_index=True)
            blocks, places = [], []
            for file, a, b in zip(held.tolist(), at, [*at[1:], len(keys)]):
                if file not in files:
                    continue
                stored = get(self.folder, f"seeds-{size}-{file}.keys", np.uint64)
                block = get(self.folder, f"seeds-{size}-{file}.blocks", np.int32)
                low = np.searchsorted(stored, ordered[a:b], "left")
                hit = np.flatnonzero(stored[np.minimum(low, len(stored) - 1)] == ordered[a:b])
                low, high = low[hit], np.searchsorted(stored, ordered[a:b][hit], "right")
                more = np.arange((high - low).sum()) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
                blocks.append(block[np.repeat(low, high - low) + more])
                places.append(np.repeat(order[a:b][hit], high - low))
            if blocks:
                blocks, places = np.concatenate(blocks), np.concatenate(places)
                for one in np.unique(blocks).tolist():
                    yield one, size, places[blocks == one]


def _scan_block(words, first, machine, size, at, covered, found) -> None:
    """Mark the words that a block's automaton hits near its seeds; add the items by row."""
    live = np.zeros(len(words) + 1, np.int32)
    np.add.at(live, at, 1)
    np.add.at(live, at + size, -1)
    live = np.cumsum(live[:-1]) > 0
    start, stop, _ = word_spans(live, first)
    for a, b in zip(start, stop):
        if b - a < machine.shortest:
            continue
        for last, reach, items in machine.hits(words[a:b].tolist()):
            covered[a + last + 1 - reach : a + last + 1] = True
            found.setdefault(int(np.searchsorted(first, a, "right")) - 1, set()).update(items)


def _cleaned(data, start, stop, covered, first, offsets) -> list[str]:
    """Texts without the bytes from the first to the last word of each run of hit words."""
    keep = np.ones(len(data), bool)
    run_start, run_stop, _ = word_spans(covered, first)
    for a, b in zip(run_start, run_stop):
        keep[start[a] : stop[b - 1]] = False
    raw = data.tobytes()
    out = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        part = raw[a:b] if keep[a:b].all() else data[a:b][keep[a:b]].tobytes()
        out.append(part.decode("utf-8"))
    return out


def _scan(stored: Seeds, texts: bool):
    def run(batches):
        for batch in batches:
            for group in pieces(batch, limit=WALK_BYTES):
                parts, wanted = [], {}
                for piece in pieces(group):
                    words, _, _, first, _ = words_of(piece.column("text"))
                    for block, size, at in stored.found(words):
                        wanted.setdefault(block, []).append((len(parts), size, at))
                    # words' places are found again where texts are cut
                    parts.append((piece, words, first, np.zeros(len(words), bool), {}))
                for block in sorted(wanted):
                    machine = _automaton(stored.folder, block)
                    for part, size, at in wanted[block]:
                        _, words, first, covered, found = parts[part]
                        _scan_block(words, first, machine, size, at, covered, found)
                for piece, _, first, covered, found in parts:
                    yield _result(piece, first, covered, found, texts)

    return run


def _result(piece: pa.RecordBatch, first, covered, found, texts: bool) -> pa.RecordBatch:
    """A piece's own columns and what was found in it."""
    rows = len(first) - 1
    columns = {
        "n_words": pa.array(np.diff(first), pa.int64()),
        "n_hit": pa.array(sum_by_row(covered, first), pa.int64()),
        "text_keys": pa.array(
            [sorted(found.get(k, ())) for k in range(rows)], pa.list_(pa.int64())
        ),
    }
    own = [piece.column(k) for k in range(piece.num_columns)]
    names = list(piece.schema.names)
    if texts:
        column = piece.column("text")
        _, start, stop, first, offsets = words_of(column)
        clean = _cleaned(flat(column)[0], start, stop, covered, first, offsets)
        columns["clean_text"] = pa.array(clean, pa.string())
    else:
        at = names.index("text")
        del own[at], names[at]
    return pa.RecordBatch.from_arrays(own + list(columns.values()), [*names, *columns])


def _store(distinct: DataFrame, folder: str, window: int, block_bytes: int) -> Seeds:
    """Build and store the automata of all blocks and the table of their seeds."""
    spark = distinct.sparkSession
    size = distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = size // block_bytes + 1
    # the key is a hash already
    dealt = distinct.withColumn("block", F.pmod("text_key", F.lit(count)).cast("int"))
    dealt.repartition("block").mapInArrow(
        _build_blocks(folder, window), "block int, size int, keys array<long>"
    ).write.parquet(f"{folder}/built")
    keys = spark.read.parquet(f"{folder}/built").select("size", "block", F.explode("keys").alias("key"))
    bits = int(keys.count() / SEEDS_PER_FILE).bit_length()
    file = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)
    written = (
        keys.select("size", file.alias("file"), "key", "block")
        .repartition("size", "file")
        .sortWithinPartitions("size", "file")
        .mapInArrow(_write_seeds(folder), "size int, file int")
        .collect()  # one row for each million seeds
    )
    files: dict[int, set] = {}
    for row in written:
        files.setdefault(row["size"], set()).add(row["file"])
    return Seeds(folder, bits, files)


def item_texts(items: DataFrame) -> DataFrame:
    """``(item_id, text, text_key)``: items that have a text, equal texts under one key."""
    return items.filter("text is not null").select(
        "item_id", "text", F.xxhash64("text").alias("text_key")
    )


def scan(
    docs: DataFrame, items: DataFrame, texts: bool = False, window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Words, hit words and found items' keys of every document, after its own columns.

    With ``texts`` also ``clean_text``, without the spans that were hit; else the text is left
    out. A column of the input with the name of a result is dropped.
    """
    folder = f"{shared_folder(docs.sparkSession)}/automata"
    distinct = item_texts(items).groupBy("text_key").agg(F.min("text").alias("text"))
    stored = _store(distinct, folder, window, block_bytes)
    results = "n_words long, n_hit long, text_keys array<long>"
    own = docs.drop("n_words", "n_hit", "text_keys", "clean_text")
    kept = own if texts else own.drop("text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return own.mapInArrow(
        _scan(stored, texts), f"{kinds}, {results}" + ", clean_text string" * texts
    )


def contaminated() -> F.Column:
    """The rule on ``n_hit`` and ``n_words``."""
    return (F.col("n_hit") > 0) & (COVERAGE * F.col("n_hit") >= F.col("n_words"))


def judged_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Hit words, found items and the verdict on every document."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/scanned"
    # the few hits are joined back by row, as ids may repeat
    scan(docs.select("doc_id", "text"), items).withColumn(
        "row", F.monotonically_increasing_id()
    ).write.parquet(path)
    rows = spark.read.parquet(path)
    found = (
        rows.select("row", F.explode("text_keys").alias("text_key"))
        .join(item_texts(items).select("item_id", "text_key"), "text_key")
        .select("row", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"))
        .distinct()
        .groupBy("row")
        .agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item")).alias("ids"))
        .select("row", "n_items", F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    )
    return rows.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        "n_hit",
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
