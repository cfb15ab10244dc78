"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Sixteen voters look at a text: lexicons of words and of word beginnings that go with toxic labels,
lists of insults in four languages, and patterns (hits close together, frequent, next to a
word of address, shouting). A label model explains how often each pattern of votes occurs over all
documents: a hidden class, every voter's accuracy in either class, and a tree of voters that
follow one another beyond what the class explains. Its posteriors are the labels on which a
logistic regression over words and word beginnings is trained; that alone scores a text.

What covers everything: the counts of vote patterns, and the scores. What is a sample, bounded by a
parameter: labelled rows for the lexicons and as anchors of the label model (``LABELLED_ROWS``), and
rows the classifier is fitted on (``TRAINING_ROWS`` of either class, weighted back). Rows whose
crc32(id) mod 3 is 1 are held out: they give no label and train nothing; their votes count as
those of any unlabelled text.

Defined cases: a null or empty text has no words and gets the score of a text without any listed word.
A row without an id is not held out and never labelled. Labels other than 0 and 1, and ids labelled both ways, are
passed over. Without labels the insult lists alone decide; without documents there are no rows.
Repeated rows count each time. Columns beyond id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.flat import LOWER, flat, mix, pieces, prefix, row_of, span_hash, sum_by_row, word_spans
from loomlog.llm.near import shingle_sets
from loomlog.session import shared_folder

LABELLED_ROWS, TRAINING_ROWS = 20_000, 8_000
MOST_TERMS, MOST_FEATURES = 2_048, 4_096
# what a mined term must have: toxic texts, and their share of all texts with the term
LEAST_TOXIC, LEAST_SHARE = 3, 0.5
THRESHOLD = 0.7
VOTERS = 16
RIDGE, STEPS = 0.1, 300

# general lists of insults and words of address; their accuracy is estimated like any other voter's
INSULTS = {
    "en": (
        "idiot moron loser pathetic scum worthless trash clown disgusting stupid dumb fool jerk "
        "imbecile bastard bitch asshole filth vermin"
    ),
    "de": "idiot depp trottel abschaum versager dumm erbärmlich wertlos widerlich arschloch schwachkopf",
    "fr": "idiot crétin imbécile minable ordure raclure stupide dégoûtant salaud connard abruti",
    "es": "idiota imbécil estúpido patético basura escoria asqueroso inútil payaso cabrón pendejo",
}
ADDRESS = "you your you're u du dich dein ihr euch tu toi vous te ton tú ti usted vosotros"
NEAR, CLOSE, DENSE, LOUD = 3, 12, 50, 0.4

# letters: ASCII letters and everything beyond ASCII
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[0x41:0x5B] = _IS_LETTER[0x61:0x7B] = _IS_LETTER[0x80:] = True
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[0x41:0x5B] = True
# bytes of text looked at together, and features a task counts before it sends them on
PIECE, HELD_FEATURES = 1 << 19, 500_000
_SKETCHES = "sketch0 long, sketch1 long"
# kinds of features: the whole word, and its first bytes where it has as many
BEGINNINGS = (4, 5, 6)
_SALT = mix(np.arange(1, 2 + len(BEGINNINGS), dtype=np.uint64))
_KIND_BITS = np.uint64(3)


def word_features(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its features (one row per kind, 0 where too short); firsts; upper-case share.

    The last two bits of a feature are its kind.
    """
    data, offsets = flat(column)
    upper, letters = _IS_UPPER[data], _IS_LETTER[data]
    start, stop, first = word_spans(letters, offsets)
    sums = prefix(LOWER[data])
    found = np.zeros((1 + len(BEGINNINGS), len(start)), np.uint64)
    for kind, size in enumerate((None, *BEGINNINGS)):
        end = stop if size is None else np.minimum(stop, start + size)
        value = mix(span_hash(sums, start, end) ^ _SALT[kind])
        value = (value & ~_KIND_BITS) | np.uint64(kind)
        found[kind] = value if size is None else np.where(stop - start >= size, value, 0)
    loud = sum_by_row(upper, offsets) / np.maximum(1, sum_by_row(letters, offsets))
    return found, first, loud


def _in(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in a sorted list, -1 where it is not there."""
    if not len(sorted_keys):
        return np.full(keys.shape, -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def _listed(words: str) -> np.ndarray:
    column = pa.array(words.split())
    return np.unique(word_features(column)[0][0])


@dataclass
class Voters:
    """Sorted features and the voter of each, with the words of address."""

    keys: np.ndarray
    voter: np.ndarray
    address: np.ndarray

    @classmethod
    def of(cls, terms: np.ndarray) -> Voters:
        """Mined terms dealt to two voters a kind, and one voter for each list of insults."""
        kind = (terms & _KIND_BITS).astype(np.int64)
        half = (mix(terms) >> np.uint64(63)).astype(np.int64)
        keys, voter = [terms], [2 * kind + half]
        for k, words in enumerate(INSULTS.values()):
            listed = _listed(words)
            keys.append(listed)
            voter.append(np.full(len(listed), 8 + k))
        keys, voter = np.concatenate(keys), np.concatenate(voter)
        order = np.argsort(keys, kind="stable")
        return cls(keys[order], voter[order], _listed(ADDRESS))

    def patterns(self, column) -> np.ndarray:
        """The votes on each text as bits."""
        found, first, loud = word_features(column)
        rows, row = len(first) - 1, row_of(first)
        votes = np.zeros(rows, np.int64)
        hit = np.zeros(found.shape[1], bool)
        low = _in(self.keys, found)
        # a key may belong to a mined lexicon and to lists at once
        for kind, word in zip(*np.nonzero(low >= 0)):
            key = found[kind, word]
            for k in range(low[kind, word], np.searchsorted(self.keys, key, "right")):
                votes[row[word]] |= 1 << int(self.voter[k])
            hit[word] = True
        at = np.flatnonzero(hit)
        if len(at):
            gap = np.diff(at)
            close = (gap <= CLOSE) & (row[at[1:]] == row[at[:-1]])
            votes[row[at[1:]][close]] |= 1 << 12
            count = np.bincount(row[at], minlength=rows)
            votes[(count * DENSE >= np.diff(first)) & (count > 0)] |= 1 << 13
            called = np.flatnonzero(_in(self.address, found[0]) >= 0)
            if len(called):
                for shift in range(-NEAR, NEAR + 1):
                    there = at + shift
                    inside = (there >= 0) & (there < len(row))
                    inside[inside] &= row[there[inside]] == row[at[inside]]
                    beside = inside.copy()
                    beside[inside] = np.isin(there[inside], called)
                    votes[row[at[beside]]] |= 1 << 14
        votes[(loud > LOUD) & (np.diff(first) >= 5)] |= 1 << 15
        return votes


@dataclass
class LabelModel:
    """P(class), and P(vote | class, vote of its parent) with parents in a tree of voters."""

    prior: float
    parent: np.ndarray
    table: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        votes = (np.asarray(patterns)[:, None] >> np.arange(VOTERS)) & 1
        led = np.where(self.parent >= 0, votes[:, np.maximum(self.parent, 0)], 0)
        like = []
        for y in (0, 1):
            p = self.table[y, np.arange(VOTERS), led]
            like.append(np.log(np.where(votes == 1, p, 1 - p)).sum(axis=1))
        apart = like[1] - like[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(apart, -500, 500)))

    def accuracies(self, patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """P(vote | class) of each voter, parents summed out over the patterns."""
        votes = (patterns[:, None] >> np.arange(VOTERS)) & 1
        post = self.posterior(patterns)
        mass = np.stack([counts * (1 - post), counts * post])
        return mass @ votes / np.maximum(mass.sum(axis=1, keepdims=True), 1e-12)


def _tree(votes: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Parents in the spanning tree of most information between two voters, given the class."""
    info = np.zeros((VOTERS, VOTERS))
    everything = max(mass.sum(), 1e-12)
    for y in (0, 1):
        total = mass[y].sum() + 4.0
        both = (votes * mass[y][:, None]).T @ votes
        one = np.diag(both)
        cells = {
            (1, 1): both + 1,
            (1, 0): one[:, None] - both + 1,
            (0, 1): one[None, :] - both + 1,
            (0, 0): mass[y].sum() - one[:, None] - one[None, :] + both + 1,
        }
        left = {u: (cells[u, 0] + cells[u, 1]) / total for u in (0, 1)}
        right = {u: (cells[0, u] + cells[1, u]) / total for u in (0, 1)}
        for (u, v), n in cells.items():
            p = np.maximum(n, 1e-12) / total
            info += mass[y].sum() / everything * p * np.log(p / (left[u] * right[v]))
    parent = np.full(VOTERS, -1)
    reach, best = np.full(VOTERS, -np.inf), np.full(VOTERS, -1)
    inside = np.zeros(VOTERS, bool)
    at = 0
    for _ in range(VOTERS - 1):
        inside[at] = True
        closer = ~inside & (info[at] > reach)
        reach[closer], best[closer] = info[at][closer], at
        at = int(np.argmax(np.where(inside, -np.inf, reach)))
        parent[at] = best[at]
    return parent


def fit_labels(
    patterns: np.ndarray, counts: np.ndarray, label: np.ndarray, rounds: int = 60
) -> LabelModel:
    """Expectation maximisation over counted vote patterns.

    ``label`` is 0 or 1 where a pattern's rows are anchored, else -1. First without, then with
    the tree of correlations.
    """
    votes = (patterns[:, None] >> np.arange(VOTERS)) & 1
    table = np.zeros((2, VOTERS, 2))
    table[0], table[1] = 0.02, 0.4
    model = LabelModel(0.1, np.full(VOTERS, -1), table)
    for with_tree in (False, True):
        for k in range(rounds):
            post = np.where(label >= 0, label, model.posterior(patterns))
            mass = np.stack([counts * (1 - post), counts * post])
            if with_tree and k == 0:
                model = LabelModel(model.prior, _tree(votes, mass), model.table)
            led = np.where(model.parent >= 0, votes[:, np.maximum(model.parent, 0)], 0)
            table = np.zeros((2, VOTERS, 2))
            for y in (0, 1):
                # what a table entry is smoothed to: the vote's share in the class
                share = (mass[y] @ votes + 0.02 * (1 + 19 * y)) / (mass[y].sum() + 1)
                for u in (0, 1):
                    rows = mass[y][:, None] * (led == u)
                    table[y, :, u] = ((rows * votes).sum(axis=0) + 4 * share) / (rows.sum(axis=0) + 4)
            prior = (mass[1].sum() + 1) / (mass.sum() + 10)
            model = LabelModel(prior, model.parent, np.clip(table, 1e-6, 1 - 1e-6))
    return model


@dataclass
class Classifier:
    """Logistic regression over the presence of features."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, column) -> np.ndarray:
        row, at, rows = present(column, self.keys)
        total = np.bincount(row, self.weights[at], rows) if len(row) else np.zeros(rows)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -500, 500)))


def present(column, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Which of the sorted keys each text has: pairs of row and place, and the number of rows."""
    found, first, _ = word_features(column)
    at = _in(keys, found)
    kind, word = np.nonzero(at >= 0)
    pairs = np.unique(row_of(first)[word] * np.int64(max(1, len(keys))) + at[kind, word])
    row, place = np.divmod(pairs, max(1, len(keys)))
    return row, place, len(first) - 1


def _associations(batches):
    """``(feature, toxic, n)``: weight of the texts that have a feature, and the toxic part of it."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def summed(parts):
        keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return [
            (keys, *(np.bincount(at, np.concatenate([p[k] for p in parts]), len(keys)) for k in (1, 2)))
        ]

    for batch in batches:
        for piece in pieces(batch, limit=PIECE):
            found, first, _ = word_features(piece.column("text"))
            own = piece.column("own").to_numpy(zero_copy_only=False)
            target = own * piece.column("target").to_numpy(zero_copy_only=False)
            row = np.broadcast_to(row_of(first), found.shape)[found > 0]
            keys, code = np.unique(found[found > 0], return_inverse=True)
            pairs = np.unique(code * np.int64(len(first)) + row)
            code, row = np.divmod(pairs, len(first))
            held.append(
                (keys, *(np.bincount(code, x[row], len(keys)) for x in (target, own)))
            )
            if sum(len(p[0]) for p in held) > HELD_FEATURES:
                held = summed(held)
                yield from _as_batches(*held.pop())
    if held:
        yield from _as_batches(*summed(held).pop())


def _as_batches(keys, toxic, n):
    for at in range(0, len(keys), 50_000):
        part = slice(at, at + 50_000)
        yield pa.record_batch(
            {"feature": pa.array(keys[part].view(np.int64)), "toxic": toxic[part], "n": n[part]}
        )


def associated(rows: DataFrame, most: int, least_share: float | None = None) -> np.ndarray:
    """The features that go with ``target`` beyond chance, the ``most`` surest of them, sorted.

    Chance is a likelihood ratio that about one of all features seen would reach. With
    ``least_share`` only features of which that share of texts is toxic.
    """
    sizes = rows.agg(F.sum(F.col("target") * F.col("own")), F.sum("own")).first()
    toxic_rows, all_rows = sizes[0] or 0.0, sizes[1] or 0.0
    if not 0 < toxic_rows < all_rows:
        return np.zeros(0, np.uint64)
    prior = toxic_rows / all_rows
    counts = (
        rows.select("text", "target", "own")
        .mapInArrow(_associations, "feature long, toxic double, n double")
        .groupBy("feature")
        .agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
        .filter(f"n >= {LEAST_TOXIC}")
    )
    share = F.col("toxic") / F.col("n")
    part = lambda p, q: F.when(p > 0, p * F.log(p / q)).otherwise(0.0)
    ratio = 2 * F.col("n") * (part(share, F.lit(prior)) + part(1 - share, F.lit(1 - prior)))
    written = f"{shared_folder(rows.sparkSession)}/features"
    counts.select("feature", "toxic", share.alias("share"), ratio.alias("ratio")).write.parquet(written)
    found = rows.sparkSession.read.parquet(written)
    tested = max(2, found.count())
    kept = found.filter(F.col("ratio") >= float(2 * np.log(tested)))
    if least_share is not None:
        kept = kept.filter(f"toxic >= {LEAST_TOXIC} and share >= {max(least_share, prior)}")
    top = kept.orderBy(F.desc("ratio"), "feature").limit(most).collect()  # at most ``most`` rows
    return np.sort(np.array([r["feature"] for r in top], np.int64).view(np.uint64))


def sketches(column) -> dict[str, pa.Array]:
    """Two minimum hashes of each text's five-word shingles, which near copies mostly share."""
    value, offsets = shingle_sets(column)
    full = np.diff(offsets) > 0
    found = {}
    for k in range(2):
        hashes = mix(value ^ _SALT[k])
        least = np.zeros(len(full), np.uint64)
        if full.any():
            least[full] = np.minimum.reduceat(hashes, offsets[:-1][full])
        found[f"sketch{k}"] = pa.array(least.view(np.int64))
    return found


def _known(batches):
    for batch in batches:
        for piece in pieces(batch, limit=PIECE):
            text = piece.column("text")
            yield pa.record_batch({"text": text, "target": piece.column("target"), **sketches(text)})


def with_own_weight(rows: DataFrame, folder: str) -> DataFrame:
    """``rows``, with their sketches, with ``own`` in place of these: one over the number of rows
    that share a sketch with the text.

    A document that occurs a thousand times tells no more about its words than one does. The
    rows are a bounded sample; what meets under a sketch is a number, not the texts.
    """
    rows.write.parquet(folder)
    found = rows.sparkSession.read.parquet(folder)
    most = F.lit(1)
    for name in ("sketch0", "sketch1"):
        # no more rows than the sample has: LABELLED_ROWS, or TRAINING_ROWS of either class
        counts = F.broadcast(found.groupBy(name).agg(F.count("*").alias(f"{name}_rows")))
        found = found.join(counts, name)
        most = F.greatest(most, F.col(f"{name}_rows"))
    kept = [c for c in rows.columns if not c.startswith("sketch")]
    return found.select(*kept, (1 / most).alias("own"))


def held_out() -> F.Column:
    left = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    return F.coalesce(left == 1, F.lit(False))


def _by_hash(share: float) -> F.Column:
    """True for about this share of rows, decided by id and text."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


def labelled_ids(labels: DataFrame, bound: int = LABELLED_ROWS) -> DataFrame:
    """``(doc_id, toxic)`` of about ``bound`` labelled rows at most, none of them held out."""
    known = (
        labels.filter("doc_id is not null and toxic in (0, 1)")
        .filter(~held_out())
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
        .filter("toxic = other")
        .select("doc_id", F.col("toxic").cast("double").alias("toxic"))
    )
    share = int(min(1.0, bound / max(1, known.count())) * (1 << 30))
    return known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)


def _voted(voters: Voters):
    def run(batches):
        seen: dict[tuple[int, int, bool], int] = {}
        for batch in batches:
            for piece in pieces(batch, limit=PIECE):
                votes = voters.patterns(piece.column("text"))
                label = piece.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
                out = piece.column("held_out").to_numpy(zero_copy_only=False)
                keys, n = np.unique(
                    ((votes * 3 + label + 1) << 1) | out, return_counts=True
                )
                for key, count in zip(keys.tolist(), n.tolist()):
                    seen[key] = seen.get(key, 0) + count
        keys = np.array(list(seen), np.int64)
        yield pa.record_batch(
            {
                "pattern": keys // 6,
                "label": (keys >> 1) % 3 - 1,
                "held_out": pa.array((keys & 1) == 1),
                "n": np.array(list(seen.values()), np.int64),
            }
        )

    return run


def _targets(voters: Voters, model: LabelModel):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, limit=PIECE):
                target = model.posterior(voters.patterns(piece.column("text")))
                share = piece.column("place").to_numpy(zero_copy_only=False)
                limit = np.where(
                    target >= 0.5,
                    piece.column("toxic_share").to_numpy(zero_copy_only=False),
                    piece.column("clean_share").to_numpy(zero_copy_only=False),
                )
                kept = pa.array(share < limit)
                text = piece.column("text").filter(kept)
                yield pa.record_batch(
                    {
                        "text": text,
                        "target": pa.array(target).filter(kept),
                        "weight": pa.array(1 / np.maximum(limit, 1e-12)).filter(kept),
                        **sketches(text),
                    }
                )

    return run


def _pairs(keys: np.ndarray):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, limit=PIECE):
                row, at, rows = present(piece.column("text"), keys)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)),
                    pa.array(at.astype(np.int32)),
                )
                yield pa.RecordBatch.from_arrays(
                    [lists, piece.column("target"), piece.column("weight")],
                    ["features", "target", "weight"],
                )

    return run


def logistic(
    lists: list, target: np.ndarray, weight: np.ndarray, size: int, steps: int = STEPS
) -> tuple[np.ndarray, float]:
    """Weights and bias of ridge logistic regression with soft targets, by accelerated gradients.

    Each coordinate has its own step, from the rows that have the feature.
    """
    w, bias = np.zeros(size + 1), 0.0
    if not len(target):
        return w[:size], bias
    # the bias is one more feature, which every row has
    row = np.repeat(np.arange(len(lists)), [len(x) + 1 for x in lists])
    col = np.concatenate([np.r_[np.asarray(x, np.int64), size] for x in lists])
    weight = weight / weight.mean()
    widest = np.bincount(row, minlength=len(lists)).astype(float)
    scale = RIDGE + np.bincount(col, (weight * widest / 4)[row], size + 1)
    ridge = np.r_[np.full(size, RIDGE), 1e-3]
    ahead, momentum = w, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, ahead[col], len(lists)), -500, 500)))
        slope = np.bincount(col, (weight * (p - target))[row], size + 1) + ridge * ahead
        new = ahead - slope / scale
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / following * (new - w)
        w, momentum = new, following
    return w[:size], float(w[size])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Classifier, LabelModel, Voters]:
    """Lexicons from labels, the label model from all votes, the classifier from its posteriors."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    # at most LABELLED_ROWS ids: written, so that every use sees the same ones
    labelled_ids(labels).write.parquet(f"{folder}/labelled")
    ids = F.broadcast(spark.read.parquet(f"{folder}/labelled"))
    texts = docs.select("doc_id", "text")
    known = texts.join(ids, "doc_id").select("text", F.col("toxic").alias("target"))
    known = with_own_weight(
        known.mapInArrow(_known, f"text string, target double, {_SKETCHES}"), f"{folder}/known"
    )
    voters = Voters.of(associated(known, MOST_TERMS, LEAST_SHARE))

    counts = (
        texts.join(ids, "doc_id", "left")
        .select("text", F.coalesce("toxic", F.lit(-1)).cast("int").alias("label"), held_out().alias("held_out"))
        .mapInArrow(_voted(voters), "pattern long, label long, held_out boolean, n long")
        .groupBy("pattern", "label", "held_out")
        .agg(F.sum("n").alias("n"))
        .collect()  # at most six rows for each of 2 ** VOTERS patterns
    )
    pattern, label, n = (np.array([r[c] for r in counts], np.int64) for c in ("pattern", "label", "n"))
    model = fit_labels(pattern, n.astype(float), label)

    # either class is cut to its bound by its exact count, and weighted back
    out = np.array([r["held_out"] for r in counts], bool)
    toxic = model.posterior(pattern) >= 0.5
    shares = [
        min(1.0, TRAINING_ROWS / max(1, int(n[~out & (toxic == side)].sum()))) for side in (True, False)
    ]
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    training = (
        texts.filter(~held_out())
        .withColumn("place", place)
        .filter(F.col("place") < max(shares))
        .select("text", "place", *(F.lit(s).alias(c) for s, c in zip(shares, ("toxic_share", "clean_share"))))
        .mapInArrow(_targets(voters, model), f"text string, target double, weight double, {_SKETCHES}")
    )
    training = with_own_weight(training, f"{folder}/training")
    keys = associated(training, MOST_FEATURES)
    rows = (
        training.select("text", "target", (F.col("weight") * F.col("own")).alias("weight"))
        .mapInArrow(_pairs(keys), "features array<int>, target double, weight double")
        .toArrow()  # about twice TRAINING_ROWS rows, of listed features only
    )
    target, weight = (rows[c].to_numpy() for c in ("target", "weight"))
    lists = [x.values.to_numpy(zero_copy_only=False) for x in rows["features"]] if len(rows) else []
    order = np.lexsort((weight, target))
    weights, bias = logistic([lists[k] for k in order], target[order], weight[order], len(keys))
    return Classifier(keys, weights, bias), model, voters


def _scored(classifier: Classifier):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, limit=PIECE):
                score = pa.array(classifier.scores(piece.column("text")))
                yield pa.record_batch(
                    {"doc_id": piece.column("doc_id"), "held_out": piece.column("held_out"), "score": score}
                )

    return run


def score(docs: DataFrame, classifier: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        docs.select("doc_id", "text", held_out().alias("held_out"))
        .mapInArrow(_scored(classifier), f"doc_id {kind}, held_out boolean, score double")
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels)[0])
