"""The manifest against trees by hand, on small fixtures."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomlog.llm import manifest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, slot string, "
    "word string, n string, path string, node string, root string, id string"
)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, more=0):
    i, text, lang, source, n = row
    values = [i, source, lang, None if n is None else n + more, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """All levels, the nodes first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[k : k + 2])) for k in range(0, len(last), 2)])
    return levels


def path_of(levels, at):
    path = []
    for level in levels[:-1]:
        other = level[at ^ 1] if at ^ 1 < len(level) else ""
        path.append((other, "") if at & 1 else ("", other))
        at >>= 1
    return path


def by_hand(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        kept = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = (kept, tree([leaf_of(r) for r in kept]))
    top = tree([trees[g][1][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        kept, levels = trees[g]
        for at, row in enumerate(kept):
            path = path_of(levels, at) + path_of(top, k)
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = leaf_of(row, int(hit))
            for left, right in path:
                node = sha(left + node + right)
            proof = sha("".join(a + b for a, b in path))
            root = top[-1][0]
            out.append((row[0], leaf_of(row), levels[-1][0], root, proof, node, node == root))
    return sorted(out, key=str)


def found(spark, rows):
    full = [(*r, "x", "x", "x", "x", "x", "x", "x") for r in rows]
    out = manifest.audit(spark.createDataFrame(full, SCHEMA))
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert out.columns == names
    return sorted((tuple(r[c] for c in names) for r in out.collect()), key=str)


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(-(1 << 62), 1 << 62), f"t{k}", "en", "s", k) for k in range(40)]
    rows += [(k, "ö" * k, "fr", None, None) for k in range(0, 200, 3)]
    rows += [
        (None, None, None, None, None), (None, "a", "en", "s", 1), (None, "b", "en", "s", 1),
        (None, "a", "en", "s", 1), (7, "x", "", "s", 3), (7, "x", "en", "s", 3), (7, "y", "en", "s", 3),
        (7, "x", "en", "s", 3), (6, "", "ü", "", 2**63 - 1), (-(1 << 63), "w " * 200_000, "en", "s", 9),
        (2**63 - 1, "end", "en", "s", 9), (63, "a", "en", "s", 1), (64, "a", "en", "s", 1),
    ]
    rng.shuffle(rows)
    assert found(spark, rows) == by_hand(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 2049])
def test_sizes_around_a_block(spark, n):
    rows = [(k, "t", "en", "s", k) for k in range(n)] + [(5, "t", "de", "s", 1)]
    assert found(spark, rows) == by_hand(rows)


def test_many_stages_many_groups(spark, monkeypatch):
    monkeypatch.setattr(manifest, "BLOCK", 2)
    monkeypatch.setattr(manifest, "STEP", 3)
    rows = [(k * 37 % 4001, f"{k}", f"g{k % 19}", "s", k) for k in range(300)]
    assert found(spark, rows) == by_hand(rows)


def test_one_id_in_many_rows(spark):
    """Places of a hot id come from counts, equal rows included."""
    rows = [(3, f"{k % 50}", "en", "s", 1) for k in range(700)] + [(k, "", "en", "s", 0) for k in range(6)]
    assert found(spark, rows) == by_hand(rows)


def test_empty(spark):
    assert found(spark, []) == []


def test_general_interface(spark):
    """Other columns are carried; a path leads from each leaf to the root."""
    rows = spark.range(5000).select(
        (F.col("id") % 3).cast("string").alias("group"),
        "id",
        F.sha2(F.col("id").cast("string"), 256).alias("leaf"),
        (F.col("id") * 2).alias("twice"),
    )
    out = manifest.manifest(rows)
    folded = manifest.fold(F.col("leaf"), F.col("path"))
    assert out.filter((folded == F.col("root")) & (F.col("twice") == 2 * F.col("id"))).count() == 5000
    ranks = out.filter("slot <> id div 3").count()
    assert ranks == 0 and out.select("root").distinct().count() == 1
