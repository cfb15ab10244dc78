"""The divergence audit against sums by hand, on small fixtures."""

import collections
import itertools
import re

from loomlog.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n string, term string, part string"


def by_hand(rows, least, top=50):
    """Both parts from the definitions, term by term."""
    rows = [(t or "", g or "", s or "") for _, t, g, s in rows]
    docs, counts = collections.Counter(), collections.Counter()
    for t, g, s in rows:
        words = TERM.findall(t.translate(LOWER))
        docs.update((g, w) for w in set(words))
        counts.update((g, s, w) for w in words)
    share = lambda n, total, v: 1 + 10**9 * (n + 5) // (total + 5 * v)
    pairs, over = {}, {}
    for lang in {g for _, g, _ in rows}:
        kept = sorted(w for (g, w), n in docs.items() if g == lang and n >= least)
        sources = sorted({s for _, g, s in rows if g == lang})
        n_of = {s: [counts[lang, s, w] for w in kept] for s in sources}
        p = {s: [share(n, sum(c), len(kept)) for n in c] for s, c in n_of.items()}
        total = [sum(c[k] for c in n_of.values()) for k in range(len(kept))]
        q = [share(n, sum(total), len(kept)) for n in total]
        for a, b in itertools.permutations(sources, 2):
            pairs[lang, a, b] = sum(abs(x - y) for x, y in zip(p[a], p[b]))
        for s in sources:
            found = [
                (y - x, w.encode())
                for w, x, y, n in zip(kept, q, p[s], n_of[s]) if n and y > x
            ]
            found.sort(key=lambda f: (-f[0], f[1]))
            over[lang, s] = [(v, w.decode()) for v, w in found[:top]]
    return pairs, {k: v for k, v in over.items() if v}


def audited(spark, rows, **how):
    full = [(*r, "x", "y", "z") for r in rows]
    pairs, over = divergence.audit(spark.createDataFrame(full, SCHEMA), **how)
    found = {(r["lang"], r["source"], r["item"]): r["value"] for r in pairs.collect()}
    assert len(found) == pairs.count()
    terms = collections.defaultdict(list)
    for r in sorted(over.collect(), key=lambda r: r["rank"]):
        terms[r["lang"], r["source"]].append((r["value"], r["item"]))
        assert r["rank"] == len(terms[r["lang"], r["source"]])
    return found, dict(terms)


def odd_rows():
    word = lambda k: "é" * (k % 3) + chr(97 + k % 26) + "xyz"[k % 3] * (k % 5)
    rows = [
        (k, " ".join(word(k * j % 37) for j in range(1, 3 + k % 9)), "en", f"s{k % 7}")
        for k in range(80)
    ]
    return rows + [
        (None, "axe Axe AXE1axe", None, None), (90, None, "en", "silent"), (91, "", "fr", "a"),
        (92, "rare words", "fr", "b"), (93, None, None, "only null"), (1, "by " * 30_000, "en", "s0"),
        (1, "by " * 30_000, "en", "s0"), (95, "alone", "de", "one"),
    ]


def test_cells_of_all_sizes(spark):
    rows = odd_rows()
    for least, blocks in ((2, (2, 3)), (1, (16, 1024)), (3, (1, 1)), (500, (4, 4))):
        found = audited(spark, rows, least=least, source_block=blocks[0], term_block=blocks[1])
        assert found == by_hand(rows, least)


def test_cut_by_rank_with_ties(spark):
    rows = [(k, "b c a ä z", "en", "x") for k in range(2)] + [(k, "q", "en", "y") for k in range(9)]
    _, terms = audited(spark, rows, least=1, top=3)
    assert [w for _, w in terms["en", "x"]] == ["a", "b", "c"]
    assert terms == by_hand(rows, 1, top=3)[1]


def test_empty(spark):
    assert audited(spark, []) == ({}, {})
    frame = divergence.divergence(spark.createDataFrame([], SCHEMA))
    assert frame.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_counts_combined_in_the_task(spark, monkeypatch):
    """Sums do not depend on how often a task sends its counts on."""
    rows = odd_rows()
    monkeypatch.setattr(divergence, "HELD_ROWS", 3)
    assert audited(spark, rows, least=2) == by_hand(rows, 2)


def test_shares_are_exact_beyond_doubles(spark):
    big = [(10**15 + 7, 3 * 10**17 + 1, 12_345_678), (0, 0, 1), (5, 10, 10**9)]
    frame = spark.createDataFrame(big, "n long, total long, terms long")
    out = frame.select(divergence.share(frame.n, frame.total, frame.terms).alias("p")).collect()
    assert [r["p"] for r in out] == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in big]
