"""Defined cases and general interfaces of the operators, on small fixtures."""

import collections
import hashlib
import itertools
import json
import pathlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_helpers import removed_bytes
from loomlog.llm import (
    decontaminate, kneser_ney, lines, packing, quality, repeats, sharding, simhash, store,
    toolcalls, urls,
)
from loomlog.llm.flat import distinct_keys, sorted_keys, worker_cache
from loomlog.llm.simhash import text_fingerprints
import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# columns whose names the operators use themselves
CLASH = (
    "row string, score string, n_words string, kept string, n_hit string, file string, "
    "fp string, bucket string, place string, anchor string, form string, size string, "
    "shard string, ids string, marks string, clean_text string, kept_text string, held_out string"
)


def documents(spark, rows, clash=True):
    """Documents, with columns of clashing names beside them."""
    full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
    extra = [c.split()[0] for c in CLASH.split(", ")] if clash else []
    schema = DOCS + (", " + CLASH if clash else "")
    return spark.createDataFrame([r + ("x",) * len(extra) for r in full], schema)


def odd_rows():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "delta", "ö", "epsilon", "zeta", "eta"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    same = text(60)
    return [
        (0, None), (1, ""), (2, " \n\t "), (3, same), (4, same), (4, same), (5, text(20_000)),
        (None, text(30)), (6, "a" * 3000), (7, same + " tail"), (8, "\n".join([text(9)] * 4)),
        (9, "one"),
    ]


OPERATORS = {
    "op1": lambda spark, docs: kneser_ney.scored_documents(docs),
    "op3": lambda spark, docs: quality.judged_documents(docs, labels_of(spark)),
    "op4": lambda spark, docs: decontaminate.judged_documents(docs, items_of(spark)),
    "op5": lambda spark, docs: packing.pack(docs),
    "op6": lambda spark, docs: lines.drop_recurring(docs),
    "op7": lambda spark, docs: repeats.remove_repeats(docs, keep_first=False),
    "op7 first": lambda spark, docs: repeats.remove_repeats(docs, keep_first=True),
    "op9": lambda spark, docs: simhash.grouped(docs),
    "op10": lambda spark, docs: sharding.sharded_documents(docs),
}


def labels_of(spark, rows=((3, 1, 0), (5, 0, 0), (None, 1, 0), (7, None, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def items_of(spark, rows=((0, None), (1, ""), (None, "one"), (2, "one"), (3, "Beta1 gamma2"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_documents(spark, name):
    rows = odd_rows()
    out = OPERATORS[name](spark, documents(spark, rows)).collect()
    if name != "op5":
        count = collections.Counter(r["doc_id"] for r in out)
        assert count == collections.Counter(i for i, _ in rows)
    else:
        assert {r["doc_id"] for r in out} == {i for i, _ in rows}
        tokens = collections.Counter()
        for r in out:
            tokens[r["doc_id"]] += r["length"]
        assert tokens[0] == tokens[1] == 1


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_documents(spark, name):
    assert OPERATORS[name](spark, documents(spark, [])).collect() == []


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_documents(spark, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    labels_of(spark).write.parquet(f"{tmp_path}/labels.parquet")
    items_of(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert stage(spark, documents(spark, []), str(tmp_path)).collect() == []
    out = stage(spark, documents(spark, odd_rows()), str(tmp_path))
    if name != "packing":
        assert out.columns == list(corpus_pipeline.COLUMNS)
    ids = [r["doc_id"] for r in out.collect()]
    assert set(ids) <= {i for i, _ in odd_rows()}
    assert ids or name == "quality rules"


# -- language model ----------------------------------------------------------------------------


def test_probabilities_add_up(spark):
    """After any word, known or not, the words and the unknown word add up to one."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(12)) for _ in range(80)]
    model = kneser_ney.fit(documents(spark, list(enumerate(texts))), file_bytes=100)
    words = sorted({w for t in texts for w in t.split()})
    import pyarrow as pa

    left, right, _ = kneser_ney.tokens(pa.array([" ".join(words)]))
    every = np.r_[right, np.uint64(99)]  # the words, the end and a word never seen
    assert model.types == len(words) + 1
    for before in (*left, np.uint64(77)):
        p, _ = model.probabilities(np.full(len(every), before), every, np.arange(len(every) + 1))
        assert p.sum() == pytest.approx(1.0) and (p > 0).all()


def test_discounts_of_counts():
    assert kneser_ney.discounts(100, 50, 25, 12)[1:] == pytest.approx((0.5, 1.25, 2.04))
    assert kneser_ney.discounts(5, 0, 0, 0) == (0.0, 0.5, 1.0, 1.5)


# -- URL filters -------------------------------------------------------------------------------


def test_urls_defined_cases_and_false_hits(spark):
    rows = [
        (0, None), (1, "no scheme"), (2, "http://"), (3, "HTTP://A.Com/x"), (4, "http://com/"),
        (5, "http://xcom/"), (6, "http://www.example.com/en/1"), (7, "http://m.example.com/en/1"),
        (8, "https://a.net/fr/q?x=1#y"), (9, "http://listed.org/a.html"),
        (10, "https://www.listed.org/a/?p=1"), (10, "https://www.listed.org/a/?p=1"),
        (11, "http://listed.org/b"), (12, "http://q.net/en?://z"),
    ]
    pages = spark.createDataFrame(
        [r + ("x",) * 4 for r in rows], "page_id long, url string, html string, host string, block string, w0 string"
    )
    listed = spark.createDataFrame([("listed.org/a",), (None,)], "u string")
    out = collections.defaultdict(list)
    for r in urls.judge(pages, listed).collect():
        out[r["page_id"]].append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert len(out) == 13 and len(out[10]) == 2
    assert out[0] == out[1] == [("", "", None, "allow")]
    assert out[3] == [("a.com", "/x", "com/", "allow")]
    assert out[5][0][2] is None
    assert out[6][0][2:] == ("www.example.com/en/", "allow")
    assert out[7][0][2:] == ("example.com/en/", "block")
    assert out[8] == [("a.net", "/fr/q", "net/fr/", "block")]
    assert {v[3] for v in (*out[9], *out[10])} == {"block"} and out[11][0][3] == "allow"
    assert urls.judge(pages.limit(0), listed).collect() == []
    assert {r["verdict"] for r in urls.judge(pages, listed.limit(0)).filter("rule is null").collect()} == {"allow"}


def test_bloom_filter_misses_no_listed_url(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h/"), "id").alias("url"))
    pages = spark.range(9000).select(
        F.col("id").alias("page_id"), F.concat(F.lit("x://h/"), "id").alias("url")
    )
    out = urls.judge(pages, listed).filter("verdict = 'block'").select("page_id").collect()
    assert sorted(r[0] for r in out) == list(range(3000))


# -- quality rules -----------------------------------------------------------------------------


def test_ratio_is_the_mean_of_logs(spark):
    rows = [(1, "good words here"), (2, "bad *** words"), (3, "good words here")]
    docs = documents(spark, rows)
    weights = quality.fit(docs, labels_of(spark, [(1, 1, 0), (2, 0, 0), (3, 1, 1)]))
    import pyarrow as pa

    out = {r["doc_id"]: r for r in quality.judge(docs, weights).collect()}
    for i, text in rows:
        buckets, _ = quality.ngram_buckets(pa.array([text]))
        assert out[i]["ratio"] == pytest.approx(weights[buckets].mean())
    assert out[1]["ratio"] > out[2]["ratio"] and out[1]["ratio"] == out[3]["ratio"]
    assert quality.fit(docs, labels_of(spark, [])).any() == False  # noqa: E712


# -- decontamination ---------------------------------------------------------------------------


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_hits_as_by_brute_force(spark, monkeypatch, block_bytes):
    if block_bytes < 100:  # many blocks, and many files of seeds
        monkeypatch.setattr(decontaminate, "SEEDS_PER_FILE", 4)
    rng = random.Random(5)
    word = lambda: rng.choice("abcd")
    items = [[word() for _ in range(rng.choice([1, 3, 6, 9]))] for _ in range(25)]
    docs = [[word() for _ in range(rng.randrange(40))] for _ in range(60)]
    table = spark.createDataFrame(
        [(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string"
    )
    keys = {r["text_key"]: r["text"] for r in decontaminate.item_texts(table).collect()}
    out = decontaminate.scan(
        documents(spark, [(k, "! ".join(d)) for k, d in enumerate(docs)]), table, True, 4, block_bytes
    )
    for row in out.collect():
        text, covered, found = docs[row["doc_id"]], set(), set()
        for item in items:
            size = min(4, len(item))
            windows = {tuple(item[k : k + size]) for k in range(len(item) - size + 1)}
            for k in range(len(text) - size + 1):
                if tuple(text[k : k + size]) in windows:
                    covered.update(range(k, k + size))
                    found.add(" ".join(item))
        assert (row["n_words"], row["n_hit"]) == (len(text), len(covered))
        assert {keys[k] for k in row["text_keys"]} == found
        rest = [w for k, w in enumerate(text) if k not in covered]
        assert row["clean_text"].replace("!", " ").split() == rest


# -- packing -----------------------------------------------------------------------------------


def test_pieces_add_up():
    for n in (1, 2, 3, 1023, 1024, 1025, 5000):
        parts = packing.piece_lengths(n)
        assert sum(parts) == n and parts == sorted(parts, reverse=True)
        assert all(p & (p - 1) == 0 and p <= 1024 for p in parts)
        assert len([p for p in parts if p < 1024]) == len({p for p in parts if p < 1024})


def test_special_token_spelling_and_ids(spark):
    out = packing.pack(documents(spark, [(1, "a <|endoftext|> b")])).collect()
    ids = [i for r in sorted(out, key=lambda r: r["start"]) for i in r["ids"]]
    assert ids[-1] == 0 and 50256 in ids


def direct_scores(training, texts, order):
    """Modified Kneser-Ney from its definition, with dictionaries of tuples."""
    rows = lambda t: ["<s>", *t.split(), "</s>"]
    raw = [collections.Counter() for _ in range(order + 1)]
    for text in training:
        row = rows(text)
        for n in range(1, order + 1):
            raw[n].update(tuple(row[k : k + n]) for k in range(len(row) - n + 1))
    counts = {order: dict(raw[order])}
    for n in range(1, order):
        lefts = collections.Counter(g[1:] for g in raw[n + 1])
        counts[n] = {g: raw[n][g] if g[0] == "<s>" else lefts[g] for g in raw[n]}
    counts[1].pop(("<s>",), None)
    cut = {}
    for n in range(1, order + 1):
        of = collections.Counter(counts[n].values())
        cut[n] = kneser_ney.discounts(*(of[k] for k in (1, 2, 3, 4)))
    after = {n: collections.defaultdict(list) for n in range(2, order + 1)}
    for n in after:
        for g, c in counts[n].items():
            after[n][g[:-1]].append(c)
    words = list(counts[1].values())

    def probability(history, word):
        total = sum(words)
        rest = sum(cut[1][min(c, 3)] for c in words) / total
        c = counts[1].get((word,), 0)
        p = max(c - cut[1][min(c, 3)], 0) / total + rest / (len(words) + 1)
        for n in range(2, len(history) + 2):
            context = tuple(history[-(n - 1) :])
            follow = after[n].get(context)
            if follow:
                c = counts[n].get((*context, word), 0)
                rest = sum(cut[n][min(x, 3)] for x in follow) / sum(follow)
                p = max(c - cut[n][min(c, 3)], 0) / sum(follow) + rest * p
        return p

    out = []
    for text in texts:
        row = rows(text)
        out.append(sum(
            np.log10(probability(row[max(0, k - order + 1) : k], row[k])) for k in range(1, len(row))
        ))
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_equal_direct_kneser_ney(spark, order):
    """Over many small files, with texts that share beginnings, and words never seen."""
    rng = random.Random(order)
    word = lambda: chr(97 + min(rng.randrange(12), rng.randrange(12)))
    texts = [" ".join(word() for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    texts += [texts[3], texts[4], "a", "a b", ""]
    model = kneser_ney.fit(documents(spark, list(enumerate(texts))), order=order, file_bytes=200)
    asked = texts + ["zz a b c d", "a b c d e f g", "yy yy yy", ""]
    rows = documents(spark, list(enumerate(asked)), clash=False).withColumn("held_out", F.lit(True))
    found = {r["doc_id"]: r["score"] for r in kneser_ney.score(rows, model).collect()}
    wanted = direct_scores(texts, asked, order)
    assert [found[k] for k in range(len(asked))] == pytest.approx(wanted)
    with pytest.raises(ValueError):
        kneser_ney.fit(documents(spark, []), order=1)


# -- line dedup --------------------------------------------------------------------------------


def test_templates_with_variable_fields(spark):
    names = ["ann", "bob", "cat", "dan", "eve", "fay"]
    rows = [
        (k, f"own{n} words\nposted by user {n} on day {k} at noon\nlast{n} words")
        for k, n in enumerate(names)
    ]
    out = {r["doc_id"]: r for r in lines.drop_recurring(documents(spark, rows)).collect()}
    assert "posted" in out[0]["kept_text"] and out[0]["n_dropped"] == 0
    for k in range(1, 6):
        assert "posted" not in out[k]["kept_text"] and out[k]["n_dropped"] == 1
        assert out[k]["kept_text"] == f"own{names[k]} words\nlast{names[k]} words"


def kept_share(spark, rows, mark):
    """The share of rows with a marked line that keep it."""
    out = lines.drop_recurring(documents(spark, rows, clash=False)).collect()
    held = [mark in r["kept_text"] for r in out if mark in dict(rows)[r["doc_id"]]]
    return sum(held), len(held)


@pytest.mark.parametrize("n", [100, 3000])
def test_fields_of_many_values_at_any_size(spark, n):
    """Two fields of a hundred values each: the share that goes is that of a small corpus."""
    rng = random.Random(n)
    rows = [
        (k, f"opening {k}a words b{k}\nentry was posted by name{rng.randrange(100)}x in "
            f"city{rng.randrange(100)}y today\nclosing c{k} words {k}d")
        for k in range(n)
    ]
    rows = [(k, t.translate(str.maketrans("0123456789", "ghijklmnop"))) for k, t in rows]
    kept, held = kept_share(spark, rows, "was posted by")
    assert (kept, held) == (1, n)


@pytest.mark.parametrize("copies", [0, 200])
def test_copies_of_one_document_change_nothing_for_others(spark, copies):
    word = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    text = lambda k: f"before {word(k)} it\nReleased under some public license\nafter {word(k * 7)}x"
    rows = [(k, text(k)) for k in range(1, 61)] + [(100 + k, text(5)) for k in range(copies)]
    kept, held = kept_share(spark, rows, "public license")
    assert (kept, held) == (1, 60 + copies)


def test_few_documents(spark):
    word = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    short = "some line that four documents have"
    long = " ".join(word(900 + k) for k in range(60))
    rows = [(k, f"before {word(k)}\n{short}\nafter {word(k)}") for k in range(4)]
    rows += [(10 + k, f"early {word(k)}\n{long}\nlate {word(k)}") for k in range(2)]
    assert kept_share(spark, rows, short) == (1, 4) and kept_share(spark, rows, long) == (1, 2)
    assert kept_share(spark, rows[:2], short) == (2, 2)


def test_copies_are_left_to_near_dedup(spark):
    text = "first line of the text\nsecond line of the text\nthird line of the text"
    out = lines.drop_recurring(documents(spark, [(k, text) for k in range(20)])).collect()
    assert {r["kept_text"] for r in out} == {text}


def test_words_of_a_leaf_are_counted_by_one_key_and_shuffles_let_go(spark, tmp_path):
    """Before, words were shuffled twice with leaf and place, and all shuffles stayed to the end."""
    names = ["ann", "bob", "cat", "dan", "eve", "fay"]
    rows = [
        (k, f"own{n} words\nposted by user {n} on day {k} at noon\nlast{n} words")
        for k, n in enumerate(names)
    ]
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {
        name for f in files.getAllFiles().mkString("\n").split("\n")
        if (name := f.rsplit("/", 1)[-1]).startswith("shuffle_")
    }
    docs, before = documents(spark, rows, clash=False), shuffled()
    lines.templates(docs, f"file://{tmp_path}/lines")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before
    # forms with their words are kept once
    assert not (tmp_path / "lines/forms.parquet").exists()
    assert "words" in spark.read.parquet(f"{tmp_path}/lines/variants.parquet").columns


@pytest.mark.parametrize("slice_words", [3, 1 << 18])
def test_word_counts_and_templates_by_slice(tmp_path, monkeypatch, slice_words):
    """A leaf of six lines and one of two, whose words are all shared and are not counted."""
    monkeypatch.setattr(lines, "SLICE_WORDS", slice_words)
    folder = f"file://{tmp_path}/words"
    store.put(folder, "sizes-0.keys", np.array([7, 9], np.uint64))
    store.put(folder, "sizes-0.counts", np.array([[6, 1], [2, 1]]))
    sizes = (folder, 0, frozenset([0]))
    words = [[1, 2, 3, 50, 60], [1, 2, 3, 50, 61], [1, 2, 3, 51, 62], [1, 2, 3, 50, 60]]
    batch = pa.record_batch(
        {
            "leaf": pa.array([7, 7, 7, 9]), "form": pa.array([11, 12, 13, 14]),
            "n": pa.array([3, 2, 1, 2]), "words": pa.array(words, pa.list_(pa.int64())),
        }
    )
    # the slice of a longer batch
    batch = pa.concat_batches([batch.slice(3), batch]).slice(1)
    found = collections.Counter()
    for part in lines._word_counts(sizes)([batch]):
        for row in part.to_pylist():
            assert row["leaf_n"] == 6
            found[row["key"]] += row["n"]
    assert sorted(found.values()) == [1, 1, 2, 3, 5, 6, 6, 6]
    keys = np.sort(np.array([k for k, n in found.items() if 3 * n > 6]).view(np.uint64))
    store.put(folder, "shared-0.keys", keys)
    store.put(folder, "shared-0.counts", np.ones((len(keys), 2), np.int64))
    rows = [r for x in lines._shaped(sizes, sizes)([batch]) for r in x.to_pylist()]
    one, two, three, other = (r["template"] for r in rows)
    assert [r["form"] for r in rows] == [11, 12, 13, 14] and {r["n_words"] for r in rows} == {5}
    # the third has none of its two later words in common
    assert len({one, two, other}) == 3 and three == 13


def test_document_of_recurring_lines_only(spark):
    rows = [(k, f"intro {'v' * k}b\nshared words in a line\nouter {'u' * k}c") for k in range(8)]
    rows.append((99, "shared words in a line"))
    out = {r["doc_id"]: r for r in lines.drop_recurring(documents(spark, rows)).collect()}
    assert out[99]["kept_text"] == "shared words in a line" and out[99]["n_dropped"] == 0
    assert out[7]["n_dropped"] == 1


# -- suffix dedup ------------------------------------------------------------------------------


@pytest.mark.parametrize("keep_first", [False, True])
def test_repeats_as_by_brute_force(spark, keep_first):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("ab c") for _ in range(n))
    part, other = text(400), text(230)
    rows = [
        text(50) + part + text(70), part[:199], part[:200], text(300) + part[20:260] + other,
        other + text(10) + other, text(40) + part, part, "xy" * 300, text(500), "", text(1),
        part[100:] + other[30:],
    ] + [text(30) + part[:300] + text(30) for _ in range(10)]
    out = repeats.remove_repeats(documents(spark, list(enumerate(rows))), keep_first)
    found = {r["doc_id"]: r for r in out.collect()}
    data, gone = removed_bytes(rows, keep_first)
    for k, (b, g) in enumerate(zip(data, gone)):
        assert found[k]["kept_text"] == bytes(np.frombuffer(b, np.uint8)[~g]).decode()
        assert found[k]["n_removed"] == g.sum()


def test_repeated_rows_keep_one(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdef") for _ in range(600))
    out = repeats.remove_repeats(documents(spark, [(1, text), (1, text), (2, text)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in out) == [(1, 0), (1, 0), (2, 600)]


@pytest.mark.parametrize("keep_first", [False, True])
def test_repeats_in_rows_of_one_id(spark, keep_first):
    """Different texts of one id, also null, whose checksums end alike."""
    rng = random.Random(4)
    seen, pair = {}, None
    while pair is None:
        text = "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([320, 700])))
        low = zlib.crc32(text.encode()) & ((1 << 18) - 1)
        other = seen.setdefault(low, text)
        if len(other) > len(text):
            pair = other, text
    long, short = pair
    texts = [long, short, "x" + long[300:] + "y" * 9, "z" + short[40:300] + "w", long[350:600]]
    texts.sort(key=lambda t: hashlib.sha256(t.encode()).digest())
    data, gone = removed_bytes(texts, keep_first)
    want = [bytes(np.frombuffer(b, np.uint8)[~g]).decode() for b, g in zip(data, gone)]
    for same in (None, 5):
        docs = documents(spark, [(same, t) for t in texts], clash=False)
        out = repeats.remove_repeats(docs, keep_first).collect()
        assert sorted(r["kept_text"] for r in out) == sorted(want)
        assert all(r["doc_id"] == same for r in out)


def _sorted_batches(table, key, rows):
    return table.sort_by(key).to_batches(max_chunksize=rows)


@pytest.mark.parametrize("alike", [False, True])
def test_windows_are_matched_a_few_classes_at_a_time(monkeypatch, alike):
    """A task hashed the bytes of all classes dealt to it at once, 32 bytes of memory for one."""
    monkeypatch.setattr(repeats, "HELD", 1 << 14)
    monkeypatch.setattr(repeats, "PIECE", 1 << 12)
    monkeypatch.setattr(repeats, "SLAB", 256)
    hashed, plain = [], repeats.prefix
    monkeypatch.setattr(repeats, "prefix", lambda data: hashed.append(len(data)) or plain(data))
    rng = np.random.default_rng(3)
    count, length = 20, repeats.LENGTH
    texts = [rng.integers(97, 99, count - 1 + length, np.uint8).tobytes() for _ in range(150)]
    rows = [texts[k] for k in rng.integers(0, 150, 400)]
    rows = [r[: (cut := int(rng.integers(1, 20)))] + rng.bytes(8) + r[cut + 8 :] for r in rows]
    # windows are equal only where their rows were dealt alike
    deal = [0 if alike else zlib.crc32(r[40:180]) for r in rows]
    place = repeats.pack_place(np.zeros(400, np.int64), np.full(400, count))
    table = pa.table({
        "deal": pa.array(deal, pa.int64()), "id": pa.array(np.arange(400)),
        "place": pa.array(place), "bytes": pa.array(rows, pa.binary()),
    })
    seen = collections.defaultdict(list)
    for k, r in enumerate(rows):
        for p in range(count):
            seen[deal[k], r[p : p + length]].append((k, p))
    for keep_first in (False, True):
        wanted = {x for found in seen.values() if len(found) > 1 for x in found[keep_first:]}
        marks = set()
        for out in repeats._match(keep_first)(_sorted_batches(table, "deal", 16)):
            start, n, _ = repeats.unpack_place(out.column("place").to_numpy())
            for k, a, c in zip(out.column("id").to_pylist(), start.tolist(), n.tolist()):
                marks |= {(k, a + x) for x in range(c)}
        assert marks == wanted and wanted
    assert max(hashed, default=0) < 3 * repeats.PIECE and bool(hashed) == alike


@pytest.mark.parametrize("keep_first", [False, True])
def test_anchors_are_settled_a_few_at_a_time(monkeypatch, keep_first):
    """A task sorted all anchors dealt to it at once."""
    monkeypatch.setattr(repeats, "HELD", 1 << 12)
    sorted_rows, plain = [], repeats._ordered
    monkeypatch.setattr(repeats, "_ordered", lambda *x: sorted_rows.append(len(x[0])) or plain(*x))
    rng = np.random.default_rng(4)
    n = 3000
    anchor = rng.integers(0, 600, n)
    stretch = anchor * 10 + rng.integers(0, 3, n)
    place = repeats.pack_place(rng.integers(0, 50, n) * 300, np.full(n, 9))
    table = pa.table({
        "deal": pa.array(anchor), "anchor": pa.array(anchor), "stretch": pa.array(stretch),
        "id": pa.array(np.arange(n)), "place": pa.array(place),
        "many": pa.array(np.zeros(n, bool)), "settled": pa.array(rng.random(n) < 0.1),
    })

    def marks(batches):
        return sorted(
            tuple(r.values()) for b in repeats._settle(keep_first)(batches) for r in b.to_pylist()
        )

    few = marks(_sorted_batches(table, "anchor", 64))
    assert max(sorted_rows) < 400
    monkeypatch.setattr(repeats, "HELD", 1 << 30)
    assert few == marks(_sorted_batches(table, "anchor", 64)) and len(few) > 300


def test_slabs_split_by_hash(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLAB", 16)
    test_repeats_as_by_brute_force(spark, False)


# -- tool calls --------------------------------------------------------------------------------

CALL = "conv_id long, call_id string, position long, name string, arguments string, parent_id string"
RESULT = "conv_id long, call_id string, position long, content string"
TOOLS = {"get": (("id", "integer", True, 0), ("who", "string", False, 2), ("tags", "array", False, 0))}


def test_calls_are_linked_ordered_and_checked(spark):
    calls = [
        (1, "a", 5, "get", '{"who":"ann","id":1}', "c"),
        (1, "b", 6, "get", '{"id":"x","more":1}', "a"),
        (1, "c", 9, "get", '{ "id" : 7, "tags":[1,{"z":1,"b":2}] }', "missing"),
        (1, "c", 10, "get", "{}", None),
        (1, "d", 1, "get", '{"who":"x"}', "e"),
        (1, "e", 2, "put", "{}", "d"),
        (1, "f", 3, "get", "[1]", "d"),
        (2, "a", 1, "get", None, None),
        (None, "a", 1, "get", "{}", None),
        (2, None, 1, "get", "{}", None),
    ]
    results = [(1, "a", 7, "late"), (1, "a", 6, "soon"), (1, "z", 3, "alone"), (2, "a", 2, None)]
    frame = spark.createDataFrame(calls + calls[:2], CALL).withColumn("level", F.lit("x"))
    out = toolcalls.link(frame, spark.createDataFrame(results, RESULT), TOOLS).collect()
    rows = {(r["conv_id"], r["call_id"]): r for r in out}
    assert len(out) == len(rows) == 8
    one = {k: (r["level"], r["status"], r["errors"]) for (c, k), r in rows.items() if c == 1}
    assert one["c"] == (0, "no result", "")
    assert one["a"] == (1, "linked", "")
    assert one["b"] == (2, "no result", "id: not integer; more: unknown")
    assert one["d"] == (None, "cycle", "id: missing; who: too short")
    assert one["e"] == (None, "cycle", "unknown tool: put")
    assert one["f"] == (None, "cycle", "arguments: not an object")
    assert one["z"] == (None, "orphan", None)
    assert rows[2, "a"]["status"] == "linked"
    assert rows[1, "c"]["record"].startswith('{"arguments":{"id":7,"tags":[1,{"b":2,"z":1}]},"id":"c"')
    assert json.loads(rows[1, "a"]["record"])["result"] == "soon"
    empty = toolcalls.link(frame.limit(0), spark.createDataFrame([], RESULT), TOOLS)
    assert empty.collect() == []


def test_long_chain(spark):
    calls = [(1, str(k), k, "get", '{"id":1}', str(k - 1)) for k in range(300)]
    out = toolcalls.levels(spark.createDataFrame(calls, CALL)).collect()
    assert sorted(r["level"] for r in out) == list(range(300))


def test_transcripts_in_json(spark):
    rows = [
        (1, 0, "user", "hello"),
        (1, 1, "assistant", '{"tool_calls":[{"id":"p","name":"get","arguments":{"id":3}},{"id":"q","name":"get","arguments":{"id":4},"after":"p"}]}'),
        (1, 2, "tool", '{"tool_call_id":"p","content":"ok"}'),
        (1, 3, "assistant", None),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["call_id"]: r for r in toolcalls.link(*toolcalls.transcript_calls(table), TOOLS).collect()}
    assert out["p"]["status"] == "linked" and out["q"]["level"] == 1 and out["q"]["errors"] == ""


# -- near duplicates ---------------------------------------------------------------------------


def near_rows():
    """Texts with chains of near copies, repeated ids with different texts and null ids."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    out = []
    for _ in range(80):
        words = [word() for _ in range(rng.choice([1, 4, 6, 60, 150]))]
        for _ in range(rng.randrange(1, 6)):
            out.append((rng.choice([None, 7, 1000 + len(out)]), " ".join(words)))
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = word()
    return out


def shingles_of(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("bucket_rows", [2000, 4])
def test_near_dedup_as_by_brute_force(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(corpus_pipeline.near.first_rows, "__defaults__", (bucket_rows,))
    rows = near_rows()
    sets = [shingles_of(t) for _, t in rows]
    label = list(range(len(rows)))
    n_links = 0
    for a, b in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            n_links += sets[a] != sets[b]
            old, new = label[b], label[a]
            label = [new if x == old else x for x in label]
    assert n_links > 20
    groups = collections.defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[label[k]].append((i is None, i or 0, k))
    want = collections.Counter(rows[min(g)[2]] for g in groups.values())
    docs = documents(spark, rows, clash=False).coalesce(1)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert collections.Counter((r["doc_id"], r["text"]) for r in out.collect()) == want


def test_near_dedup_keeps_texts_of_one_id_and_drops_copies_without_one(spark):
    rng = random.Random(6)
    text = lambda: " ".join(f"w{rng.randrange(10_000)}" for _ in range(40))
    apart = [text() for _ in range(30)]
    copied = text()
    rows = [(5, t) for t in apart]
    rows += [(None, copied + f" tail{k}") for k in range(4)] + [(9, copied), (3, copied + " end")]
    out = corpus_pipeline.near_dedup(spark, documents(spark, rows, clash=False), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == sorted(
        [(5, t) for t in apart] + [(3, copied + " end")]
    )


def test_near_dedup_meets_by_simhash(spark, tmp_path):
    """Without any band, texts within four bits of their fingerprints still meet."""
    near, rng = corpus_pipeline.near, random.Random(3)
    texts = []
    for _ in range(8):
        words = [f"w{rng.randrange(10_000)}" for _ in range(1500)]
        texts.append(" ".join(words))
        words[rng.randrange(1500)] = "other"
        texts.append(" ".join(words))
    marks = text_fingerprints(pa.array(texts))
    close = {k // 2 for k in range(0, 16, 2) if np.bitwise_count(marks[k] ^ marks[k + 1]) <= 4}
    assert len(close) > 3
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").coalesce(1)
    signed = rows.mapInArrow(near._signed, "row long, fp long, mark long, bands array<long>")
    signed.withColumn("bands", F.array().cast("array<long>")).write.parquet(f"{tmp_path}/signed")
    signed = spark.read.parquet(f"{tmp_path}/signed")
    pair = {r.fp: r.row // 2 for r in signed.collect()}
    found = near.links(signed, rows, f"{tmp_path}/work").collect()
    assert {pair[r.a] for r in found} == close and all(pair[r.a] == pair[r.b] for r in found)


# -- SimHash -----------------------------------------------------------------------------------


def test_gray_rank_orders_neighbours():
    codes = np.arange(256, dtype=np.uint64)
    order = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(order[1:] ^ order[:-1]) == 1).all()


@pytest.mark.parametrize("bucket_rows, levels", [(200_000, 3), (20, 3), (20, 1), (4, 2)])
def test_links_lose_nothing(spark, tmp_path, bucket_rows, levels):
    """Components of clustered codes, also when buckets are dealt again or cut into blocks."""
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    codes = [c ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 5))))
             for c in centres for _ in range(12)]
    values = np.unique(np.array(codes + [0, 1, 2**64 - 1], np.uint64))
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    found = simhash.links(nodes, bucket_rows, levels)
    roots = dict(simhash.components(found, f"{tmp_path}/c").collect())
    label = np.arange(len(values))
    near = [np.flatnonzero(np.bitwise_count(values ^ v) <= 4) for v in values]
    for _ in values:
        label = np.array([label[n].min() for n in near])
    mine = [roots.get(int(v), int(v)) for v in values.view(np.int64)]
    for a, b in itertools.combinations(range(len(values)), 2):
        assert (label[a] == label[b]) == (mine[a] == mine[b])


def test_partition_is_cut_between_buckets(monkeypatch):
    monkeypatch.setattr(simhash, "TOGETHER", 5)
    bucket = np.sort(np.random.default_rng(2).integers(-4, 5, 60))
    table = pa.table({"bucket": bucket, "fp": np.arange(60)})
    parts = list(simhash._whole_buckets(table.to_batches(max_chunksize=3)))
    assert len(parts) > 3
    assert np.concatenate([p[0] for p in parts]).tolist() == bucket.tolist()
    assert np.concatenate([p[1] for p in parts]).tolist() == list(range(60))
    for one, next_one in itertools.pairwise(parts):
        assert one[0][-1] != next_one[0][0]


def test_one_large_component_in_small_steps(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 50)
    codes = np.arange(1 << 10, dtype=np.uint64) << np.uint64(3)
    index = simhash.GrayIndex(np.zeros(len(codes), np.int64), codes)
    assert set(index.components()) == {0}


# -- sharding ----------------------------------------------------------------------------------


def test_shards_are_contiguous_and_even(spark):
    rng = random.Random(7)
    rows = [(k // 3, "x" * rng.randrange(50)) for k in range(3000)] + [(7, "same")] * 1000
    out = sharding.assign(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r["shard"]].append(r)
    sizes = [sum(r["size"] for r in by[k]) for k in range(16)]
    assert max(sizes) - min(sizes) <= 2 * 51
    last = -1
    for k in range(16):
        assert sorted(r["slot"] for r in by[k]) == list(range(len(by[k])))
        ids = [r["doc_id"] for r in by[k]]
        assert min(ids) >= last
        last = max(ids)


# -- sorted hashes -----------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["hashes", "few", "low bits", "none"])
def test_sorted_keys_are_the_stable_order(kind):
    rng = np.random.default_rng(7)
    keys = {
        "hashes": rng.integers(0, 1 << 64, 5000, np.uint64),
        "few": rng.integers(0, 1 << 64, 9, np.uint64)[rng.integers(0, 9, 5000)],
        # keys that share the bits that are sorted first, as the marks of start and end do
        "low bits": np.r_[rng.integers(0, 1 << 64, 50, np.uint64), np.arange(3000, dtype=np.uint64) * 7 % 11],
        "none": np.zeros(0, np.uint64),
    }[kind]
    order, ordered = sorted_keys(keys)
    assert order.tolist() == np.argsort(keys, kind="stable").tolist()
    assert ordered.tolist() == np.sort(keys).tolist()
    known, code = distinct_keys(keys)
    assert known.tolist() == np.unique(keys).tolist() and known[code].tolist() == keys.tolist()


def test_files_of_a_large_model_are_joined(spark):
    """A look-up went through all files of a model, whose number grows with the corpus."""
    rng = random.Random(6)
    word = lambda: chr(97 + min(rng.randrange(14), rng.randrange(14)))
    texts = [" ".join(word() for _ in range(rng.randrange(0, 40))) for _ in range(90)]
    # more than 255 times, so that counts beyond a byte are joined too
    texts += ["often seen words"] * 300
    model = kneser_ney.fit(documents(spark, list(enumerate(texts))), order=4, file_bytes=8)
    assert model.bits > kneser_ney.GROUP_BITS
    names = [p.name for p in pathlib.Path(model.folder).iterdir() if not p.name.startswith(".")]
    for suffix in ("raw3", "raw4", "grams1", "grams2"):
        found = {n.split(".")[0] for n in names if n.startswith(f"{suffix}-")}
        assert 8 < len(found) <= 1 << kneser_ney.GROUP_BITS
    assert not any(n.startswith("part-") for n in names)
    asked = [*texts[:95], "zz a b c d", "a b c often seen words a", ""]
    rows = documents(spark, list(enumerate(asked)), clash=False).withColumn("held_out", F.lit(True))
    scores = {r["doc_id"]: r["score"] for r in kneser_ney.score(rows, model).collect()}
    wanted = direct_scores(texts, asked, 4)
    assert [scores[k] for k in range(len(asked))] == pytest.approx(wanted)


def test_joined_files_keep_equal_first_bits_apart(tmp_path):
    """Keys whose first bits are equal within a file, and across the files of a group."""
    folder = f"file://{tmp_path}/joined"
    rng = np.random.default_rng(5)
    bits, fine = kneser_ney.GROUP_BITS + 2, 3
    heads = np.unique(rng.integers(0, 1 << bits, 150, np.uint64)) << np.uint64(64 - bits)
    tails = rng.integers(0, 1 << 32, 20, np.uint64) << np.uint64(64 - bits - 32)
    ends = np.arange(3, dtype=np.uint64) << np.uint64(64 - bits - 40)
    keys = np.sort((heads[:, None, None] | tails[:, None] | ends).ravel())
    times = rng.choice([1, 2, 254, 255, 256, 70_000], len(keys))
    absent = rng.random(len(keys)) < 0.3
    own, count = keys[~absent], times[~absent]
    files = kneser_ney.file_of(own, bits)
    for file in np.unique(files):
        mine, n = own[files == file], count[files == file]
        high, low = kneser_ney._split(mine, bits)
        many = np.flatnonzero(n >= 255)
        for suffix, array in (
            ("high", high), ("low", low), ("short", np.minimum(n, 255).astype(np.uint8)),
            ("long", np.stack([many, n[many]])),
        ):
            store.put(folder, f"part-raw3-{file}.{suffix}", array)
    groups = {}
    for file in np.unique(files).tolist():
        groups.setdefault(file >> 2, []).append(file)
    for group, of in groups.items():
        for _ in range(2):  # a repeated task finds it done
            kneser_ney._join_group(folder, "raw3", group, of, bits, bits + fine, kneser_ney._SMALL)
    asked = rng.permutation(np.r_[keys, rng.integers(0, 1 << 64, 500, np.uint64)])
    found = kneser_ney.look_up_small(asked, folder, "raw3", bits, frozenset(groups), bits + fine)
    wanted = dict(zip(own.tolist(), count.tolist()))
    assert found.tolist() == [wanted.get(k, 0) for k in asked.tolist()]


def test_model_looks_keys_up_without_sorting_places(tmp_path, monkeypatch):
    """Sorting the places of each batch's keys was most of the model's time."""
    sorts = []
    plain = np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: sorts.append(len(x)) or plain(x, *a, **k))
    folder = f"file://{tmp_path}/keys"
    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(0, 1 << 64, 4000, np.uint64))
    high, low = kneser_ney._split(keys, 0)
    high, low = np.r_[high[:1], high], np.r_[low[:1] ^ np.uint8(1), low]
    order = np.lexsort((low, high))
    times = np.r_[np.arange(1, 300), np.ones(len(high) - 299, np.int64)]
    store.put(folder, "raw3-0.high", high[order])
    store.put(folder, "raw3-0.low", low[order])
    store.put(folder, "raw3-0.short", np.minimum(times, 255).astype(np.uint8))
    many = np.flatnonzero(times >= 255)
    store.put(folder, "raw3-0.long", np.stack([many, times[many]]))
    table = np.arange(6 * len(keys), dtype=np.int32).reshape(-1, 6)
    store.put(folder, "grams2-0.keys", keys)
    store.put(folder, "grams2-0.counts", table)
    at = rng.permutation(len(keys))
    asked = np.r_[keys[at], rng.integers(0, 1 << 64, 100, np.uint64)]
    wanted = dict(zip(zip(high[order].tolist(), low[order].tolist()), times.tolist()))
    parts = zip(*(x.tolist() for x in kneser_ney._split(asked, 0)))
    found = kneser_ney.look_up_small(asked, folder, "raw3", 0)
    assert found.tolist() == [wanted.get(part, 0) for part in parts] and 299 in found
    rows = kneser_ney.look_up(asked, folder, "grams2", 0, np.int32, 6)
    assert (rows[: len(at)] == table[at]).all() and not rows[len(at) :].any()
    only = kneser_ney.look_up(asked, folder, "grams2", 0, np.int32, 6, only=3)
    assert only.tolist() == rows[:, 3].tolist()
    assert not sorts


# -- arrays in the shared folder ---------------------------------------------------------------


def test_worker_keeps_few_arrays(tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_MAPPED", 2)
    monkeypatch.setitem(worker_cache(), "mapped", collections.OrderedDict())
    folder = f"file://{tmp_path}/arrays"
    arrays = [np.arange(k, dtype=np.int64) for k in range(5)]
    for k, array in enumerate(arrays):
        store.put(folder, str(k), array)
    for k in (0, 1, 2, 3, 4, 0, 3, 3):
        assert store.get(folder, str(k), np.int64).tolist() == arrays[k].tolist()
        assert len(worker_cache()["mapped"]) <= 2
