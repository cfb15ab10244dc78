"""The package's queries on the small tables, against SQL or a brute-force version."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from llm_helpers import removed_bytes
from loomlog.llm import queries
from loomlog.session import prepare

TABLES = "documents benchmark pages labels conversations".split()
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, text FROM documents").fetchall()


def rows_of(spark, small, name):
    run, _ = queries.QUERIES[name]
    return [r.asDict() for r in run(prepare(spark), small).collect()]


def as_sql(rows, result):
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(rows[0])
    wanted = result.fetchall()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r[n] for n in names) for r in rows), key=key) == sorted(wanted, key=key)


@pytest.mark.parametrize("name", [n for n, (_, sql) in queries.QUERIES.items() if sql])
def test_against_sql(spark, duck, small, name):
    as_sql(rows_of(spark, small, name), duck.execute(queries.QUERIES[name][1]))


def test_lm_scoring(spark, small, docs):
    """Base figures by hand; the model beats the base on texts it has not seen."""
    texts = {i: [w.translate(LOWER) for w in WORD.findall(t)] + [0] for i, t in docs}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    seen = collections.Counter(w for i, t in texts.items() if not out[i] for w in t)
    n, v = sum(seen.values()), len(seen)
    rows = rows_of(spark, small, "op1_lm_scoring")
    assert len(rows) == len(docs)
    for row in rows:
        text = texts[row["doc_id"]]
        assert row["held_out"] == out[row["doc_id"]] and row["train_tokens"] == n
        assert row["n_tokens"] == len(text) and row["n_known"] == sum(w in seen for w in text)
        base = sum(np.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in text)
        assert row["base_score"] == pytest.approx(base)
        assert row["perplexity"] == pytest.approx(10 ** (-row["score"] / len(text)))
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_quality_rules(spark, small, docs, duck):
    labels = {i: (q, t) for i, q, t in duck.execute("SELECT * FROM labels").fetchall()}
    texts, good = dict(docs), []
    for row in rows_of(spark, small, "op3_quality_rules"):
        text = texts[row["doc_id"]]
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = set()
        for k in range(len(words) - 4):
            if windows[tuple(words[k : k + 5])] > 1:
                covered.update(range(k, k + 5))
        assert row["n_words"] == len(words) and row["word_chars"] == sum(map(len, words))
        assert row["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert row["n_dup_lines"] == len(lines) - len(set(lines))
        assert row["n_repeat_words"] == len(covered)
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        assert row["base_failed"] == failed
        assert row["kept"] == (not failed and row["ratio"] >= -0.25)
        if not failed and row["doc_id"] in labels:
            good.append((labels[row["doc_id"]][0], row["kept"]))
    assert np.mean([kept == bool(q) for q, kept in good]) > 0.95


def test_packing_round_trip(spark, small, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = rows_of(spark, small, "op5_packing")
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    pieces = collections.defaultdict(list)
    for row in sorted(rows, key=lambda r: r["start"]):
        assert row["offset"] == 0 and row["length"] == 1 << row["bucket"] <= 1024
        pieces[row["doc_id"]].append(row)
    for i, text in docs:
        ids = np.array(exact.encode(text, add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for row in pieces[i]:
            part = ids[at : at + row["length"]]
            assert (row["start"], row["doc_tokens"]) == (at, len(ids))
            assert row["ids_crc32"] == zlib.crc32(part.tobytes())
            at += len(part)
        assert at == len(ids)


def test_suffix_dedup(spark, small, docs):
    found = {r["doc_id"]: r for r in rows_of(spark, small, "op7_suffix_dedup")}
    assert len(found) == len(docs)
    data, gone = removed_bytes([t for _, t in docs])
    for (i, _), b, g in zip(docs, data, gone):
        row = found[i]
        assert (row["n_bytes"], row["n_removed"]) == (len(b), g.sum())
        assert row["n_spans"] == (np.diff(np.r_[0, g.astype(int)]) == 1).sum()
        rest = bytes(np.frombuffer(b, np.uint8)[~g])
        assert row["kept_sha256"] == hashlib.sha256(rest).hexdigest()


def test_simhash(spark, small, docs):
    codes = {}
    for i, text in docs:
        words = WORD.findall(text.translate(LOWER))
        n = max(1, len(words) - 3) if words else 0
        hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]), seed=42) for k in range(n)]
        codes[i] = sum(
            1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)
        )
    ids = sorted(codes)
    values = np.array([codes[i] for i in ids], np.uint64)
    near = [np.flatnonzero(np.bitwise_count(values ^ v) <= 4) for v in values]
    label = np.arange(len(ids))
    for _ in ids:
        label = np.array([label[n].min() for n in near])
    wanted = {i: (f"{codes[i]:016x}", ids[k]) for i, k in zip(ids, label)}
    rows = rows_of(spark, small, "op9_simhash")
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == wanted


def test_pipeline(spark, small, tmp_path):
    """Every stage does its own work on what the one before it kept."""
    spark = prepare(spark)
    kept = spark.read.parquet(f"{small}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, kept, small)
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        assert out.dtypes == kept.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        before, kept = kept, spark.read.parquet(f"{tmp_path}/{k}")
        old = {r["doc_id"]: r for r in before.collect()}
        new = {r["doc_id"]: r for r in kept.collect()}
        assert new.keys() <= old.keys() and len(new) == kept.count()
        if name == "line dedup":
            assert new.keys() == old.keys()
        if name in ("quality rules", "near dedup"):
            assert all(old[i] == r for i, r in new.items())
        assert all(r["n_chars"] == len(r["text"]) for r in new.values() if r["text"])
    whole = corpus_pipeline.run(spark, small)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, small)
    key = lambda r: (r["doc_id"], r["start"])
    assert [
        (key(r), r["ids"]) for r in sorted(whole.collect(), key=key)
    ] == [(key(r), r["ids"]) for r in sorted(last.collect(), key=key)]
