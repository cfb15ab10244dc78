"""Registered queries of this package: name -> (Spark callable, check SQL or None)."""

from __future__ import annotations

from loomlog.llm import (
    checks, decontaminate, divergence, kneser_ney, lines, manifest, packing, quality, repeats, sharding,
    simhash, toolcalls, toxicity, urls,
)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark, sf_dir):
    return kneser_ney.scored_documents(_table(spark, sf_dir, "documents"))


def op2_url_filters(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.listed_by_host(pages))


def op3_quality_rules(spark, sf_dir):
    return quality.judged_documents(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


def op4_decontamination(spark, sf_dir):
    return decontaminate.judged_documents(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


def op5_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), ids=False)


def op6_line_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return lines.drop_recurring(docs.select("doc_id", "text"), texts=False)


def op7_suffix_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return repeats.remove_repeats(docs, keep_first=False, texts=False)


def op8_tool_calls(spark, sf_dir):
    calls, results = toolcalls.turn_calls(_table(spark, sf_dir, "conversations"))
    return toolcalls.link(calls, results)


def op9_simhash(spark, sf_dir):
    return simhash.grouped(_table(spark, sf_dir, "documents"))


def op10_sharding(spark, sf_dir):
    return sharding.sharded_documents(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark, sf_dir):
    return manifest.audit(_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark, sf_dir):
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op13_toxicity(spark, sf_dir):
    return toxicity.scored_documents(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


QUERIES = {
    f.__name__: (f, checks.CHECKS.get(f.__name__))
    for f in (
        op1_lm_scoring, op2_url_filters, op3_quality_rules, op4_decontamination, op5_packing,
        op6_line_dedup, op7_suffix_dedup, op8_tool_calls, op9_simhash, op10_sharding, op11_merkle_manifest,
        op12_source_divergence, op13_toxicity,
    )
}
