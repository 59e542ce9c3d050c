"""The registered queries opN_<name>: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievewright.llm import chat, collocations, exact_dedup, language_id, licenses, mixing, near_dedup, packing, pii, prefix_trie, quality_pu, quality_rules, sql, warc
from sievewright.session import Scratch, passing, ship, stash, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.verdicts(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return pii.find(table(spark, sf_dir, "documents"))


def op4_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return chat.repaired(table(spark, sf_dir, "conversations"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allot(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return quality_pu.score(docs, quality_pu.fit(docs, table(spark, sf_dir, "labels")))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pieces(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_marks", "n_lines", "failed")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return collocations.mine(stash(collocations.frequencies(table(spark, sf_dir, "documents"))))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    scratch = Scratch(spark)
    turns = prefix_trie.ordered(table(spark, sf_dir, "conversations"), scratch)
    return prefix_trie.trie(*prefix_trie.rebuilt(turns), scratch)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    archive = passing(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), archive)
    return warc.digest_rows(warc.read(spark, archive))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy rejects, and what it alone rejects, over the ledger of all documents."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")))


QUERIES = (op1_language_id, op2_exact_dedup, op3_pii, op4_chat_repair, op5_license_scan, op6_source_mixing, op7_quality_classifier, op8_near_dedup, op9_packing, op10_quality_rules, op11_collocations, op12_prefix_trie, op13_warc, quality_ablations)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op11_collocations": sql.COLLOCATIONS, "op12_prefix_trie": sql.PREFIX_TRIE, "op13_warc": sql.WARC, "op2_exact_dedup": sql.EXACT_DEDUP, "op5_license_scan": sql.license_scan(), "op6_source_mixing": sql.SOURCE_MIXING, "op10_quality_rules": sql.QUALITY_RULES, "quality_ablations": sql.quality_ablations()}
