"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from sieveline.llm import chat, codes, exact_dedup, filter_audit, licenses, lm, mixing, packing, pii, simhash, substring_dedup, topk, toxicity
from sieveline.llm.common import table


def op1_topk(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"))


def op2_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_pii(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op4_lm(spark, sf_dir):
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op5_simhash(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_chat_format(spark, sf_dir):
    turns = chat.with_probe(spark, table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.format_turns(turns)).drop("attachments", "expanded_tokens")


def op10_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_codes(spark, sf_dir):
    return codes.encode(table(spark, sf_dir, "embeddings"))


def op12_licenses(spark, sf_dir):
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark, sf_dir):
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_topk, op2_packing, op3_pii, op4_lm, op5_simhash, op6_substring_dedup, op7_exact_dedup, op8_toxicity, op9_chat_format, op10_mixing, op11_codes, op12_licenses, op13_filter_audit)}
ORACLES = {"op1_topk": topk.ORACLE, "op6_substring_dedup": substring_dedup.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE, "op9_chat_format": chat.ORACLE, "op10_mixing": mixing.oracle(), "op11_codes": codes.oracle(), "op12_licenses": licenses.oracle(), "op13_filter_audit": filter_audit.ORACLE}
