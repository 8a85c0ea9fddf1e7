"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import audit, chat, collocations, fingerprints, hamming, language, licenses, mixing, near_dedup, packing, quality, secrets, sharding
from sightline.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": lambda s, d: packing.pack(table(s, d, "documents")),
        "op2_minhash_near_dedup": lambda s, d: near_dedup.components(table(s, d, "documents")),
        "op3_sharding": lambda s, d: sharding.assign(table(s, d, "documents")),
        "op4_chat_format": lambda s, d: chat.render(table(s, d, "conversations")),
        "op5_language_id": lambda s, d: language.predictions(table(s, d, "documents")),
        "op6_quality": lambda s, d: quality.predictions(table(s, d, "documents"), table(s, d, "labels")),
        "op7_secret_scan": lambda s, d: secrets.report(table(s, d, "documents")),
        "op8_top_k_search": lambda s, d: hamming.top_k(table(s, d, "embeddings")),
        "op9_mixing": lambda s, d: mixing.report(table(s, d, "documents")),
        "op10_fingerprints": lambda s, d: fingerprints.fingerprints(table(s, d, "documents")),
        "op11_license_scan": lambda s, d: licenses.scan(table(s, d, "documents")),
        "op12_filter_audit": lambda s, d: audit.audit(table(s, d, "documents"), table(s, d, "labels")),
        "op13_collocations": lambda s, d: collocations.collocations(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat_format": chat.RENDER_SQL, "op8_top_k_search": hamming.TOP_K_SQL, "op9_mixing": mixing.REPORT_SQL,
        "op11_license_scan": licenses.SCAN_SQL, "op12_filter_audit": audit.AUDIT_SQL, "op13_collocations": collocations.COLLOCATIONS_SQL,
    }
