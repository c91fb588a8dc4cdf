"""Queries of the subpackage llm, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pelagia.llm import alignment, bpe, fingerprint, jaccard_join, langid, license_scan, mixing, quantiles, substring, suffix_dedup, topk, toxicity, urlfilter
from pelagia.session import table


def _bpe(spark, sf_dir):
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents")))


def queries() -> dict:
    return {
        "op1_license_scan": license_scan.query,
        "op2_bpe": _bpe,
        "op3_fingerprint": fingerprint.query,
        "op4_substring_dedup": substring.query,
        "op5_language_id": langid.query,
        "op6_jaccard_join": jaccard_join.query,
        "op7_toxicity": toxicity.query,
        "op8_topk_search": topk.query,
        "op9_mixing": mixing.query,
        "op10_url_filter": urlfilter.query,
        "op11_suffix_dedup": suffix_dedup.query,
        "op12_quantiles": quantiles.query,
        "op13_alignment": alignment.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.sql(),
        "op8_topk_search": topk.SQL,
        "op9_mixing": mixing.sql(),
        "op12_quantiles": quantiles.sql(),
    }
