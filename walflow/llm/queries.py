"""The queries of this package and the SQL that checks them."""

from __future__ import annotations

from walflow.llm import bpe, decontaminate, jaccard_join, langid, media, pii, sharding, substring, suffix_dedup, url_filter


def queries():
    return {
        "op1_suffix_array_dedup": suffix_dedup.query,
        "op2_bpe": bpe.query,
        "op3_substring_dedup": substring.query,
        "op4_url_filters": url_filter.query,
        "op5_ngram_jaccard_join": jaccard_join.query,
        "op6_sharding": sharding.query,
        "op7_language_id": langid.query,
        "op10_pii": pii.query,
        "op8_decontamination": decontaminate.query,
        "op9_media_columns": media.query,
    }


def oracle_sql():
    return {"op4_url_filters": url_filter.ORACLE_SQL}
