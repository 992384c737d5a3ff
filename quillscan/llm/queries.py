"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from quillscan.llm import bpe, divergence, fingerprints, language, near_dedup, neighbours, packing, sharding, token_counts, toxicity, url_filters, vector_codes, warc


def queries() -> dict:
    return {
        "op1_packing": packing.op1,
        "op2_bpe": bpe.op2,
        "op3_toxicity": toxicity.op3,
        "op4_language": language.op4,
        "op5_fingerprints": fingerprints.op5,
        "op6_near_dedup": near_dedup.op6,
        "op7_nearest_neighbours": neighbours.op7,
        "op8_warc": warc.op8,
        "op9_token_counts": token_counts.op9,
        "op10_sharding": sharding.op10,
        "op11_source_divergence": divergence.op11,
        "op12_vector_codes": vector_codes.op12,
        "op13_url_filters": url_filters.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_nearest_neighbours": neighbours.ORACLE, "op8_warc": warc.ORACLE, "op10_sharding": sharding.ORACLE,
        "op11_source_divergence": divergence.ORACLE, "op12_vector_codes": vector_codes.ORACLE, "op13_url_filters": url_filters.ORACLE,
    }
