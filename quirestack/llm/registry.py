"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import byte_bpe, embedding_dedup, jaccard_join, media, merkle, mixing, pii, prefix_trie, quality, sharding, site_style, token_counts, toxicity

#: Query name -> the module of this package that defines it; a module may define <name>_SQL for DuckDB.
MODULES = {
    "op1_embedding_itq": embedding_dedup,
    "op2_quality_pu": quality,
    "op3_pii_feistel": pii,
    "op4_token_counts": token_counts,
    "op5_media_sequences": media,
    "op6_ngram_jaccard": jaccard_join,
    "op7_byte_bpe": byte_bpe,
    "op8_soft_mixing": mixing,
    "op9_extendible_sharding": sharding,
    "op10_toxicity": toxicity,
    "op11_merkle_manifest": merkle,
    "op12_site_style": site_style,
    "op13_prefix_trie": prefix_trie,
    "media_page_parts": media,
}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(module, f"{name}_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
