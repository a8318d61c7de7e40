"""The registered queries of this package and their SQL texts."""

from __future__ import annotations

from tidemark.llm import fingerprints, language, lm, mixing, near_dedup, packing, passages, pii, quality, ranked, token_files, variants, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_source_mix": mixing.op2_source_mix,
    "op3_passages": passages.op3_passages,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_pii": pii.op5_pii,
    "op6_packing": packing.op6_packing,
    "op7_lm_score": lm.op7_lm_score,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_quality": quality.op9_quality,
    "op10_language": language.op10_language,
    "op11_ranked_search": ranked.op11_ranked_search,
    "op12_spelling_variants": variants.op12_spelling_variants,
    "op13_token_files": token_files.op13_token_files,
}

SQL = {
    "op1_warc": warc.SQL,
    "op2_source_mix": mixing.SQL,
    "op5_pii": pii.SQL,
    "op8_near_dedup": near_dedup.SQL,
    "op11_ranked_search": ranked.SQL,
}
