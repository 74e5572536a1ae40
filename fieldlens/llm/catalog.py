"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from fieldlens.llm.decontaminate import op6_decontaminate
from fieldlens.llm.line_dedup import op1_line_dedup
from fieldlens.llm.merkle import op11_merkle_manifest
from fieldlens.llm.mixing import op7_mix_sources
from fieldlens.llm.ngram_join import op4_ngram_jaccard
from fieldlens.llm.oracle import ORACLE_SQL
from fieldlens.llm.pii import op13_personal_data
from fieldlens.llm.pitman_yor import op8_lm_scores
from fieldlens.llm.prefix_trie import op12_conversation_trie
from fieldlens.llm.quality import op9_quality_rules
from fieldlens.llm.substring_dedup import op5_substring_dedup
from fieldlens.llm.token_count import op10_token_counts
from fieldlens.llm.toxicity import op3_toxicity
from fieldlens.llm.warc import op2_warc_bundles

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_warc_bundles": op2_warc_bundles,
    "op3_toxicity": op3_toxicity,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_mix_sources": op7_mix_sources,
    "op8_lm_scores": op8_lm_scores,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_personal_data": op13_personal_data,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
