"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tidemill.llm import alignment, bpe, language_model, merkle, minhash, mixing, neighbours, substrings, suffixes, token_counts, toxicity, url_filter, winnowing

QUERIES = {
    f.__name__: f
    for f in (winnowing.op1_fingerprints, minhash.op2_near_duplicates, token_counts.op3_token_counts, substrings.op4_substring_dedup, mixing.op5_mixing, neighbours.op6_neighbours, bpe.op7_bpe, toxicity.op8_toxicity, language_model.op9_language_model, url_filter.op10_url_filter, suffixes.op11_repeated_bytes, alignment.op12_alignment, merkle.op13_manifest)
}
ORACLES = {"op2_near_duplicates": minhash.ORACLE, "op4_substring_dedup": substrings.ORACLE, "op10_url_filter": url_filter.ORACLE, "op11_repeated_bytes": suffixes.ORACLE, "op13_manifest": merkle.ORACLE}
