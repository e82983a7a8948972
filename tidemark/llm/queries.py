"""The registered queries of this subpackage and their DuckDB SQL."""

from tidemark.llm import divergence, exact_dedup, fingerprints, html_extract, language_id, lexical_search, mixing, packing, sentencepiece_codec, simhash, substring_dedup, token_files, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_html_extraction": html_extract.op3_html_extraction,
    "op4_token_files": token_files.op4_token_files,
    "op5_sentencepiece": sentencepiece_codec.op5_sentencepiece,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_simhash": simhash.op8_simhash,
    "op9_language_id": language_id.op9_language_id,
    "op10_mixing": mixing.op10_mixing,
    "op11_packing": packing.op11_packing,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

ORACLE = {**exact_dedup.ORACLE, **substring_dedup.ORACLE, **divergence.ORACLE, **lexical_search.ORACLE}
