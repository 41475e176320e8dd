"""Operations of a training-data pipeline. Nothing else in the library imports this."""

from . import exact_dedup, language_id, line_dedup, minhash_neardup, secret_scan, sentencepiece_codec, source_mixing, suffix_dedup, token_counts, topk_search

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_minhash_neardup": minhash_neardup.op2_minhash_neardup,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_language_id": language_id.op4_language_id,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_topk_search": topk_search.op7_topk_search,
    "op8_source_mixing": source_mixing.op8_source_mixing,
    "op9_sentencepiece": sentencepiece_codec.op9_sentencepiece,
    "op10_token_counts": token_counts.op10_token_counts,
}
ORACLES = {
    "op1_line_dedup": line_dedup.SQL,
    "op2_minhash_neardup": minhash_neardup.SQL,
    "op3_suffix_dedup": suffix_dedup.SQL,
    "op5_secret_scan": secret_scan.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op7_topk_search": topk_search.SQL,
    "op8_source_mixing": source_mixing.SQL,
}
