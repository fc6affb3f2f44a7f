"""One query for each operator over its whole table, and the SQL that some of them must equal."""

from contentflow.llm import bag_minhash, bpe, decontaminate, exact_dedup, license_rules, lm_score, prefix_trie, resample, sharding, token_codes, token_counts, toxicity, warc

QUERIES = {
    "op1_masked_pseudo_likelihood": lm_score.op1,
    "op2_winnowing": decontaminate.op2,
    "op3_token_codes": token_codes.op3,
    "op4_sentence_rules": license_rules.op4,
    "op5_exact_dedup": exact_dedup.op5,
    "op6_gzip_normaliser": warc.op6,
    "op7_sampled_splitters": sharding.op7,
    "op8_bag_minhash": bag_minhash.op8,
    "op9_distinct_words": bpe.op9,
    "op10_weak_supervision": toxicity.op10,
    "op11_crc_matrices": resample.op11,
    "op12_whole_tokens": token_counts.op12,
    "op13_burst_tries": prefix_trie.op13,
}

ORACLES = {
    "op2_winnowing": decontaminate.OP2_SQL,
    "op4_sentence_rules": license_rules.op4_sql(),
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op6_gzip_normaliser": warc.OP6_SQL,
    "op11_crc_matrices": resample.OP11_SQL,
    "op13_burst_tries": prefix_trie.OP13_SQL,
}
