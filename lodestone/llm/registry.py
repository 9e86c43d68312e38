"""The queries of these operators; oracles where SQL can say the same."""

from . import ann, bpe, debruijn, jaccard, mixing, pii, quality_classifier, quality_rules, ranked_search, simhash, substring, warc, whitening

QUERIES = {
    f.__name__: f
    for f in (
        jaccard.op1_ngram_jaccard, bpe.op2_byte_bpe, ann.op3_anisotropic_ann, mixing.op4_mixing, substring.op5_substring_dedup,
        quality_rules.op6_quality_rules, pii.op7_pii, debruijn.op8_debruijn_dedup, warc.op9_warc, quality_classifier.op10_quality_classifier,
        ranked_search.op11_ranked_search, whitening.op12_embedding_whitening, simhash.op13_simhash_near_dedup,
    )
}

ORACLES = {"op4_mixing": mixing.ORACLE, "op11_ranked_search": ranked_search.ORACLE}
