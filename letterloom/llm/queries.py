"""The queries of this subpackage and, where SQL can express them, their SQL."""

from . import ann, bpe, centroids, decontaminate, jaccard_join, language, line_dedup, periodic, quality, substring_dedup, suffix_dedup, toxicity, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        suffix_dedup.op1_suffix_dedup,
        substring_dedup.op2_substring_dedup,
        language.op3_language,
        bpe.op4_bpe,
        toxicity.op5_toxicity,
        decontaminate.op6_decontaminate,
        ann.op7_ann,
        url_filter.op8_url_filter,
        jaccard_join.op9_jaccard_join,
        line_dedup.op10_line_dedup,
        quality.op11_quality,
        periodic.op12_periodic_runs,
        centroids.op13_centroids,
    )
}
#: Without SQL: op3, op5 and op11 (learnt) and op4 (tokenizer); tests hold these against brute force.
ORACLES = {
    "op1_suffix_dedup": suffix_dedup.ORACLE,
    "op2_substring_dedup": substring_dedup.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op7_ann": ann.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
    "op9_jaccard_join": jaccard_join.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op12_periodic_runs": periodic.ORACLE,
    "op13_centroids": centroids.ORACLE,
}
