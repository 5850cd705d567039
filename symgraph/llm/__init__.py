"""Operators for training-data corpora and their queries; nothing else in the library imports this package."""

from __future__ import annotations

from . import jaccard_join, langid, maxscore, mixing, packing, pii, quality_pairs, quality_rules, suffix_dedup, warc

QUERIES = {
    f.__name__: f
    for f in (
        mixing.op1_poisson_mix,
        quality_pairs.op2_quality_ranking,
        maxscore.op3_maxscore_top_k,
        jaccard_join.op4_jaccard_join,
        packing.op5_best_fit_packing,
        pii.op6_feistel_pseudonyms,
        quality_rules.op7_quality_rules,
        warc.op8_warc_archive,
        suffix_dedup.op9_suffix_array_dedup,
        langid.op10_language_id,
    )
}
ORACLE_SQL = {
    "op1_poisson_mix": mixing.SQL,
    "op3_maxscore_top_k": maxscore.SQL,
    "op7_quality_rules": quality_rules.SQL,
    "op8_warc_archive": warc.SQL,
}
