"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.llm import audit, chaining, decontamination, exact, jaccard, packing, pii, preference, quality, sharding, suffixes, trie, urls


def _pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": _pipeline,
        "op1_preference_format": preference.op1_preference_format,
        "op10_collinear_chaining": chaining.op10_collinear_chaining,
        "op10_collinear_chaining_exact": chaining.op10_collinear_chaining_exact,
        "op11_prefix_trie": trie.op11_prefix_trie,
        "op12_filter_audit": audit.op12_filter_audit,
        "op13_golomb_exact_dedup": exact.op13_golomb_exact_dedup,
        "op2_mcd_quality": quality.op2_mcd_quality,
        "op3_winnowing_decontamination": decontamination.op3_winnowing_decontamination,
        "op4_mixture_packing": packing.op4_mixture_packing,
        "op5_skip_chain_crf": pii.op5_skip_chain_crf,
        "op6_grouped_prefix_join": jaccard.op6_grouped_prefix_join,
        "op7_histogram_shards": sharding.op7_histogram_shards,
        "op8_bwt_merge_dedup": suffixes.op8_bwt_merge_dedup,
        "op9_redirect_filter": urls.op9_redirect_filter,
    }


def oracle_sql() -> dict:
    return {
        "op1_preference_format": preference.ORACLE,
        "op11_prefix_trie": trie.ORACLE,
        "op12_filter_audit": audit.ORACLE,
        "op13_golomb_exact_dedup": exact.ORACLE,
        "op3_winnowing_decontamination": decontamination.ORACLE,
        "op6_grouped_prefix_join": jaccard.ORACLE,
        "op9_redirect_filter": urls.ORACLE,
    }
