"""Queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from parlance.llm import conversation_repair, flac, forest, id_files, jaccard, langid, merkle, mixing, packing, quality, toxicity, url_filter, warc

QUERIES = {
    "op1_quality_machine": quality.op1_quality_machine,
    "op2_retrieval_packing": packing.op2_retrieval_packing,
    "op3_url_vocabulary": url_filter.op3_url_vocabulary,
    "op4_source_mix": mixing.op4_source_mix,
    "op5_toxicity_lexicon": toxicity.op5_toxicity_lexicon,
    "op6_token_group_join": jaccard.op6_token_group_join,
    "op7_language_mixture": langid.op7_language_mixture,
    "op8_prefix_forest": forest.op8_prefix_forest,
    "op9_flac_media": flac.op9_flac_media,
    "op10_token_id_files": id_files.op10_token_id_files,
    "op11_warc_shards": warc.op11_warc_shards,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLES = {
    "op3_url_vocabulary": url_filter.oracle(),
    "op4_source_mix": mixing.ORACLE,
    "op11_warc_shards": warc.ORACLE,
    "op12_conversation_repair": conversation_repair.oracle(),
    "op13_merkle_manifest": merkle.oracle(),
}
