"""The registered queries of the corpus operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callscope.llm import decontaminate, divergence, lm, mixing, pii, quality, repeats, secrets, shards, simhash, syncmers, tries, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": urls.op1_url_filters,
    "op2_quality": quality.op2_quality,
    "op3_simhash": simhash.op3_simhash,
    "op4_lm_scoring": lm.op4_lm_scoring,
    "op5_mixing": mixing.op5_mixing,
    "op6_fingerprints": syncmers.op6_fingerprints,
    "op7_repeats": repeats.op7_repeats,
    "op8_sharding": shards.op8_sharding,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_secrets": secrets.op10_secrets,
    "op11_divergence": divergence.op11_divergence,
    "op12_pii": pii.op12_pii,
    "op13_prefix_trie": tries.op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {"op1_url_filters": urls.SQL, "op5_mixing": mixing.SQL, "op8_sharding": shards.SQL, "op11_divergence": divergence.SQL, "op13_prefix_trie": tries.SQL}
