"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import curriculum, decontaminate, hard_negatives, language_id, packing, pii, pivot_search, quality, simhash, spelling, toxicity, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_normaliser": warc.query,
    "op2_url_cascade": url_filter.query,
    "op3_language_id": language_id.query,
    "op4_histogram_packing": packing.query,
    "op5_simhash_components": simhash.query,
    "op6_pii_boosting": pii.query,
    "op7_decontaminate": decontaminate.query,
    "op8_quality_subwords": quality.query,
    "op9_toxicity_compression": toxicity.query,
    "op10_pivot_search": pivot_search.query,
    "op11_hard_negatives": hard_negatives.query,
    "op12_curriculum": curriculum.query,
    "op13_spelling_variants": spelling.query,
}

ORACLES: dict[str, str] = {
    "op1_warc_normaliser": warc.ORACLE,
    "op2_url_cascade": url_filter.ORACLE,
    "op10_pivot_search": pivot_search.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_curriculum": curriculum.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
