"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, mixing, packing, phrase_automata, ranked_search, simhash, suffix_dedup, suffix_tree, token_counts, toxicity, transport_stream, url_filter, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_transport_stream": transport_stream.op2_transport_stream,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_simhash": simhash.op6_simhash,
        "op7_packing": packing.op7_packing,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_lm": suffix_tree.op9_lm,
        "op10_mixing": mixing.op10_mixing,
        "op11_ranked_search": ranked_search.op11_ranked_search,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_phrase_automata": phrase_automata.op13_phrase_automata,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": url_filter.OP5_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL, "op11_ranked_search": ranked_search.OP11_SQL, "op12_vector_codes": vector_codes.OP12_SQL}
