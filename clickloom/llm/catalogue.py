"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clickloom.llm import alignment, langid, lattice, mixing, ngram_join, pagetext, periods, pieces, pii, repeats, topk, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_repeated_passages": repeats.op2_repeated_passages,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_warc": warc.op5_warc,
    "op6_ngram_jaccard_join": ngram_join.op6_ngram_jaccard_join,
    "op7_exact_top_k": topk.op7_exact_top_k,
    "op8_personal_data": pii.op8_personal_data,
    "op9_lattice_near_duplicates": lattice.op9_lattice_near_duplicates,
    "op10_page_text": pagetext.op10_page_text,
    "op11_periodic_runs": periods.op11_periodic_runs,
    "op12_language": langid.op12_language,
    "op13_token_alignment": alignment.op13_token_alignment,
}

SQL: dict[str, str] = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op2_repeated_passages": repeats.OP2_SQL,
    "op5_warc": warc.OP5_SQL,
    "op6_ngram_jaccard_join": ngram_join.OP6_SQL,
    "op7_exact_top_k": topk.OP7_SQL,
}
