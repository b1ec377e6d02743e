"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stateroll.llm import alignment, bpe, chat, decontaminate, licenses, neighbours, quality, simhash, spelling, suffix_dedup, token_counts, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontaminate.query,
    "op2_simhash": simhash.query,
    "op3_neighbours": neighbours.query,
    "op4_bpe": bpe.query,
    "op5_licenses": licenses.query,
    "op6_warc": warc.query,
    "op7_suffix_dedup": suffix_dedup.query,
    "op8_toxicity": toxicity.query,
    "op9_quality": quality.query,
    "op10_chat": chat.query,
    "op11_alignment": alignment.query,
    "op12_spelling": spelling.query,
    "op13_token_counts": token_counts.query,
}
SQL: dict[str, str] = {
    "op1_decontaminate": decontaminate.SQL,
    "op6_warc": warc.SQL,
    "op10_chat": chat.SQL,
}
