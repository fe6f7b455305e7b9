"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chat, html_extract, mixing, quality, secrets, sentencepiece_fst, simhash, suffix_dedup, vector_search, warc
from tessera.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": lambda s, d: suffix_dedup.dedup_query(table(s, d, "documents")),
        "op2_simhash": lambda s, d: simhash.simhash_query(table(s, d, "documents")),
        "op3_chat_formatting": lambda s, d: chat.rotate(table(s, d, "conversations")),
        "op4_warc": lambda s, d: warc.warc_query(table(s, d, "pages")),
        "op5_vector_search": lambda s, d: vector_search.search_query(table(s, d, "embeddings")),
        "op6_secret_scans": lambda s, d: secrets.secrets_query(table(s, d, "documents")),
        "op7_html_extract": lambda s, d: html_extract.extract_query(table(s, d, "pages")),
        "op8_mixing": lambda s, d: mixing.mixing_query(table(s, d, "documents")),
        "op9_sentencepiece": lambda s, d: sentencepiece_fst.sentencepiece_query(table(s, d, "documents")),
        "op10_quality_rules": lambda s, d: quality.quality_query(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_chat_formatting": chat.CHAT_SQL,
        "op4_warc": warc.WARC_SQL,
        "op5_vector_search": vector_search.SEARCH_SQL,
        "op6_secret_scans": secrets.SECRETS_SQL,
        "op8_mixing": mixing.MIXING_SQL,
        "op10_quality_rules": quality.QUALITY_SQL,
    }
