"""The training-data queries: one ``opN_<name>`` per operator, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import op3_byte_bpe
from .decontaminate import OP9_SQL, op9_decontaminate
from .language_id import op5_language_id
from .license_scan import op1_license_scan
from .ngram_join import OP4_SQL, op4_ngram_join
from .suffix_dedup import OP7_SQL, op7_suffix_dedup
from .token_files import op10_token_files
from .topk import OP8_SQL, op8_topk
from .toxicity import op2_toxicity
from .url_filter import op6_url_filter

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_toxicity,
        op3_byte_bpe,
        op4_ngram_join,
        op5_language_id,
        op6_url_filter,
        op7_suffix_dedup,
        op8_topk,
        op9_decontaminate,
        op10_token_files,
    )
}

_SQL: dict[str, str] = {
    "op4_ngram_join": OP4_SQL,
    "op7_suffix_dedup": OP7_SQL,
    "op8_topk": OP8_SQL,
    "op9_decontaminate": OP9_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
