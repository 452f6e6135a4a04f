"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm.chat import OP8_SQL, op8_chat
from scriptorium.llm.divergence import OP13_SQL, op13_divergence
from scriptorium.llm.language import op7_language
from scriptorium.llm.lines import OP10_SQL, op10_lines
from scriptorium.llm.media import op4_media
from scriptorium.llm.minhash import OP1_SQL, op1_minhash
from scriptorium.llm.mixing import OP9_SQL, op9_mixing
from scriptorium.llm.packing import op3_packing
from scriptorium.llm.phrases import OP11_SQL, op11_phrases
from scriptorium.llm.secrets import OP12_SQL, op12_secrets
from scriptorium.llm.suffixes import op6_suffixes
from scriptorium.llm.token_files import op5_token_files
from scriptorium.llm.topk import OP2_SQL, op2_topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_topk": op2_topk,
    "op3_packing": op3_packing,
    "op4_media": op4_media,
    "op5_token_files": op5_token_files,
    "op6_suffixes": op6_suffixes,
    "op7_language": op7_language,
    "op8_chat": op8_chat,
    "op9_mixing": op9_mixing,
    "op10_lines": op10_lines,
    "op11_phrases": op11_phrases,
    "op12_secrets": op12_secrets,
    "op13_divergence": op13_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash": OP1_SQL,
    "op2_topk": OP2_SQL,
    "op8_chat": OP8_SQL,
    "op9_mixing": OP9_SQL,
    "op10_lines": OP10_SQL,
    "op11_phrases": OP11_SQL,
    "op12_secrets": OP12_SQL,
    "op13_divergence": OP13_SQL,
}
