"""All queries of this subpackage, for the driver's entry file."""

from . import chat_format, embedding_dedup, language_id, minhash_dedup, piece_codec, quality_rules, source_mix, token_counts, token_files, toxicity
from ._common import importable

_MODULES = [language_id, toxicity, chat_format, minhash_dedup, quality_rules, source_mix, piece_codec, token_counts, token_files, embedding_dedup]


def queries() -> dict:
    return {k: importable(f) for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
