"""All queries of this package, registered by their modules."""

from shardloom.llm import (  # noqa: F401
    byte_repeats, chat_format, decontaminate, jaccard, language, neighbours, packing, resharding, substrings, token_files,
    url_rules, vector_codes, whitening,
)
from shardloom.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
