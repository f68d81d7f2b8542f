"""All queries of this subpackage."""

from scalefold.llm import (  # noqa: F401
    conversation_queries,
    corpus_queries,
    label_queries,
    lm_queries,
    repeat_queries,
    shard_queries,
    vector_queries,
)
from scalefold.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
