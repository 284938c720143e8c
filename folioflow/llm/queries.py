"""All registered queries of this subpackage."""

from folioflow.llm import (  # noqa: F401
    block_naming,
    suffix_dedup,
    chaining,
    quality,
    secrets,
    toxicity,
    rollups,
    mixing,
    order_minhash,
    byte_bpe,
    token_alignment,
    prefix_trie,
    warc,
)
from folioflow.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
