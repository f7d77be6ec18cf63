"""All queries of this subpackage; importing the operators registers them."""

from __future__ import annotations

from visitweave.llm import (  # noqa: F401
    filter_audit, grid_join, language_id, near_dedup, order_minhash, packing, planes, prefix_trie, quality_rules, sharding, speculative_bpe,
    warc, weak_labels)
from visitweave.llm.registry import ORACLES, QUERIES  # noqa: F401
