"""Imports every operator with a registered query."""

from tidecast.llm import audit, bloom_lm, chat, collocations, crf, decontaminate, divergence, licenses, mixing, prefix_join, token_counts, toxicity, warc  # noqa: F401
from tidecast.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
