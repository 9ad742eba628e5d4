"""Importing this module registers every query of the package."""

from epochwise.llm import bytededup, conversations, decontaminate, fim, pii, quality, sentencepiece, simhash, tokencounts, tokenfiles, toxicity, weighted, worddedup  # noqa: F401
from epochwise.llm.base import ORACLES, QUERIES  # noqa: F401
