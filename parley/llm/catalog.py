"""All queries of this subpackage, and the pipeline."""

import corpus_pipeline
from parley.llm import queries_codes, queries_rows, queries_text, queries_web  # noqa: F401
from parley.llm.registry import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run

__all__ = ["ORACLES", "QUERIES"]
