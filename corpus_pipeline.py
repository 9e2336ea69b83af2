"""The corpus pipeline: raw documents to packed training sequences, in five stages (see sievework/llm/pipeline.py)."""

from sievework.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
