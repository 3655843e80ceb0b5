"""A training corpus in five stages: language, quality, near copies, benchmark passages, token ids."""

from tidemark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
