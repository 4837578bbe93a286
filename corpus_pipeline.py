"""From raw documents to shards. The stages and what they do are in tidewake.llm.pipeline."""

from tidewake.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
