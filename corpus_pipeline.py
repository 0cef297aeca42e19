"""The corpus pipeline: its stages, the SQL of its rows (none), and a run over the documents. The stages are in ``graphloom.llm.stages``."""

from graphloom.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
