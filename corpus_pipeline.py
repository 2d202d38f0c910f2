"""The corpus pipeline as a script's worth of names: its stages, its SQL and how to run it."""

from lodestar.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
