"""The pipeline of tallyforge/llm/stages.py, where the driver looks for it."""

from tallyforge.llm.stages import ORACLE_SQL, STAGES, encoding, mixture, near_duplicates, quality_rules, run, secret_scan

__all__ = ["ORACLE_SQL", "STAGES", "encoding", "mixture", "near_duplicates", "quality_rules", "run", "secret_scan"]
