"""Every query of the library's own operators, with the SQL that says the same where SQL can."""

from __future__ import annotations

from gleanery.plans import batches, conversations, datasets, evaluations, graphs, rewards, stores, texts  # noqa: F401  registers its queries
from gleanery.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "win01_agg18_joi13_rejected_advantage"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
