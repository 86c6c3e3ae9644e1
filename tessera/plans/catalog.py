"""Queries by name, with the SQL that states the same result."""

from __future__ import annotations

from tessera.plans import block_plans, fleet_plans, prompt_plans, review_plans, score_plans, state_plans, text_plans
from tessera.plans.registry import Query

FLAGSHIP = "en_ratio"
MODULES = [text_plans, score_plans, block_plans, fleet_plans, prompt_plans, review_plans, state_plans]
QUERIES: dict[str, Query] = {k: q for m in MODULES for k, q in m.R.queries.items()}
ORACLES: dict[str, str] = {k: s for m in MODULES for k, s in m.R.oracles.items()}
