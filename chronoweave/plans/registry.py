"""All registered queries of the event-graph engine."""

from __future__ import annotations

from chronoweave.plans import function_plans, graph_plans, mining_plans, repair_plans, rule_plans  # noqa: F401  they register their queries
from chronoweave.plans.base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "me_label_census"
