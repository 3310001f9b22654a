"""All driver queries of the reading-order engine, with their SQL."""

from __future__ import annotations

from orrery.plans import analysis_plans, graph_plans, ordering_plans, rules_plans, study_plans, text_plans

QUERIES = text_plans.QUERIES | graph_plans.QUERIES | ordering_plans.QUERIES | study_plans.QUERIES | analysis_plans.QUERIES | rules_plans.QUERIES
ORACLE_SQL = text_plans.ORACLE_SQL | graph_plans.ORACLE_SQL | ordering_plans.ORACLE_SQL | study_plans.ORACLE_SQL | analysis_plans.ORACLE_SQL | rules_plans.ORACLE_SQL
FLAGSHIP = "auc"
