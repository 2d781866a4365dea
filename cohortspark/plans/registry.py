"""All registered queries of the core and the SQL they are compared with."""

from __future__ import annotations

from cohortspark.plans import cohort_queries, cohort_sql, data_queries, model_queries, voxel_queries

FLAGSHIP = "fold_summary"


def queries() -> dict:
    return cohort_queries.QUERIES | voxel_queries.QUERIES | model_queries.QUERIES | data_queries.QUERIES


def oracles() -> dict:
    return cohort_sql.ORACLES | voxel_queries.ORACLES | model_queries.ORACLES | data_queries.ORACLES
