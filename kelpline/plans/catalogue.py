"""Every query over the driver's tables, with the SQL that must agree with it."""

from __future__ import annotations

from kelpline.plans import check_queries, relation_queries, sample_queries, stream_queries, sync_queries  # noqa: F401  they register themselves
from kelpline.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
