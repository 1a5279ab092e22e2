"""All registered queries."""

from talentloom.plans.catalogue import (  # noqa: F401  (importing registers)
    intake_queries, record_queries, analytics_queries, text_queries, response_queries, match_queries, stream_queries,
)
from talentloom.plans.catalogue.registry import ORACLES, QUERIES  # noqa: F401
