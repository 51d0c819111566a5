"""All named queries; importing a module registers what it defines."""

from flowguard.plans import (  # noqa: F401
    decision_queries,
    ingest_queries,
    metric_queries,
    model_queries,
    neighbour_queries,
    report_queries,
    selection_queries,
    stream_queries,
)
from flowguard.plans.registry import ORACLES, QUERIES  # noqa: F401
