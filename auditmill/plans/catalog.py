"""All registered queries."""

from auditmill.plans import fragments, queries_events, queries_graph, queries_models, queries_text  # noqa: F401
from auditmill.plans.registry import ORACLES, QUERIES  # noqa: F401
