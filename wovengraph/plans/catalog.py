"""All named queries."""

from wovengraph.plans import (  # noqa: F401
    q_access,
    q_edits,
    q_functions,
    q_hierarchy,
    q_patterns,
    q_rules,
    q_search,
    q_views,
)
from wovengraph.plans.registry import ORACLES, QUERIES  # noqa: F401
