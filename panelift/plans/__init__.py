"""Checked query plans. Importing this package fills the registry in the order of the survey."""

from panelift.plans import (  # noqa: F401
    panel_queries,
    cleaning_queries,
    profile_queries,
    model_queries,
    diagnostic_queries,
    report_queries,
    tree_queries,
    edge_queries,
)
from panelift.plans.catalog import ORACLES, QUERIES  # noqa: F401
