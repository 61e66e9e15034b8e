"""All registered queries."""

from panelmill.plans import q_decision, q_features, q_layouts, q_ledger, q_model_facts, q_models, q_panel, q_sampling, q_stores  # noqa: F401
from panelmill.plans.registry import QUERIES  # noqa: F401
