"""quarry.plans: registered queries (one module per operator family) and the API."""

import importlib

FAMILIES = ["q_profile", "q_quality", "q_clean", "q_assoc", "q_charts", "q_models", "q_route", "q_findings", "q_sources", "q_streaming", "q_misc"]


def load_all() -> None:
    for mod in FAMILIES:
        importlib.import_module(f"quarry.plans.{mod}")
