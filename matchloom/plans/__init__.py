"""Registered queries over the driver tables."""


def load() -> None:
    """Imports every module that registers queries."""
    from matchloom.plans import blocking_steps, evidence_rules, features, linkage, relational, reports, rescues, strings  # noqa: F401
