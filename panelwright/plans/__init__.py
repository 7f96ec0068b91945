"""Registered queries, grouped by operator family."""

from importlib import import_module

from .registry import PLANS, Plan

FAMILIES = [
    "indicators",
    "flows",
    "scalars",
    "quality",
    "regime",
    "scoring",
    "records",
    "screening",
    "stages",
    "research",
    "risk",
    "ml",
    "streams",
]


def load_plans() -> dict[str, Plan]:
    for f in FAMILIES:
        import_module(f"{__name__}.{f}")
    return PLANS
