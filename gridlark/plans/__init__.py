"""Queries over the shared tables."""

from __future__ import annotations

from importlib import import_module
from pathlib import Path

from gridlark.plans.registry import REGISTRY, Query


def load_all() -> dict[str, Query]:
    """Imports every plan module once and returns the registered queries."""
    for module in sorted(Path(__file__).parent.glob("q_*.py")):
        import_module(f"{__name__}.{module.stem}")
    return dict(REGISTRY)
