"""Registered queries: each module binds operators to the driver tables."""

from importlib import import_module

from seasonlake.plans.registry import ORACLES, QUERIES

_MODULES = (
    "grades", "consensus", "baselines", "outcomes", "value", "rates", "environment",
    "folds", "strategy", "texts", "raw", "relational", "learned", "reports", "builders",
)


def load() -> None:
    for name in _MODULES:
        import_module(f"seasonlake.plans.{name}")


__all__ = ["ORACLES", "QUERIES", "load"]
