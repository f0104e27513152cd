"""Registered queries, one module per area."""

from importlib import import_module
from pkgutil import iter_modules


def load_all() -> None:
    """Import every ``q_*`` module of this package, which fills the registry."""
    for module in sorted(m.name for m in iter_modules(__path__)):
        if module.startswith("q_"):
            import_module(f"{__name__}.{module}")
