"""Registered queries over the driver's tables."""

from importlib import import_module

_MODULES = ("calendar", "matching", "reconciling", "monitoring", "tracking", "merging", "editing", "stream", "feeds", "pages", "moderating", "people", "reading", "importing", "approving", "transferring", "nested", "reporting", "histories", "linking")


def load() -> None:
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
