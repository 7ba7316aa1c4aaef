"""Imports every module that registers queries."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "sources", "filters", "joins", "aggregates", "windows", "ordering",
    "scalars", "rules", "reports", "backup", "movement", "streams", "status",
]


def load() -> None:
    for name in MODULES:
        import_module(f"{__package__}.{name}")
