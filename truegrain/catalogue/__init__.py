"""Registered queries. `load()` imports every module of the catalogue once."""

from __future__ import annotations

from importlib import import_module
from types import ModuleType

MODULES = ["completeness", "duplicates", "fuzzy", "compare", "service"]


def load() -> ModuleType:
    for name in MODULES:
        import_module(f"truegrain.catalogue.{name}")
    return import_module("truegrain.catalogue.registry")
