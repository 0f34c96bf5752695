"""Imports every query module so that the registry is filled."""

from __future__ import annotations

import importlib
import pkgutil

import tidemark.plans as _plans
from tidemark.plans.registry import ORACLE, QUERIES

for _m in sorted(m.name for m in pkgutil.iter_modules(_plans.__path__) if m.name.startswith("q_")):
    importlib.import_module(f"tidemark.plans.{_m}")

__all__ = ["ORACLE", "QUERIES"]
