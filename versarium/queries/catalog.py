"""Imports every query module, so that the registry is complete."""

import importlib
from pathlib import Path

from versarium.queries.registry import ORACLES, QUERIES

for _path in sorted(Path(__file__).parent.glob("q_*.py")):
    importlib.import_module(f"versarium.queries.{_path.stem}")

__all__ = ["ORACLES", "QUERIES"]
