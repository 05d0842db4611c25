"""Registered queries and the DuckDB SQL each must agree with."""

from __future__ import annotations

import importlib

MODULES = ("text", "markdown", "audit", "joins", "qc", "layout", "books", "more", "runs", "documents", "schemas")


def queries_of() -> list:
    """The modules that hold QUERIES and ORACLES."""
    return [importlib.import_module(f"{__name__}.{name}") for name in MODULES]
