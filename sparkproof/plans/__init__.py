"""Query catalogue. Importing a module registers its queries."""

from __future__ import annotations

import importlib

MODULES = ["mail_queries", "report_queries", "content_queries", "matching_queries", "auth_queries", "grid_queries", "config_queries", "intake_queries", "more_queries", "table_queries", "settings_queries"]


def load_all():
    for m in MODULES:
        importlib.import_module(f"sparkproof.plans.{m}")
    return importlib.import_module("sparkproof.plans.registry")
