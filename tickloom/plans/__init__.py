"""Registered queries by inventory section."""

from __future__ import annotations

import importlib

MODULES = ("q_sources", "q_quality", "q_scalars", "q_resample", "q_windows", "q_joins", "q_paths", "q_panel",
           "q_events", "q_stats", "q_controls", "q_models", "q_streaming", "q_flows")


def load_all():
    from . import base

    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return base.QUERIES, base.ORACLE
