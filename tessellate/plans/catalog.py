"""Imports every query module so the registry is complete."""

from __future__ import annotations

import importlib

from . import registry

_MODULES = ["q_metrics", "q_text", "q_labels", "q_advantage", "q_seq", "q_prompts", "q_batch", "q_io"]


def _load():
    for m in _MODULES:
        importlib.import_module(f"{__package__}.{m}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.ORACLE)
