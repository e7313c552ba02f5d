"""Every registered plan."""
from __future__ import annotations

from . import access, checks, kpis, marts, meaning, state  # noqa: F401
from .registry import ORACLES, PLANS, on_folder


def queries():
    return {name: on_folder(plan) for name, plan in PLANS.items()}


def oracles():
    return dict(ORACLES)
