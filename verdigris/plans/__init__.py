"""Queries over the driver's tables, by area: name -> (query, its SQL or None)."""

from __future__ import annotations

from importlib import import_module

AREAS = ("scoring", "paired", "runlog", "reconcile", "text", "evidence", "answers", "files")


def all_queries() -> dict:
    out: dict = {}
    for area in AREAS:
        out |= import_module(f".{area}", __name__).QUERIES
    return out
