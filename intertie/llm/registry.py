"""Queries of this package, each with a SQL twin where SQL can say it."""

from __future__ import annotations

from ..queries import Registry

REGISTRY = Registry()


def load() -> Registry:
    from . import queries  # noqa: F401 - registers the queries

    return REGISTRY
