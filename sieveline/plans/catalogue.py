"""All queries of the library but the corpus operators."""

from __future__ import annotations

from . import accuracy, elements, geometry, layout, outgoing, payloads, privacy, reconciliation, responses, scenes, sessions, subjects, tasks, validation
from .registry import Query

MODULES = (privacy, layout, outgoing, tasks, sessions, subjects, scenes, validation, accuracy, elements, payloads, geometry, responses, reconciliation)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.QUERIES.queries.items()}


def oracles() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.QUERIES.oracles.items()}
