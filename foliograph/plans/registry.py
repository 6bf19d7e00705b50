"""All registered queries of the engine's own operators."""

from . import documents, events, inventory, layout, pages, records, relations, scoring, tex, workflow

FLAGSHIP = "candidates_by_kind"
_MODULES = [documents, pages, events, scoring, relations, records, tex, workflow, inventory, layout]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.Q.run.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.Q.sql.items()}
