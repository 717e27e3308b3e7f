"""All queries over the supplied tables and the SQL that must return the same rows."""

from __future__ import annotations

from . import adaptive, analytics, checks, constants, expansion, graphs, prompts, records, repository, roles, rounds, search, selection, texts, windows

MODULES = (search, texts, analytics, rounds, repository, roles, graphs, prompts, selection, records, expansion, checks, windows, adaptive, constants)


def merged(tables: list[dict]) -> dict:
    """All entries; a name that two tables have is an error, as one of its queries would be lost."""
    out: dict = {}
    for table in tables:
        if twice := out.keys() & table.keys():
            raise ValueError(f"registered twice: {', '.join(sorted(twice))}")
        out |= table
    return out


QUERIES = merged([m.QUERIES for m in MODULES])
ORACLES = merged([m.ORACLES for m in MODULES])
