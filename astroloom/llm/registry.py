"""The queries of the text operators, and the SQL of those that SQL can state."""

from __future__ import annotations

from . import (
    decontamination,
    fingerprints,
    html,
    licenses,
    linededup,
    pieces,
    sharding,
    simhash,
    surrogates,
    toxicity,
)

MODULES = (
    fingerprints,
    licenses,
    toxicity,
    decontamination,
    pieces,
    surrogates,
    linededup,
    sharding,
    html,
    simhash,
)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
