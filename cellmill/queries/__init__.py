"""The registry of the engine's own queries: callables and the SQL that checks them."""

from __future__ import annotations

from . import corpus, functions, harmonizing, inspection, relational, samplers, storage

GROUPS = [corpus.GROUP, functions.GROUP, harmonizing.GROUP, inspection.GROUP, samplers.GROUP, storage.GROUP, relational.GROUP]
QUERIES = {k: f for g in GROUPS for k, f in g.queries.items()}
ORACLES = {k: s for g in GROUPS for k, s in g.oracles.items()}
