"""All registered queries of the library and their SQL counterparts."""

from __future__ import annotations

from . import queries_archive, queries_attacks, queries_batch, queries_contract, queries_evidence, queries_gates, queries_generated, queries_law, queries_recheck, queries_records, queries_series, queries_sources, queries_specs, queries_text

MODULES = (queries_law, queries_records, queries_series, queries_archive, queries_gates, queries_contract, queries_evidence, queries_text, queries_sources, queries_batch, queries_specs, queries_recheck, queries_generated, queries_attacks)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
