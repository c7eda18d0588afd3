"""All registered queries of the engine and the SQL that states the same results."""

from __future__ import annotations

from lodestone import registry
from lodestone.operators import chunking, dense, fusion, items, lexical, parsing
from lodestone.plans import answers, evaluation, gates, generation, highlights, questions, retrieval, verification
from lodestone.sources import filings, jsonl, listings, store
from lodestone.streaming import ingest

MODULES = (parsing, items, chunking, lexical, dense, fusion, evaluation, gates, questions, verification, answers, generation, highlights, retrieval, filings, listings, jsonl, store, ingest)


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
