"""All queries of the subpackage and the SQL of those that SQL can express."""

from postbag.llm import (
    bpe,
    collision_count,
    exact_dedup,
    importance,
    license_scan,
    line_dedup,
    minhash,
    packing,
    quality,
    token_counts,
    toxicity,
    vector_codes,
    warc,
)

_MODULES = (
    warc,
    license_scan,
    exact_dedup,
    minhash,
    collision_count,
    token_counts,
    packing,
    bpe,
    line_dedup,
    toxicity,
    quality,
    vector_codes,
    importance,
)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
