"""All driver queries and their SQL."""

from postbag.plans import (
    campaign_queries,
    contact_queries,
    decision_queries,
    history_queries,
    message_queries,
    page_queries,
    quota_queries,
    resume_queries,
    stream_queries,
)

_MODULES = (
    contact_queries,
    quota_queries,
    history_queries,
    page_queries,
    message_queries,
    decision_queries,
    stream_queries,
    campaign_queries,
    resume_queries,
)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
