"""The registry of queries and the SQL that checks them."""

from quillrank.queries import audits, catalog, chain, evidence, gates, imports, learning, ledgers, ranking, records, relational, replays, scalars, streams, studies  # noqa: F401
from quillrank.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
