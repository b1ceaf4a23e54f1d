"""The reference's operators as queries over the test tables."""

from quillgraph.plans import aggregates, entities, history, intake, overview, relations, retrieval, service, staged, streams, text
from quillgraph.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "aggregates", "entities", "history", "intake", "overview", "relations", "retrieval", "service", "staged", "streams", "text"]
