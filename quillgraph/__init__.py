"""A PySpark-native analytics engine for knowledge graphs: entities, relations, terms and full text."""

from .facade import KnowledgeGraph
from .ingest import IngestContext, Plugin, run_ingest
from .plans.fts_plan import search
from .plans.fts_query import QuerySyntaxError
from .session import build_session
from .sources.plugins import GraphDelta
from .store import GraphStore, Snapshot
from .validate import validate_rules_file

__all__ = [
    "GraphDelta",
    "GraphStore",
    "IngestContext",
    "KnowledgeGraph",
    "Plugin",
    "QuerySyntaxError",
    "Snapshot",
    "build_session",
    "run_ingest",
    "search",
    "validate_rules_file",
]
