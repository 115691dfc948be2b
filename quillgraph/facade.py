"""The tool surface: checked arguments in, JSON envelopes out."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import graph as G
from .operators import lookup as L
from .plans.fts_plan import search
from .sources.documents import inline
from .store import GraphStore


class ArgumentError(ValueError):
    """An argument is missing or out of range."""


def _text(name: str, value: Any) -> str:
    if not isinstance(value, str) or not value:
        raise ArgumentError(f"{name} must be a non-empty string")
    return value


def _whole(name: str, value: Any, low: int, high: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ArgumentError(f"{name} must be an integer from {low} to {high}")
    return value


def entity_object(row: dict) -> dict:
    """An entity as the API shows it: camel case, parsed metadata, ISO time."""
    stamp = row["updated_at"].isoformat(timespec="milliseconds") + "Z" if row["updated_at"] else None
    return {k: row[k] for k in ("id", "type", "name", "body")} | {
        "metadata": json.loads(row["metadata"] or "{}"),
        "sourcePath": row["source_path"],
        "updatedAt": stamp,
    }


def edge_object(row: dict) -> dict:
    return {k: row[k] for k in ("src", "dst", "relation")} | {"metadata": json.loads(row["metadata"] or "{}")}


class KnowledgeGraph:
    """Reads and writes on a store. Results hold one record, a page of at most 100, or a neighbourhood."""

    READS = ("kb_find", "kb_get", "kb_by_term", "kb_traverse", "kb_related")
    WRITES = ("kb_add_entity", "kb_add_edge")

    def __init__(self, store: GraphStore, allow_writes: bool = False):
        self.store, self.allow_writes = store, allow_writes

    def tools(self) -> list[str]:
        return [*self.READS, *(self.WRITES if self.allow_writes else ())]

    def call(self, tool: str, **arguments) -> dict:
        """A tool by name, arguments in camel or snake case; argument and query errors come back as ``{"error": ..., "isError": True}``."""
        if tool not in self.tools():
            return {"error": f"unknown tool {tool}", "isError": True}
        snake = {re.sub("[A-Z]", lambda m: "_" + m.group().lower(), k): v for k, v in arguments.items()}
        try:
            return getattr(self, tool)(**snake)
        except (ValueError, TypeError) as error:
            return {"error": str(error), "isError": True}

    # library level: unchecked limits, DataFrames

    def find(self, query: str, type: str | None = None, limit: int = 20) -> DataFrame:
        s = self.store.read()
        return search(s.entities, query, type, limit, s.postings, s.size)

    def by_term(self, term: str, type: str | None = None, limit: int = 20) -> DataFrame:
        s = self.store.read()
        return L.by_term(s.entities, s.terms, term, type, limit)

    def related(self, id: str) -> DataFrame:
        s = self.store.read()
        columns = ["src", "dst", "relation", "metadata"]
        out = G.outgoing(s.edges, id).select(F.lit("outgoing").alias("direction"), *columns)
        return out.unionAll(G.incoming(s.table("edges_by_dst"), id).select(F.lit("incoming").alias("direction"), *columns))

    def status(self) -> dict:
        s = self.store.read()
        row = L.status(s.entities, s.edges, s.terms).first()
        kinds = [{"type": r["type"], "c": r["c"]} for r in row["by_type"]]
        return {
            "db": self.store.root,
            "migrations": self.store.migrations(),
            "entities": {"total": row["total"], "byType": kinds},
            "edges": row["edges"],
            "terms": row["terms"],
        }

    # tools

    def kb_find(self, query: str, type: str | None = None, limit: int = 20) -> dict:
        hits = [r.asDict() for r in self.find(_text("query", query), type, _whole("limit", limit, 1, 100)).collect()]
        return {"count": len(hits), "hits": hits}

    def kb_get(self, id: str) -> dict:
        row = L.get_entity(self.store.read().entities, _text("id", id)).first()
        return {"found": True, "entity": entity_object(row.asDict())} if row else {"found": False, "id": id}

    def kb_by_term(self, term: str, type: str | None = None, limit: int = 20) -> dict:
        found = self.by_term(_text("term", term), type, _whole("limit", limit, 1, 100)).drop("updated_at")
        hits = [r.asDict() for r in found.collect()]
        return {"term": term, "count": len(hits), "hits": hits}

    def kb_traverse(self, id: str, relation: str | None = None, max_depth: int = 1) -> dict:
        s = self.store.read()
        walk = G.traverse(s.entities, s.edges, _text("id", id), relation, _whole("max_depth", max_depth, 0, G.MAX_DEPTH))
        rows = walk.join(s.entities, "id").orderBy("depth", "place").collect()
        if not rows:
            return {"found": False, "id": id}
        return {"count": len(rows), "results": [{"entity": entity_object(r.asDict()), "depth": r["depth"], "relation": r["relation"]} for r in rows]}

    def kb_related(self, id: str) -> dict:
        rows = [r.asDict() for r in self.related(_text("id", id)).orderBy("direction", "relation", "src", "dst").collect()]
        out, into = ([edge_object(r) for r in rows if r["direction"] == d] for d in ("outgoing", "incoming"))
        return {"id": id, "outgoingCount": len(out), "incomingCount": len(into), "outgoing": out, "incoming": into}

    def kb_add_entity(self, id: str, type: str, name: str, body: str | None = None, metadata: dict | None = None, source_path: str | None = None) -> dict:
        row = {"id": _text("id", id), "type": _text("type", type), "name": _text("name", name), "body": body, "source_path": source_path}
        self.store.upsert_entities(inline(self.store.spark, "entities", [row | {"metadata": json.dumps(metadata or {}, ensure_ascii=False)}]))
        return {"upserted": True, "id": id}

    def kb_add_edge(self, src: str, dst: str, relation: str, metadata: dict | None = None) -> dict:
        row = {"src": _text("src", src), "dst": _text("dst", dst), "relation": _text("relation", relation)}
        known = {r["id"] for r in self.store.read().entities.filter(F.col("id").isin(src, dst)).select("id").collect()}
        if not {src, dst} <= known:
            hint = "add the missing entity first"
            return {"error": "missing_endpoint", "srcExists": src in known, "dstExists": dst in known, "hint": hint, "isError": True}
        self.store.upsert_edges(inline(self.store.spark, "edges", [row | {"metadata": json.dumps(metadata or {}, ensure_ascii=False)}]))
        return {"upserted": True, **row}
