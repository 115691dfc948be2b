"""Queries that drive sources, plugins, the store, the tools and the checks of rule files end to end, and the same in SQL.

Files are made of whole test tables: rule files and manifests of entities and components as rows of path and content,
folders of markdown of the table of modules, whose size is fixed. The store of the whole tables is built once in a
session; the searches read its index.
"""

from __future__ import annotations

import contextlib
import http.client
import io
import json
import threading
import types
import zlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __all__ as EXPORTS
from ..cli import main
from ..commits import ConflictError
from ..facade import KnowledgeGraph
from ..ingest import PluginError, coerce_options, resolve_plugin, run_ingest
from ..operators import graph as G
from ..operators import lookup as L
from ..operators import mutations as M
from ..operators.integrity import IntegrityError
from ..schema import empty
from ..serve import http_server, serve_lines
from ..session import read_table, shared_dir, work_path
from ..sources import documents as D
from ..sources import pages
from ..sources import plugins as P
from ..store import GraphStore
from ..validate import RuleSpec, schema_issues, validate_rules_file
from .fts_plan import search
from .fts_query import QuerySyntaxError, parse
from .graph_queries import _BASE, _COMPONENTS, _RULES, Graph, _find_sql, _is, _near, _tf

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

CLOCK = "2025-07-01T00:00:00.000Z"
HUB = "module:nucleo-logistico"
_KEPT: dict[tuple, GraphStore] = {}


def _query(name: str, sql: str, base: bool = False):
    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = f"WITH {_BASE}{sql}" if base else sql
        return f

    return add


def _values(*rows: tuple, columns: str = "name, value") -> str:
    def cell(x) -> str:
        return "NULL" if x is None else f"'{x.replace(chr(39), chr(39) * 2)}'" if isinstance(x, str) else str(x)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({columns})"


def _rows(spark: SparkSession, rows: list[tuple], ddl: str = "name string, value string") -> DataFrame:
    return spark.createDataFrame(rows, ddl)


# stores


def graph_store(spark: SparkSession, d: str) -> GraphStore:
    """The store of the whole test tables, built once in a session: entities, edges between them, terms of them."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _KEPT:
        g, store = Graph(spark, d), GraphStore(spark, f"{shared_dir(spark)}/{key[0]}-graph/{zlib.crc32(d.encode())}", lambda: CLOCK)
        if not store.exists():
            ids = g.entities.select("id")
            edges = g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
            terms = g.terms.join(ids.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi")
            entities = g.entities.withColumn("metadata", F.coalesce("metadata", F.lit("{}")))
            store.migrate()
            store.commit("tables", entities=entities, edges=edges.select("src", "dst", "relation", "metadata"), terms=terms.select("term", "entity_id"))
        _KEPT[key] = store
    return _KEPT[key]


_KEPT_SQL = """,
  GE AS (SELECT * FROM G WHERE src IN (SELECT id FROM E) AND dst IN (SELECT id FROM E)),
  TE AS (SELECT * FROM T WHERE entity_id IN (SELECT id FROM E))"""


def _modules(spark: SparkSession, d: str) -> list[dict]:
    return [r.asDict() for r in read_table(spark, d, "modules").orderBy("id").collect()]  # a table of fixed size


def _write(spark: SparkSession, folder: str, files: dict[str, str]) -> str:
    jvm = spark.sparkContext._jvm
    for name, text in files.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(text.encode()))
        out.close()
    return folder


def _page(m: dict) -> str:
    cites = "" if m["id"] == HUB else f"cites: [{HUB}]\n"
    return f"---\nid: {m['id']}\ntype: {m['type']}\nname: {m['name']}\nowner: {m['owner']}\nterms: [{m['owner']}, {m['name']}, ]\ndepends_on: x\n{cites}---\n\n{m['body'] or ''}\n"


def module_pages(spark: SparkSession, d: str) -> str:
    files = {f"{m['owner']}/{m['name']}.md": _page(m) for m in _modules(spark, d)}
    return _write(spark, work_path(spark, "pages"), files | {"frio/other.txt": "---\nid: x\n---\n", "readme.md": "no front matter"})


def module_store(spark: SparkSession, d: str, log=lambda x: None) -> tuple[GraphStore, dict, P.GraphDelta]:
    """A new store with the modules, ingested from markdown; the result and the delta."""
    delta = P.markdown_plugin(spark, module_pages(spark, d))
    store = GraphStore(spark, work_path(spark, "store"), lambda: CLOCK, parts=4)
    result = run_ingest(store, types.SimpleNamespace(name="pages", run=lambda ctx: delta), log=log)
    return store, result.as_dict(), delta


# sources


@_query("source_markdown", "SELECT id, type, name, owner, owner || ' ' || name AS terms, coalesce(trim(body, E' \\t\\r\\n'), '') AS body FROM modules")
def _(spark, d):
    docs = D.read_markdown(spark, module_pages(spark, d), tolerant=False).filter(F.size("values") > 0)
    text = lambda k: F.element_at("values", k)["text"].alias(k)
    return docs.select(text("id"), text("type"), text("name"), text("owner"), F.array_join(F.element_at("values", "terms")["list"], " ").alias("terms"), "body")


@_query("source_markdown_quoted", "SELECT id, 'it''s ' || name AS name, '' AS nothing, owner || '|' || name AS terms FROM modules")
def _(spark, d):
    m = read_table(spark, d, "modules")
    text = F.format_string("---\nid: '%s'\nname: \"it's %s\"\nnothing:\nterms: ['%s', \"%s\"]\n---\nx", "id", "name", "owner", "name")
    docs = D.parse_markdown(m.select(F.col("path").alias("source_path"), text.alias("content")), quotes=True)
    value = lambda k: F.element_at("values", k)["text"].alias(k)
    return docs.select(value("id"), value("name"), value("nothing"), F.array_join(F.element_at("values", "terms")["list"], "|").alias("terms"))


@_query("source_missing_folder", _values(("entries", 0), ("markdown", 0), ("rejects", 0), ("rules", 0), ("strict", -1), columns="name, n"))
def _(spark, d):
    nowhere = work_path(spark, "nowhere")
    entries, rejects = D.read_manifests(spark, nowhere)
    found = {"markdown": D.read_markdown(spark, nowhere), "entries": entries, "rejects": rejects, "rules": D.parse_rules(D.read_yaml(spark, nowhere))}
    rows = [(name, df.count()) for name, df in found.items()]
    try:
        D.read_markdown(spark, nowhere, tolerant=False)
    except Exception:  # a strict reader refuses it
        rows.append(("strict", -1))
    return _rows(spark, rows, "name string, n int")


@_query("source_yaml_walk", _values(("a.yaml", "x"), ("b.yml", "y"), ("c.yaml", "z")))
def _(spark, d):
    root = _write(spark, work_path(spark, "yaml"), {"a.yaml": "x", "sub/b.yml": "y", "sub/deep/c.yaml": "z", "d.txt": "n", "e.yaml.bak": "n"})
    return D.read_yaml(spark, root).select(F.regexp_extract("source_path", "([^/]+)$", 1).alias("name"), F.col("content").alias("value"))


def _manifest_files(g: Graph) -> DataFrame:
    """A file for each component; without a type it is broken, without stability an object in place of an array."""
    c = g.raw["components"].dropDuplicates(["id"])
    one = F.to_json(F.struct("id", "type", "name", "body", "depends_on", "terms"))
    content = F.when(F.col("type").isNull(), F.concat(F.lit("["), one)).when(F.col("stability").isNull(), one).otherwise(F.concat(F.lit("["), one, F.lit(", {}]")))
    return c.select(F.col("path").alias("source_path"), content.alias("content"))


@_query(
    "source_manifests",
    f"""WITH {_COMPONENTS} SELECT path AS source_path, CASE WHEN type IS NULL THEN 'invalid JSON' WHEN stability IS NULL THEN 'manifest must be a top-level array' ELSE 'entry' END AS state,
      CASE WHEN type IS NOT NULL AND stability IS NOT NULL THEN id END AS id, 0 AS n FROM C
    UNION ALL SELECT path, 'entry', NULL, 1 FROM C WHERE type IS NOT NULL AND stability IS NOT NULL""",
)
def _(spark, d):
    entries, rejects = D.parse_manifests(_manifest_files(Graph(spark, d)))
    found = D.manifest_entries(entries)
    found = found.select("source_path", F.lit("entry").alias("state"), P._text(F.element_at("values", "id")).alias("id"), "n")
    return found.unionByName(rejects.select("source_path", F.col("reason").alias("state"), F.lit(None).cast("string").alias("id"), F.lit(0).alias("n")))


@_query(
    "source_union",
    f"WITH {_COMPONENTS} SELECT 0 AS source, id, name FROM modules UNION ALL SELECT 1, id, name FROM C WHERE type IS NOT NULL AND stability IS NOT NULL",
)
def _(spark, d):
    docs = D.markdown_entries(D.read_markdown(spark, module_pages(spark, d))).withColumn("source", F.lit(0))
    listed = D.manifest_entries(D.parse_manifests(_manifest_files(Graph(spark, d)))[0]).withColumn("source", F.lit(1))
    value = lambda k: P._text(F.element_at("values", k)).alias(k)
    return docs.unionByName(listed).select("source", value("id"), value("name")).filter(F.col("id").isNotNull())


@_query("source_inline", "SELECT id, type, name, body, NULL::VARCHAR AS metadata, path AS source_path FROM modules")
def _(spark, d):
    rows = D.inline(spark, "entities", [m | {"source_path": m["path"]} for m in _modules(spark, d)])
    return rows.select("id", "type", "name", "body", "metadata", "source_path")


@_query("scalar_or_list", f"WITH {_COMPONENTS} SELECT DISTINCT id, lower(t) AS term FROM (SELECT id, unnest(terms) AS t FROM C WHERE type = 'component' AND stability IS NOT NULL) WHERE t <> ''")
def _(spark, d):
    """A list with one item is given as that item."""
    g = Graph(spark, d)
    c = g.raw["components"].dropDuplicates(["id"]).filter(F.col("stability").isNotNull())
    terms = F.when(F.size("terms") == 1, F.regexp_replace(F.to_json(F.array(F.element_at("terms", 1))), r"(?s)^\[(.*)\]$", "$1")).otherwise(F.to_json("terms"))
    given = F.create_map(F.lit("id"), F.to_json(F.array("id")).substr(F.lit(2), F.length("id") + 2), F.lit("type"), F.concat(F.lit('"'), "type", F.lit('"')), F.lit("terms"), terms)
    entries = c.select(F.col("path").alias("source_path"), F.map_filter(given, lambda k, v: v.isNotNull()).alias("values"))
    delta = P.entries_delta(entries, c.filter("false").select(F.col("path").alias("source_path"), F.lit("").alias("reason")), g.entities)
    return M.replace_terms(empty(spark, "terms"), delta.terms).select(F.col("entity_id").alias("id"), "term")


def _component_pages(g: Graph) -> DataFrame:
    line = lambda k: F.coalesce(F.concat(F.lit(f"{k}: "), k, F.lit("\n")), F.lit(""))
    listed = F.concat(F.lit("["), F.array_join("depends_on", ", "), F.lit(", ]"))
    head = F.concat(F.lit("---\nid: "), "id", F.lit("\n"), line("type"), F.when(F.col("stability").isNotNull(), line("name")).otherwise(""), F.coalesce(F.concat(F.lit("depends_on: "), listed, F.lit("\n")), F.lit("")), F.lit("cites: "), "id", F.lit("\n---\n"))
    c = g.raw["components"].dropDuplicates(["id"])
    return c.select(F.col("path").alias("source_path"), F.concat(head, F.coalesce("body", F.lit(""))).alias("content"))


@_query("markdown_defaults", f"WITH {_COMPONENTS} SELECT id, coalesce(type, 'note') AS type, CASE WHEN stability IS NULL THEN id ELSE name END AS name, coalesce(trim(body, E' \\t\\r\\n'), '') AS body FROM C")
def _(spark, d):
    return P.markdown_delta(D.parse_markdown(_component_pages(Graph(spark, d)))).entities.select("id", "type", "name", "body")


@_query("markdown_edges", f"WITH {_COMPONENTS} SELECT DISTINCT src, trim(dst) AS dst, 'depends_on' AS relation FROM (SELECT id AS src, unnest(depends_on) AS dst FROM C) WHERE trim(dst) <> ''")
def _(spark, d):
    """Items of a list are trimmed. Lists only: the scalar ``cites`` makes no edge."""
    return P.markdown_delta(D.parse_markdown(_component_pages(Graph(spark, d)))).edges.select("src", "dst", "relation").distinct()


# rule files

_RULE_TYPES = ["rule", "exception", "sla", "decision"]


def _rule_files(g: Graph) -> DataFrame:
    """A rule file, in JSON and so in YAML, for each rule-like entity; a decision's file is broken, an sla's has no rules."""
    kinds = g.entities.filter(F.col("type").isin(_RULE_TYPES))
    m = F.when(F.try_parse_json("metadata").isNotNull(), F.col("metadata"))
    at = lambda k: F.get_json_object(m, f"$.{k}")
    rule = F.struct(
        "id", F.when(F.col("type") == "exception", F.col("type")).alias("type"), F.col("name").alias("summary"), at("owner").alias("owner"), at("status").alias("status"), at("severity").alias("risk_note"),
        F.col("source_path").alias("source_ref"), F.struct(F.coalesce(F.from_json(at("eventos"), "array<string>"), F.array().cast("array<string>")).alias("evento")).alias("applicability"),
        F.struct(F.when(F.col("type") == "exception", F.lit("base")).alias("overrides")).alias("formal_rule"),
        F.struct(F.array("type", "type").alias("tables"), F.array_compact(F.array(at("owner"))).alias("sps")).alias("related_objects"),
    )
    doc = F.to_json(F.struct(F.struct(at("owner").alias("domain"), F.lit("1").alias("version")).alias("metadata"), F.array(rule).alias("rules")))
    content = F.when(F.col("type") == "decision", F.concat(F.lit("["), doc)).when(F.col("type") == "sla", F.to_json(F.struct(F.lit("x").alias("rules")))).otherwise(doc)
    return kinds.select(F.format_string("kb/%s/seed-%s-rules.yaml", "id", "type").alias("source_path"), content.alias("content"))


_FILES = (
    _RULES
    + """, Y AS (SELECT *, CASE WHEN type = 'exception' THEN 'exception' ELSE 'rule' END AS kind, coalesce(nullif(owner, ''), type) AS domain,
      json_extract_string(CASE WHEN json_valid(meta) THEN meta END, '$.status') AS status, nullif(name, '') AS summary FROM (SELECT R.*, E.metadata AS meta FROM R JOIN E USING (id)) WHERE type IN ('rule', 'exception'))"""
)


@_query("rule_file_states", _RULES + " SELECT id, CASE type WHEN 'decision' THEN 'unparsable' WHEN 'sla' THEN 'no rules' ELSE 'ok' END AS state FROM R", base=True)
def _(spark, d):
    states = D.rule_files(_rule_files(Graph(spark, d)))
    return states.select(F.regexp_extract("source_path", "^kb/(.*)/[^/]*$", 1).alias("id"), "state")


@_query("rules_parsed", _FILES + " SELECT id, 0 AS n, domain, summary, owner, status, severity AS risk_note, len(eventos) AS n_eventos FROM (SELECT * REPLACE (nullif(owner, '') AS domain) FROM Y)", base=True)
def _(spark, d):
    rules = D.parse_rules(_rule_files(Graph(spark, d)))
    return rules.select("id", "n", "domain", "summary", "owner", "status", "risk_note", F.size("eventos").cast("bigint").alias("n_eventos"))


@_query(
    "rules_entities",
    _FILES + r""" SELECT kind || ':' || id AS id, kind AS type, '[' || id || '] ' || coalesce(summary, 'Sin resumen') AS name,
        concat_ws(chr(10), coalesce(summary, ''), 'Riesgo: ' || severity, 'Fuente: ' || nullif(source_path, '')) AS body, domain, coalesce(status, 'active') AS status FROM Y
      UNION ALL SELECT DISTINCT 'table:' || type, 'table', type, 'Tabla Sybase: ' || type, NULL, NULL FROM Y
      UNION ALL SELECT DISTINCT 'sp:' || owner, 'stored_procedure', owner, 'Stored Procedure Sybase: ' || owner, NULL, NULL FROM Y WHERE owner IS NOT NULL""",
    base=True,
)
def _(spark, d):
    found = P.yaml_delta(_rule_files(Graph(spark, d))).entities
    own = F.col("type").isin("rule", "exception")
    meta = lambda k: F.when(own, F.get_json_object("metadata", f"$.{k}")).alias(k)
    return found.select("id", "type", "name", "body", meta("domain"), meta("status"))


@_query(
    "rules_edges",
    _FILES + """ SELECT DISTINCT kind || ':' || id AS src, 'table:' || type AS dst, 'uses_table' AS relation FROM Y
      UNION ALL SELECT DISTINCT kind || ':' || id, 'sp:' || owner, 'uses_sp' FROM Y WHERE owner IS NOT NULL
      UNION ALL SELECT kind || ':' || id, 'rule:base', 'overrides' FROM Y WHERE kind = 'exception'""",
    base=True,
)
def _(spark, d):
    return P.yaml_delta(_rule_files(Graph(spark, d))).edges.select("src", "dst", "relation")


@_query(
    "rules_terms",
    _FILES + r""" SELECT DISTINCT lower(term) AS term, kind || ':' || id AS entity_id FROM (
        SELECT kind, id, unnest([domain, lower(id), lower(type), lower(owner)] || eventos || list_filter(regexp_split_to_array(lower(coalesce(summary, '')), '[\s—,;:()]+'), lambda x: length(x) > 4)) AS term FROM Y)
      WHERE term <> ''""",
    base=True,
)
def _(spark, d):
    delta = P.yaml_delta(_rule_files(Graph(spark, d)))
    return M.replace_terms(empty(spark, "terms"), delta.terms, delta.clear_empty)


# batches and the store


@_query("bulk_last_wins", "SELECT id, type, name, body, coalesce(metadata, '{}') AS metadata, source_path FROM entities WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY landed_at DESC, updated_at DESC, body DESC NULLS LAST, source_path DESC NULLS LAST) = 1")
def _(spark, d):
    """No order is given: that of the batch's rows holds."""
    batch = read_table(spark, d, "entities").orderBy("landed_at", "updated_at", "body", "source_path").drop("updated_at", "landed_at")
    return M.upsert_entities(empty(spark, "entities"), batch, "2025-07-01 00:00:00").drop("updated_at")


@_query("edges_last_wins", "SELECT * FROM G", base=True)
def _(spark, d):
    batch = read_table(spark, d, "edges").orderBy("landed_at", "metadata")
    return M.upsert_edges(empty(spark, "edges"), batch)


def _tables(store: GraphStore) -> DataFrame:
    s = store.read()
    parts = [s.entities.select(F.lit("entities").alias("kept"), F.col("id").alias("key")), s.edges.select(F.lit("edges"), F.concat_ws(" ", "src", "relation", "dst")), s.terms.select(F.lit("terms"), F.concat_ws(" ", "term", "entity_id"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@_query("store_tables", _KEPT_SQL + " SELECT 'entities' AS kept, id AS key FROM E UNION ALL SELECT 'edges', src || ' ' || relation || ' ' || dst FROM GE UNION ALL SELECT 'terms', term || ' ' || entity_id FROM TE", base=True)
def _(spark, d):
    return _tables(graph_store(spark, d))


@_query("store_edges_by_target", _KEPT_SQL + " SELECT dst, count(*) AS n FROM GE GROUP BY dst", base=True)
def _(spark, d):
    return graph_store(spark, d).read().table("edges_by_dst").groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "store_transaction",
    f"""WITH K AS (SELECT * FROM modules WHERE id <> '{HUB}')
    SELECT 'entities' AS kept, id AS key FROM K UNION ALL SELECT 'entities', 'new:a'
    UNION ALL SELECT 'edges', 'new:a cites ' || id FROM K
    UNION ALL SELECT DISTINCT 'terms', t || ' ' || id FROM (SELECT id, unnest([lower(owner), lower(name)]) AS t FROM K WHERE owner <> 'frio') UNION ALL SELECT 'terms', 'x ' || id FROM K WHERE owner = 'frio'""",
)
def _(spark, d):
    """The hub goes with its edges and terms; a new record cites all others; terms of an owner are replaced: in one version."""
    store = module_store(spark, d)[0]
    before = store.read().version
    with store.transaction() as t:
        t.delete_entities(spark.createDataFrame([(HUB,)], "id string"))
        ids = t.table("entities").select("id", F.get_json_object("metadata", "$.owner").alias("owner"))
        t.upsert_edges(ids.select(F.lit("new:a").alias("src"), F.col("id").alias("dst"), F.lit("cites").alias("relation")))
        t.upsert_entities(D.inline(spark, "entities", [{"id": "new:a", "type": "t", "name": "a"}]))
        t.replace_terms(ids.filter("owner = 'frio'").select(F.col("id").alias("entity_id"), F.array(F.lit("X")).alias("terms")))
    assert store.read().version == before + 1
    return _tables(store)


@_query("store_conflict", _values(("bad edge", "IntegrityError"), ("bad edge kept", "0"), ("old base", "ConflictError"), ("old base kept", "0"), ("winner kept", "1")))
def _(spark, d):
    store = GraphStore(spark, work_path(spark, "store"), lambda: CLOCK, parts=2)
    row = lambda id: D.inline(spark, "entities", [{"id": id, "type": "t", "name": id}])
    out = []
    try:
        with store.transaction() as t:
            t.upsert_entities(row("loser"))
            store.upsert_entities(row("winner"))
    except ConflictError as error:
        out.append(("old base", type(error).__name__))
    try:
        store.upsert_edges(D.inline(spark, "edges", [{"src": "winner", "dst": "winner", "relation": "r"}, {"src": "winner", "dst": "ghost", "relation": "r"}]))
    except IntegrityError as error:
        out.append(("bad edge", type(error).__name__))
    s = store.read()
    count = lambda id: str(s.entities.filter(F.col("id") == id).count())
    return _rows(spark, [*out, ("old base kept", count("loser")), ("winner kept", count("winner")), ("bad edge kept", str(s.edges.count()))])


@_query("store_index_sync", f"SELECT 'deleted' AS name, 0 AS n UNION ALL SELECT 'old', 0 UNION ALL SELECT 'new', count(*) FROM modules WHERE id <> '{HUB}' UNION ALL SELECT 'size', count(*) FROM modules WHERE id <> '{HUB}'")
def _(spark, d):
    """The index follows updates and deletes."""
    store = module_store(spark, d)[0]
    changed = store.read().entities.withColumn("body", F.lit("palabra estrenada"))
    store.upsert_entities(changed)
    store.delete_entities(spark.createDataFrame([(HUB,)], "id string"))
    kg, size = KnowledgeGraph(store), store.read().size.first()
    n = {"new": kg.find("estrenada", limit=-1).count(), "old": kg.find("body : cada", limit=-1).count(), "deleted": kg.find("name : nucleo", limit=-1).filter(F.col("id") == HUB).count(), "size": size["n"]}
    return _rows(spark, list(n.items()), "name string, n bigint")


@_query("store_history", _values((1, "migration 0001_init.sql"), (2, "ingest pages"), (3, "add terms"), (4, "clear terms"), columns="version, note"))
def _(spark, d):
    store = module_store(spark, d)[0]
    store.add_terms(spark.createDataFrame([(HUB, ["Uno"])], "entity_id string, terms array<string>"))
    store.clear_terms(spark.createDataFrame([(HUB,)], "id string"))
    return _rows(spark, [(h["version"], h["note"]) for h in store.history()], "version int, note string")


@_query("migrations", _values((1, "0001 0001_init.sql"), (2, "0002 0002_kind.sql"), (3, "0010 0010_terms.sql"), (4, "type unit"), (5, "terms 60"), (6, "again 3"), columns="n, value"))
def _(spark, d):
    store = module_store(spark, d)[0]
    folder = _write(spark, work_path(spark, "migrations"), {
        "0010_terms.sql": "REPLACE terms AS SELECT DISTINCT 'k' AS term, id AS entity_id FROM {entities};\n", "notes.md": "x", "10_x.sql": "x", "0003.sql": "x",
        "0002_kind.sql": "REPLACE entities AS SELECT id, 'unit' AS type, name, body, metadata, source_path, updated_at FROM {entities};\n",
    })
    lines = [f"{m['id']} {m['filename']}" for m in store.migrate(folder)]
    s = store.read()
    lines += [f"type {r['type']}" for r in s.entities.select("type").distinct().collect()] + [f"terms {s.terms.count()}", f"again {len(store.migrate(folder))}"]
    return _rows(spark, [(i + 1, x) for i, x in enumerate(lines)], "n int, value string")


# ingest


@_query(
    "run_ingest",
    f"""SELECT 'entitiesBefore' AS name, 0 AS n UNION ALL SELECT 'entitiesAfter', count(*) FROM modules UNION ALL SELECT 'edgesBefore', 0 UNION ALL SELECT 'edgesAfter', count(*) FROM modules WHERE id <> '{HUB}'
      UNION ALL SELECT 'entities', count(*) FROM modules UNION ALL SELECT 'edges', count(*) FROM modules WHERE id <> '{HUB}' UNION ALL SELECT 'term_sets', count(*) FROM modules
      UNION ALL SELECT 'rejected', 1 UNION ALL SELECT 'dropped', 0 UNION ALL SELECT 'logged', 3""",
)
def _(spark, d):
    log: list[str] = []
    _, result, delta = module_store(spark, d, log.append)
    numbers = {k: v for k, v in result.items() if isinstance(v, int) and k != "durationMs"} | delta.counters | {"logged": len(log)}
    return _rows(spark, list(numbers.items()), "name string, n bigint")


@_query("ingest_context", "SELECT owner, count(*) AS n, min('o=' || owner || ' 7') AS options FROM modules GROUP BY owner")
def _(spark, d):
    """A plugin reads the graph by SQL and takes its options."""
    store, seen = module_store(spark, d)[0], {}

    def run(ctx):
        seen["df"] = ctx.sql("SELECT get_json_object(metadata, '$.owner') AS owner, count(*) AS n FROM entities GROUP BY 1")
        seen["options"] = ctx.options

    run_ingest(store, types.SimpleNamespace(name="sql", run=run), coerce_options(["o=o", "n=7"]), lambda x: None)
    o = seen["options"]
    return seen["df"].withColumn("options", F.concat(F.lit(f"{o['o']}="), "owner", F.lit(f" {o['n']}")))


@_query("ingest_failure", _values(("error", "boom"), ("versions", "1"), ("none", "0")))
def _(spark, d):
    store = GraphStore(spark, work_path(spark, "store"), lambda: CLOCK, parts=2)

    def run(ctx):
        raise RuntimeError("boom")

    try:
        run_ingest(store, types.SimpleNamespace(name="p", run=run))
    except RuntimeError as error:
        said = str(error)
    nothing = run_ingest(store, types.SimpleNamespace(name="p", run=lambda ctx: None))
    return _rows(spark, [("error", said), ("versions", str(store.read().version)), ("none", str(nothing.entities_after))])


@_query("plugin_contract", _values(("an object", "p"), ("a factory", "p"), ("nothing", "plugin module did not export anything"), ("no plugin", "plugin module has no PLUGIN or make_plugin"), ("a number", "PLUGIN is not a valid plugin (missing name or run)"), ("a bad factory", "plugin factory did not return a valid plugin")))
def _(spark, d):
    good, module = types.SimpleNamespace(name="p", run=lambda ctx: None), types.SimpleNamespace
    cases = {"an object": module(PLUGIN=good), "a factory": module(make_plugin=lambda: good), "nothing": None, "no plugin": module(), "a number": module(PLUGIN=5), "a bad factory": module(make_plugin=lambda: 5)}
    out = []
    for name, given in cases.items():
        try:
            out.append((name, resolve_plugin(given).name))
        except PluginError as error:
            out.append((name, str(error)))
    return _rows(spark, out)


@_query("option_coercion", _values(("a", "bool true"), ("b", "bool false"), ("c", "int -3"), ("d", 'str "x=y"'), ("e", 'str "3.5"'), ("f", 'str ""')))
def _(spark, d):
    options = coerce_options(["a", "b=false", "c=-3", "d=x=y", "e=3.5", "f="])
    return _rows(spark, [(k, f"{type(v).__name__} {json.dumps(v)}") for k, v in options.items()])


@_query("exports", _values(*[(x,) for x in ("GraphDelta", "GraphStore", "IngestContext", "KnowledgeGraph", "Plugin", "QuerySyntaxError", "Snapshot", "build_session", "run_ingest", "search", "validate_rules_file")], columns="name"))
def _(spark, d):
    return _rows(spark, [(x,) for x in EXPORTS], "name string")


# rule checks


def _module_rules(spark: SparkSession, d: str) -> list[dict]:
    """Rules of the modules, with defects: types and numbers by place, no owner for ``frio``, no status without a body."""
    out = []
    for n, m in enumerate(_modules(spark, d)):
        rule = {"id": f"R-MOD-{n:03d}" if n % 3 else m["id"], "type": ["rule", "exception", "note"][n % 3 if n % 2 else 0], "summary": m["name"], "source_ref": m["path"]}
        rule |= {"owner": m["owner"]} if m["owner"] != "frio" else {}
        rule |= {"status": "active" if n % 5 else "open"} if m["body"] else {}
        rule |= {"applicability": {"evento": [m["name"]] if n % 4 else []}, "risk_note": "r"} if n % 7 else {"risk_note": "r"}
        rule |= {"related_objects": {"tables": [m["owner"]], "sps": [m["owner"], m["owner"]] if n % 2 else []}} if n % 6 else {}
        out.append(rule)
    return out


def _rule_file(spark: SparkSession, d: str, domain: str | None = "almacen") -> str:
    head = ({"domain": domain} if domain else {}) | {"version": "1", "created_at": "2025-01-01"}
    text = json.dumps({"metadata": head, "rules": _module_rules(spark, d)}, ensure_ascii=False)
    return _write(spark, work_path(spark, "rules"), {"r.yaml": text}) + "/r.yaml"


_MODULE_RULES = """WITH N AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS n FROM modules),
  V AS (SELECT n, CASE WHEN n % 3 > 0 THEN 'R-MOD-' || lpad(n::VARCHAR, 3, '0') ELSE id END AS id, CASE WHEN n % 2 = 0 THEN 'rule' ELSE ['rule', 'exception', 'note'][n % 3 + 1] END AS type, nullif(owner, 'frio') AS owner,
      CASE WHEN coalesce(body, '') <> '' THEN CASE WHEN n % 5 > 0 THEN 'active' ELSE 'open' END END AS status, n % 7 > 0 AS applies, n % 4 > 0 AS evento, n % 6 > 0 AS related, owner AS object, n % 2 > 0 AS has_sps FROM N),
  X AS (SELECT n, id, 'table:' || object AS ref, 1 AS k FROM V WHERE related UNION ALL SELECT n, id, 'sp:' || object, 2 FROM V WHERE related AND has_sps),
  ISSUES AS (
    SELECT id || ': missing_field applicability' AS line FROM V WHERE NOT applies UNION ALL SELECT id || ': missing_field owner' FROM V WHERE owner IS NULL UNION ALL SELECT id || ': missing_field status' FROM V WHERE status IS NULL
    UNION ALL SELECT id || ': bad_id ' || id FROM V WHERE n % 3 = 0 UNION ALL SELECT id || ': bad_type note' FROM V WHERE type = 'note' UNION ALL SELECT id || ': prefix_type ' || type FROM V WHERE n % 3 > 0 AND type <> 'rule'
    UNION ALL SELECT id || ': bad_status open' FROM V WHERE status = 'open' UNION ALL SELECT id || ': empty_evento applicability.evento' FROM V WHERE applies AND NOT evento),
  REFS AS (SELECT id || ': reference to ' || ref || ' is not in the graph and was not registered' AS line FROM (SELECT id, ref, unnest(range(k)) FROM X))"""


@_query("validate_errors", _MODULE_RULES + " SELECT line FROM ISSUES UNION ALL SELECT line FROM REFS")
def _(spark, d):
    store = GraphStore(spark, work_path(spark, "store"), lambda: CLOCK, parts=2)
    return _rows(spark, [(x,) for x in validate_rules_file(store, _rule_file(spark, d)).errors], "line string")


@_query(
    "validate_stats",
    _MODULE_RULES + """ SELECT 'totalRules' AS name, count(*) AS n FROM V UNION ALL SELECT 'referencesRejected', sum(k) FROM X UNION ALL SELECT 'newObjectsRegistered', 0 UNION ALL SELECT 'warnings', count(*) FROM V WHERE NOT related UNION ALL SELECT 'prefix_type', count(*) FROM ISSUES WHERE line LIKE '%: prefix_type %'""",
)
def _(spark, d):
    store = GraphStore(spark, work_path(spark, "store"), lambda: CLOCK, parts=2)
    r = validate_rules_file(store, _rule_file(spark, d))
    numbers = {k: v for k, v in r.stats.items() if isinstance(v, int)} | {"warnings": len(r.warnings), "prefix_type": sum(": prefix_type " in e for e in r.errors)}
    return _rows(spark, list(numbers.items()), "name string, n bigint")


@_query(
    "validate_registers",
    _MODULE_RULES + """, O AS (SELECT ref, min(n) AS first FROM X GROUP BY ref),
      NEW AS (SELECT ref, split_part(ref, ':', 1) AS kind, split_part(ref, ':', 2) AS name FROM O)
      SELECT 'entity' AS what, ref || ' ' || CASE kind WHEN 'table' THEN 'table Tabla nueva registrada durante validación de reglas' ELSE 'stored_procedure SP nuevo registrado durante validación de reglas' END AS line FROM NEW
      UNION ALL SELECT DISTINCT 'term', ref || ' ' || unnest([lower(name), 'almacen']) FROM NEW
      UNION ALL SELECT 'registered', (SELECT sum(k) FROM X JOIN O ON O.ref = X.ref AND O.first = X.n)::VARCHAR UNION ALL SELECT 'rejected', '0'""",
)
def _(spark, d):
    store = GraphStore(spark, work_path(spark, "store"), lambda: CLOCK, parts=2)
    stats = validate_rules_file(store, _rule_file(spark, d), auto_register=True).stats
    s = store.read()
    made = s.entities.select(F.lit("entity").alias("what"), F.concat_ws(" ", "id", "type", "body").alias("line"))
    made = made.unionAll(s.terms.select(F.lit("term"), F.concat_ws(" ", "entity_id", "term")))
    return made.unionAll(_rows(spark, [("registered", str(stats["newObjectsRegistered"])), ("rejected", str(stats["referencesRejected"]))], "what string, line string"))


@_query(
    "validate_warnings",
    _MODULE_RULES + """ SELECT 'given' AS known, id || ': no related_objects' AS line FROM V WHERE NOT related UNION ALL SELECT 'found', id || ': no related_objects' FROM V WHERE NOT related
      UNION ALL SELECT 'given', 'metadata.domain "almacen" is not known' UNION ALL SELECT 'no domain', id || ': no related_objects' FROM V WHERE NOT related UNION ALL SELECT 'no domain', 'metadata.domain is required'""",
)
def _(spark, d):
    """Domains that are given hold before those found in the graph; a missing one is an error."""
    store = GraphStore(spark, work_path(spark, "store"), lambda: CLOCK, parts=2)
    path, out = _rule_file(spark, d), []
    store.upsert_entities(D.inline(spark, "entities", [{"id": "a", "type": "t", "name": "a", "metadata": '{"domain": "almacen"}'}]))
    for name, known, file in (("given", ["otro"], path), ("found", None, path), ("no domain", None, _rule_file(spark, d, None))):
        r = validate_rules_file(store, file, known_domains=known)
        out += [(name, x) for x in r.warnings + [e for e in r.errors if e.startswith("metadata")]]
    return _rows(spark, out, "known string, line string")


@_query("validate_broken", _values(("broken", "unknown", 0, 1), ("no rules", "unknown", 0, 1), ("no metadata", "unknown", 0, 3), ("fine", "d", 1, 0), columns="name, domain, rules, errors"))
def _(spark, d):
    store = GraphStore(spark, work_path(spark, "store"), lambda: CLOCK, parts=2)
    fine = {"id": "R-AB-001", "type": "rule", "summary": "s", "applicability": {"evento": ["e"]}, "source_ref": "x", "owner": "o", "status": "draft", "risk_note": "r", "related_objects": {}}
    head = {"domain": "d", "version": "1", "created_at": "x"}
    files = {"broken": "a: [", "no rules": "x: 1", "no metadata": "rules: []", "fine": json.dumps({"metadata": head, "rules": [fine]})}
    folder = _write(spark, work_path(spark, "rules"), {f"{k}.yaml": v for k, v in files.items()})
    found = [(k, validate_rules_file(store, f"{folder}/{k}.yaml")) for k in files]
    return _rows(spark, [(k, r.stats["domain"], r.stats["totalRules"], len(r.errors)) for k, r in found], "name string, domain string, rules int, errors int")


@_query("prefix_type", _RULES + " SELECT id, type FROM R WHERE CASE id[1] WHEN 'r' THEN 'rule' WHEN 'e' THEN 'exception' WHEN 's' THEN 'sla' WHEN 'd' THEN 'rule' END <> type", base=True)
def _(spark, d):
    """The first character of an id tells what its type should be; here no decision is what it should."""
    spec = RuleSpec(id_pattern="^[a-z]", prefixes=(("r", "rule"), ("e", "exception"), ("s", "sla"), ("d", "rule")))
    return schema_issues(Graph(spark, d).rules(), spec).filter("code = 'prefix_type'").select(F.col("label").alias("id"), F.col("detail").alias("type"))


# tools and command line


@_query("tool_registry", _values((0, "kb_find"), (1, "kb_get"), (2, "kb_by_term"), (3, "kb_traverse"), (4, "kb_related"), (5, "kb_add_entity"), (6, "kb_add_edge"), (10, "kb_find"), (11, "kb_get"), (12, "kb_by_term"), (13, "kb_traverse"), (14, "kb_related"), columns="n, tool"))
def _(spark, d):
    store = GraphStore(spark, work_path(spark, "store"))
    tools = [(i, t) for i, t in enumerate(KnowledgeGraph(store, allow_writes=True).tools())]
    return _rows(spark, tools + [(10 + i, t) for i, t in enumerate(KnowledgeGraph(store).tools())], "n int, tool string")


@_query("tool_get", """ SELECT true AS found, id, type, name, body, source_path AS "sourcePath", strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS "updatedAt" FROM E WHERE id = (SELECT id FROM S)
    UNION ALL SELECT false, 'ghost', NULL, NULL, NULL, NULL, NULL""", base=True)
def _(spark, d):
    kg, start = KnowledgeGraph(graph_store(spark, d)), Graph(spark, d).start()
    got = [kg.call("kb_get", id=x) for x in (start, "ghost")]
    columns = ("id", "type", "name", "body", "sourcePath", "updatedAt")
    rows = [(g["found"], *[({"id": g.get("id")} | g.get("entity", {})).get(c) for c in columns]) for g in got]
    return _rows(spark, rows, "found boolean, id string, type string, name string, body string, sourcePath string, updatedAt string")


def _rampa(limit: int) -> str:
    return _find_sql([_tf(_is("rampa"))], "tf0 > 0", limit=f"ORDER BY rank, id LIMIT {limit}")


@_query("tool_find", _rampa(100), base=True)
def _(spark, d):
    got = KnowledgeGraph(graph_store(spark, d)).call("kb_find", query="rampa", limit=100)
    assert got["count"] == len(got["hits"])
    return _rows(spark, [(h["id"], round(h["rank"], 10)) for h in got["hits"]], "id string, rank double")


@_query("tool_by_term", " SELECT id, type, name FROM E WHERE id IN (SELECT entity_id FROM T WHERE term = 'operación') ORDER BY updated_at DESC, id LIMIT 20", base=True)
def _(spark, d):
    got = KnowledgeGraph(graph_store(spark, d)).call("kb_by_term", term="OPERACIÓN")
    return _rows(spark, [(h["id"], h["type"], h["name"]) for h in got["hits"]], "id string, type string, name string")


@_query("tool_traverse", """, found AS (SELECT G.dst AS id, 1 AS depth, min(relation) AS relation FROM G JOIN E ON E.id = G.dst WHERE src = (SELECT id FROM S) AND dst <> src GROUP BY G.dst)
    SELECT id, 0 AS depth, NULL AS relation FROM S UNION ALL SELECT * FROM found""", base=True)
def _(spark, d):
    got = KnowledgeGraph(graph_store(spark, d)).call("kb_traverse", id=Graph(spark, d).start(), maxDepth=1)
    return _rows(spark, [(r["entity"]["id"], r["depth"], r["relation"]) for r in got["results"]], "id string, depth int, relation string")


@_query("tool_related", _KEPT_SQL + " SELECT 'outgoing' AS direction, src, dst, relation FROM GE WHERE src = (SELECT id FROM S) UNION ALL SELECT 'incoming', src, dst, relation FROM GE WHERE dst = (SELECT id FROM S)", base=True)
def _(spark, d):
    got = KnowledgeGraph(graph_store(spark, d)).call("kb_related", id=Graph(spark, d).start())
    assert (got["outgoingCount"], got["incomingCount"]) == (len(got["outgoing"]), len(got["incoming"]))
    return _rows(spark, [(w, e["src"], e["dst"], e["relation"]) for w in ("outgoing", "incoming") for e in got[w]], "direction string, src string, dst string, relation string")


@_query(
    "tool_writes",
    _values(
        ("add", '{"upserted": true, "id": "a"}'), ("edge", '{"upserted": true, "src": "a", "dst": "a", "relation": "r"}'), ("ghost", '{"error": "missing_endpoint", "srcExists": true, "dstExists": false, "hint": "add the missing entity first", "isError": true}'),
        ("get", '{"found": true, "entity": {"id": "a", "type": "t", "name": "dos", "body": null, "metadata": {}, "sourcePath": null, "updatedAt": "2025-07-01T00:00:00.000Z"}}'), ("read only", '{"error": "unknown tool kb_add_entity", "isError": true}'),
        ("related", '{"id": "a", "outgoingCount": 1, "incomingCount": 1, "outgoing": [{"src": "a", "dst": "a", "relation": "r", "metadata": {"k": [1]}}], "incoming": [{"src": "a", "dst": "a", "relation": "r", "metadata": {"k": [1]}}]}'),
    ),
)
def _(spark, d):
    """An upsert leaves nothing of the row before; edges survive it; times are of the clock."""
    store = GraphStore(spark, work_path(spark, "store"), lambda: CLOCK, parts=2)
    store.migrate()
    kg = KnowledgeGraph(store, allow_writes=True)
    out = {"add": kg.call("kb_add_entity", id="a", type="t", name="uno", body="b", metadata={"k": 1}, sourcePath="p")}
    out["edge"] = kg.call("kb_add_edge", src="a", dst="a", relation="r", metadata={"k": [1]})
    out["ghost"] = kg.call("kb_add_edge", src="a", dst="ghost", relation="r")
    kg.call("kb_add_entity", id="a", type="t", name="dos")
    out |= {"get": kg.call("kb_get", id="a"), "related": kg.call("kb_related", id="a"), "read only": KnowledgeGraph(store).call("kb_add_entity", id="b", type="t", name="n")}
    return _rows(spark, [(k, json.dumps(v, ensure_ascii=False)) for k, v in out.items()])


@_query(
    "tool_errors",
    _values(
        ("empty id", "id must be a non-empty string"), ("empty query", "query must be a non-empty string"), ("limit 0", "limit must be an integer from 1 to 100"), ("limit 101", "limit must be an integer from 1 to 100"), ("limit 1.5", "limit must be an integer from 1 to 100"),
        ("depth 11", "max_depth must be an integer from 0 to 10"), ("unknown", "unknown tool kb_drop"),
    ),
)
def _(spark, d):
    kg = KnowledgeGraph(GraphStore(spark, work_path(spark, "store")))
    calls = {"empty id": ("kb_get", {"id": ""}), "empty query": ("kb_find", {"query": ""}), "limit 0": ("kb_find", {"query": "a", "limit": 0}), "limit 101": ("kb_by_term", {"term": "a", "limit": 101}), "limit 1.5": ("kb_find", {"query": "a", "limit": 1.5})}
    calls |= {"depth 11": ("kb_traverse", {"id": "a", "maxDepth": 11}), "unknown": ("kb_drop", {})}
    return _rows(spark, [(k, kg.call(tool, **args)["error"]) for k, (tool, args) in calls.items()])


@_query("library_limits", " SELECT '-1' AS name, count(*)::VARCHAR AS value FROM T WHERE term = 'operación' AND entity_id IN (SELECT id FROM E) UNION ALL SELECT '0', '0' UNION ALL SELECT 'text', 'refused' UNION ALL SELECT 'none', 'refused'", base=True)
def _(spark, d):
    kg, out = KnowledgeGraph(graph_store(spark, d)), []
    for name, limit in (("-1", -1), ("0", 0), ("text", "7"), ("none", None)):
        try:
            out.append((name, str(kg.by_term("operación", limit=limit).count())))
        except ValueError:
            out.append((name, "refused"))
    return _rows(spark, out)


@_query("optional_filters", " SELECT 'count' AS name, 0 AS n UNION ALL SELECT 'outgoing', 0 UNION ALL SELECT 'by_term', count(*) FROM E WHERE id IN (SELECT entity_id FROM T WHERE term = 'operación') UNION ALL SELECT 'find', count(*) FROM (" + _find_sql([_tf(_is("rampa"))], "tf0 > 0").lstrip(", ").replace("D AS", "WITH D AS", 1) + ")", base=True)
def _(spark, d):
    """The empty string filters counts and edges, and matches nothing; for searches it is no filter."""
    s, g = graph_store(spark, d).read(), Graph(spark, d)
    found = search(s.entities, "rampa", type="", limit=-1, postings=s.postings, size=s.size, with_snippet=False)
    n = {"count": L.count_entities(s.entities, "").first()["c"], "outgoing": G.outgoing(s.edges, g.start(), "").count(), "by_term": L.by_term(s.entities, s.terms, "operación", "", -1).count(), "find": found.count()}
    return _rows(spark, list(n.items()), "name string, n bigint")


@_query("types_in_order", " SELECT row_number() OVER (ORDER BY type) AS place, type, count(*) AS c FROM E GROUP BY type", base=True)
def _(spark, d):
    rows = L.count_by_type(graph_store(spark, d).read().entities).collect()  # a row for each type
    return _rows(spark, [(i + 1, r["type"], r["c"]) for i, r in enumerate(rows)], "place bigint, type string, c bigint")


def _cli(spark: SparkSession, store: str, *args: str) -> tuple[int, str, str]:
    out, err = io.StringIO(), io.StringIO()
    with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
        code = main([*args, "--db", store], spark)
    return code, out.getvalue(), err.getvalue()


@_query("cli_status", _KEPT_SQL + """ SELECT 'entities' AS name, count(*) AS n FROM E UNION ALL SELECT 'edges', count(*) FROM GE UNION ALL SELECT 'terms', count(*) FROM TE UNION ALL SELECT 'types', count(DISTINCT type) FROM E UNION ALL SELECT 'migrations', 1""", base=True)
def _(spark, d):
    got = json.loads(_cli(spark, graph_store(spark, d).root, "status")[1])
    n = {"entities": got["entities"]["total"], "types": len(got["entities"]["byType"]), "migrations": len(got["migrations"])} | {k: got[k] for k in ("edges", "terms")}
    return _rows(spark, list(n.items()), "name string, n bigint")


@_query("cli_find", _rampa(7), base=True)
def _(spark, d):
    got = json.loads(_cli(spark, graph_store(spark, d).root, "query", "find", "rampa", "--limit", "7")[1])
    return _rows(spark, [(h["id"], round(h["rank"], 10)) for h in got["hits"]], "id string, rank double")


@_query("cli_term", " SELECT 'Operación' AS term, id FROM E WHERE type = 'rule' AND id IN (SELECT entity_id FROM T WHERE term = 'operación') ORDER BY updated_at DESC, id LIMIT 20", base=True)
def _(spark, d):
    got = json.loads(_cli(spark, graph_store(spark, d).root, "query", "term", "Operación", "--type", "rule")[1])
    return _rows(spark, [(got["term"], h["id"]) for h in got["hits"]], "term string, id string")


@_query("cli_related", _KEPT_SQL + " SELECT 'outgoing' AS direction, src, dst, relation FROM GE WHERE src = (SELECT id FROM S) UNION ALL SELECT 'incoming', src, dst, relation FROM GE WHERE dst = (SELECT id FROM S)", base=True)
def _(spark, d):
    got = json.loads(_cli(spark, graph_store(spark, d).root, "query", "related", Graph(spark, d).start())[1])
    return _rows(spark, [(w, e["src"], e["dst"], e["relation"]) for w in ("outgoing", "incoming") for e in got[w]], "direction string, src string, dst string, relation string")


@_query("cli_init_and_validate", _values(("init", 0, "migrations: 1"), ("ingest", 0, "entitiesAfter: 60"), ("get", 0, "found"), ("validate", 1, "errors and stats")).replace("AS t(name, value)", "AS t(name, code, said)"))
def _(spark, d):
    db = work_path(spark, "db")
    said = _cli(spark, db, "init")
    out = [("init", said[0], "migrations: 1" if "1 migration" in said[1] else said[1])]
    said = _cli(spark, db, "ingest", "--plugin", pages.__file__, "--opt", f"root={module_pages(spark, d)}")
    out.append(("ingest", said[0], f"entitiesAfter: {json.loads(said[1])['entitiesAfter']}"))
    said = _cli(spark, db, "query", "get", HUB)
    out.append(("get", said[0], "found" if json.loads(said[1])["found"] else said[1]))
    said = _cli(spark, db, "validate", "--file", _rule_file(spark, d), "--auto-register")
    out.append(("validate", said[0], "errors and stats" if "error: " in said[2] and '"totalRules": 60' in said[2] else said[2]))
    return _rows(spark, out, "name string, code int, said string")


# serving


_MESSAGES = [
    {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {"protocolVersion": "2025-03-26"}},
    {"jsonrpc": "2.0", "method": "notifications/initialized"},
    {"jsonrpc": "2.0", "id": 2, "method": "tools/call", "params": {"name": "kb_get", "arguments": {"id": HUB}}},
    {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "kb_find", "arguments": {"query": "(a"}}},
    {"jsonrpc": "2.0", "id": 4, "method": "nope"},
    {"jsonrpc": "2.0", "id": 5, "method": "ping"},
]
_ANSWERS = (("1", "2025-03-26"), ("2", HUB), ("3", "isError"), ("4", "-32601"), ("5", "{}"))


def _said(answer: dict) -> tuple[str, str]:
    """What an answer is about, in short."""
    result = answer.get("result", {})
    if "content" in result:
        text = "isError" if result["isError"] else json.loads(result["content"][0]["text"])["entity"]["id"]
    else:
        text = str(answer["error"]["code"]) if "error" in answer else result.get("protocolVersion") or json.dumps(result)
    return str(answer["id"]), text


@_query("serve_lines", _values(*_ANSWERS, ("None", "-32700"), ("6", "7")))
def _(spark, d):
    lines = [json.dumps(m) for m in _MESSAGES] + ["", "{broken", json.dumps({"jsonrpc": "2.0", "id": 6, "method": "tools/list"})]
    out = io.StringIO()
    serve_lines(KnowledgeGraph(module_store(spark, d)[0], allow_writes=True), io.StringIO("\n".join(lines)), out)
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    return _rows(spark, [_said(a) if "tools" not in a.get("result", {}) else (str(a["id"]), str(len(a["result"]["tools"]))) for a in answers])


@_query("serve_http", _values(*_ANSWERS, ("health", "200"), ("no session", "400"), ("notification", "202"), ("stream", "405"), ("end", "200"), ("ended", "400")))
def _(spark, d):
    server = http_server(KnowledgeGraph(module_store(spark, d)[0]), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(method: str, path: str, message=None, session: str | None = None):
        link = http.client.HTTPConnection("127.0.0.1", server.server_port, timeout=60)
        link.request(method, path, json.dumps(message) if message else None, {"Mcp-Session-Id": session} if session else {})
        answer = link.getresponse()
        return answer.status, answer.headers.get("Mcp-Session-Id"), answer.read()

    try:
        out = [("health", str(ask("GET", "/health")[0])), ("no session", str(ask("POST", "/mcp", _MESSAGES[2])[0]))]
        _, session, first = ask("POST", "/mcp", _MESSAGES[0])
        out += [_said(json.loads(first)), ("notification", str(ask("POST", "/mcp", _MESSAGES[1], session)[0]))]
        out += [_said(json.loads(ask("POST", "/mcp", m, session)[2])) for m in _MESSAGES[2:]]
        out += [("stream", str(ask("GET", "/mcp", session=session)[0])), ("end", str(ask("DELETE", "/mcp", session=session)[0])), ("ended", str(ask("POST", "/mcp", _MESSAGES[5], session)[0]))]
    finally:
        server.shutdown()
        server.server_close()
    return _rows(spark, out)


# full text over the index of the store


def _find(name: str, query: str, sql: str, **options):
    @_query(name, sql, base=True)
    def _(spark, d):
        s = graph_store(spark, d).read()
        found = search(s.entities, query, limit=options.get("limit", -1), type=options.get("type"), postings=s.postings, size=s.size, with_snippet=False)
        return found.select("id", F.round("rank", 10).alias("rank"))


_find("find_term", "pallet", _find_sql([_tf(_is("pallet"))], "tf0 > 0", limit="ORDER BY rank, id LIMIT 20"), limit=20)
_find("find_typed", "rampa", _find_sql([_tf(_is("rampa"))], "tf0 > 0", type_="AND type = 'rule'"), type="rule")
_find("find_and", "rampa cámara", _find_sql([_tf(_is("rampa")), _tf(_is("camara"))], "tf0 > 0 AND tf1 > 0"))
_find("find_or", "Palé OR pallet", _find_sql([_tf(_is("pale")), _tf(_is("pallet"))], "tf0 > 0 OR tf1 > 0"))
_find("find_not", "flota NOT carga", _find_sql([_tf(_is("flota")), _tf(_is("carga"))], "tf0 > 0 AND tf1 = 0", [0]))
_find("find_prefix", "romane*", _find_sql([_tf("starts_with(w[i], 'romane')")], "tf0 > 0"))
_find("find_phrase", '"salvo los feriados"', _find_sql([_tf("w[i] = 'salvo' AND w[i + 1] = 'los' AND w[i + 2] = 'feriados'", size=3)], "tf0 > 0"))
_find("find_near", "NEAR(rampa flota, 3)", _find_sql([(_tf(_near("rampa", "flota")), _tf(_is("rampa"))), (_tf(_near("flota", "rampa")), _tf(_is("flota")))], "tf0 > 0 AND tf1 > 0"))
_find("find_column", "name : carga", _find_sql([_tf(_is("carga"), (0,))], "tf0 > 0"))
_find("find_initial", "body : ^cada", _find_sql([_tf("i = 1 AND w[i] = 'cada'", (1,))], "tf0 > 0"))
_THREE = [_tf(_is("rampa")), _tf(_is("muelle")), _tf(_is("flota"))]
_find("find_parens", "(rampa OR muelle) AND flota", _find_sql(_THREE, "(tf0 > 0 OR tf1 > 0) AND tf2 > 0"))
_if = "CASE WHEN {} > 0 THEN {} ELSE 0 END".format  # a phrase scores where the expression around it matches
_BOTH = [(_if(_THREE[1], _THREE[0]), _THREE[0]), (_if(_THREE[0], _THREE[1]), _THREE[1]), _THREE[2]]
_find("find_precedence", "flota OR rampa AND muelle", _find_sql(_BOTH, "tf2 > 0 OR (tf0 > 0 AND tf1 > 0)"))
_find("find_nested", "(rampa AND muelle) OR flota", _find_sql(_BOTH, "(tf0 > 0 AND tf1 > 0) OR tf2 > 0"))
_find("find_twice", "rampa rampa", _find_sql([_THREE[0], _THREE[0]], "tf0 > 0"))

_BAD = ["base-360", "what?", "a, b", "a.b", "(a", "a AND", "", "*", "nope : a"]


@_query("find_errors", _values(*[(x, "refused") for x in _BAD], ("and", "taken"), ("a b", "taken"), ('"a b" *', "taken")))
def _(spark, d):
    out = []
    for query in [*_BAD, "and", "a b", '"a b" *']:
        try:
            parse(query)
            out.append((query, "taken"))
        except QuerySyntaxError:
            out.append((query, "refused"))
    return _rows(spark, out)


_LETTER = "la carga lenta pasa por el muelle norte cuando un palé frágil espera en la cámara fría y nadie firma el remito".split()
# Query, record and snippet as SQLite's FTS5 gives it for these texts (16 tokens, << and >>, …).
_SNIPPETS = [
    ('remito', '2', 'el norte un frágil en cámara y firma <<remito>>. carga pasa el norte un frágil'),
    ('remito', '3', '…cámara nadie <<remito>> lenta el cuando frágil la y. el carga por norte palé en'),
    ('remito', '4', 'cámara firma carga el un en y <<remito>> pasa. norte frágil cámara firma carga el un…'),
    ('remito', '5', '…carga muelle frágil fría <<remito>> por un la firma. lenta norte espera y la el'),
    ('remito', '6', 'pasa un cámara <<remito>> el frágil y carga norte. en firma pasa un cámara <<remito>> el…'),
    ('remito', '7', 'cuando cámara la norte la <<remito>> muelle en el. el espera firma por frágil nadie pasa…'),
    ('remito', '8', 'en <<remito>> norte cámara carga un y pasa frágil. firma el en <<remito>> norte cámara carga…'),
    ('palé OR muelle', '3', '<<palé>> en fría firma la pasa <<muelle>> un espera. cámara nadie remito lenta el cuando frágil…'),
    ('palé OR muelle', '5', '…la el <<palé>> cámara el pasa cuando en nadie. carga <<muelle>> frágil fría remito por un…'),
    ('palé OR muelle', '7', '…remito <<muelle>> en el el espera firma por frágil. nadie pasa <<palé>> y lenta un fría…'),
    ('NEAR(carga lenta, 2)', '1', 'la <<carga>> <<lenta>> pasa por el'),
    ('NEAR(carga lenta, 2)', '7', '…<<lenta>> un fría <<carga>> cuando cámara la norte la. remito muelle en el el espera firma…'),
    ('name : n5', '6', 'pasa un cámara remito el frágil y carga norte. en firma pasa un cámara remito el…'),
]


@_query("snippet_cases", _values(*_SNIPPETS, columns="query, id, snippet"))
def _(spark, d):
    bodies = [" ".join(_LETTER[(i * 5 + k * (i + 1)) % len(_LETTER)] + ("." if k % 9 == 8 else "") for k in range(6 + 9 * i)) for i in range(8)]
    entities = D.inline(spark, "entities", [{"id": str(i + 1), "type": "t", "name": f"n{i}", "body": b} for i, b in enumerate(bodies)])
    found = [search(entities, q, limit=-1).select(F.lit(q).alias("query"), "id", "snippet") for q in ("remito", "palé OR muelle", "NEAR(carga lenta, 2)", "name : n5")]
    return reduce(DataFrame.unionAll, found)


@_query("traverse_cycle", _values(("a", 0, None), ("b", 1, "r"), ("c", 2, "r"), columns="id, depth, relation"))
def _(spark, d):
    """A walk ends where it has been: a cycle of three with a loop, and a target that is no entity."""
    entities = D.inline(spark, "entities", [{"id": x, "type": "t", "name": x} for x in "abc"])
    edges = D.inline(spark, "edges", [{"src": s, "dst": t, "relation": "r"} for s, t in ("ab", "bc", "ca", "bb", "cx")])
    return G.traverse(entities, edges, "a", max_depth=10).select("id", "depth", "relation")
