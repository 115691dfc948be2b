"""Queries of the graph operators over the test tables, and the same in SQL.

Entities are the current rows of the deliveries, edges one row per key with the metadata that landed last,
terms the distinct lower-case pairs. Parameters that the tables decide (a node to start from) are the smallest
id that fits, in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import excerpt, keywords
from ..operators import graph as G
from ..operators import integrity as X
from ..operators import lookup as L
from ..operators import mutations as M
from ..operators.current import current_rows
from ..session import read_table
from ..sources import documents as D
from ..sources import plugins as P
from ..validate import mentions, schema_issues
from .fts_plan import build_postings, corpus_size, search

NOW = "2025-07-01 00:00:00"


class Graph:
    """The projection of the test tables onto the graph."""

    def __init__(self, spark: SparkSession, d: str):
        self.raw = {n: read_table(spark, d, n) for n in ("entities", "edges", "terms", "components", "deletions")}
        columns = ("type", "name", "body", "metadata", "source_path", "updated_at")
        self.entities = current_rows(self.raw["entities"], *columns)
        last = F.max(F.struct("landed_at", "metadata")).alias("m")
        keyed = self.raw["edges"].groupBy("src", "dst", "relation").agg(last)
        self.edges = keyed.select("src", "dst", "relation", F.coalesce("m.metadata", F.lit("{}")).alias("metadata"))
        pairs = self.raw["terms"].filter((F.col("term") != "") & (F.col("entity_id") != ""))
        self.terms = pairs.select(F.lower("term").alias("term"), "entity_id").distinct()

    def start(self) -> str:
        """The smallest id with an edge to another entity."""
        ids = self.entities.select("id")
        both = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return both.agg(F.min("src")).first()[0]

    def entries(self) -> DataFrame:
        """Component manifests as entries of JSON values."""
        c = self.raw["components"].dropDuplicates(["id"])
        value = lambda k: F.regexp_replace(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", "$1")
        names = ["id", "type", "name", "body", "owner", "stability"]
        parts = F.create_map(*[x for k in names for x in (F.lit(k), value(k))], *[x for k in ("terms", "depends_on") for x in (F.lit(k), F.to_json(k))])
        return c.select(F.col("path").alias("source_path"), F.map_filter(parts, lambda k, v: v.isNotNull() & (v != "null")).alias("values"))

    def rules(self) -> DataFrame:
        """Rule-like entities as parsed rules."""
        kinds = self.entities.filter(F.col("type").isin("rule", "exception", "sla", "decision"))
        kinds = kinds.withColumn("metadata", F.when(F.try_parse_json("metadata").isNotNull(), F.col("metadata")))
        meta = lambda k: F.get_json_object("metadata", f"$.{k}")
        texts = lambda k: F.coalesce(F.from_json(meta(k), "array<string>"), F.array().cast("array<string>"))
        none = F.lit(None).cast("string")
        return kinds.select(
            "source_path", F.lit(0).alias("n"), "id", "type", F.col("name").alias("summary"), none.alias("subdomain"), meta("owner").alias("owner"), meta("status").alias("status"),
            meta("severity").alias("risk_note"), F.col("source_path").alias("source_ref"), F.lit(True).alias("has_applicability"), (F.size(texts("eventos")) > 0).alias("evento_valid"),
            texts("eventos").alias("eventos"), F.lit(None).cast("string").alias("action"), F.array().cast("array<string>").alias("tables"), F.array().cast("array<string>").alias("sps"),
            F.array().cast("array<struct<field:string,op:string,value:string>>").alias("conditions"),
        )


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_BASE = r"""
E AS (SELECT * FROM entities WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1),
G AS (SELECT src, dst, relation, coalesce(metadata, '{}') AS metadata FROM edges
  QUALIFY row_number() OVER (PARTITION BY src, dst, relation ORDER BY landed_at DESC, metadata DESC NULLS LAST) = 1),
T AS (SELECT DISTINCT lower(term) AS term, entity_id FROM terms WHERE term <> '' AND entity_id <> ''),
S AS (SELECT min(src) AS id FROM G WHERE src IN (SELECT id FROM E) AND dst IN (SELECT id FROM E))
"""
_STAMP = "strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at"


def _query(name: str, sql: str | None = None, recursive: bool = False):
    def add(f):
        QUERIES[name] = lambda spark, d: f(Graph(spark, d))
        if sql is not None:
            ORACLE_SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{_BASE}{sql}"
        return f

    return add


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


_ENTITY = f"id, type, name, body, metadata, source_path, {_STAMP}"


@_query("get_entity", f"SELECT {_ENTITY} FROM E WHERE id = (SELECT id FROM S)")
def _(g):
    return _stamped(L.get_entity(g.entities, g.start()))


@_query("list_by_type", f"SELECT {_ENTITY} FROM E WHERE type = 'rule' ORDER BY E.updated_at DESC, id LIMIT 100")
def _(g):
    return _stamped(L.list_by_type(g.entities, "rule"))


@_query("count_all", "SELECT count(*) AS c FROM E")
def _(g):
    return L.count_entities(g.entities)


@_query("count_typed", "SELECT count(*) AS c FROM E WHERE type = 'term'")
def _(g):
    return L.count_entities(g.entities, "term")


@_query("count_by_type", "SELECT type, count(*) AS c FROM E GROUP BY type")
def _(g):
    return L.count_by_type(g.entities)


@_query("status_summary", "SELECT (SELECT count(*) FROM E) AS total, (SELECT count(DISTINCT type) FROM E) AS n_types, (SELECT count(*) FROM G) AS edges, (SELECT count(*) FROM T) AS terms")
def _(g):
    return L.status(g.entities, g.edges, g.terms).select("total", F.size("by_type").cast("bigint").alias("n_types"), "edges", "terms")


@_query("json_distinct", "SELECT DISTINCT json_extract_string(metadata, '$.status') AS value FROM E WHERE json_valid(metadata) AND json_extract_string(metadata, '$.status') <> ''")
def _(g):
    valid = g.entities.filter(F.try_parse_json("metadata").isNotNull())  # half a broken text may still have the path
    return L.json_distinct(valid, "$.status")


@_query("json_filter", "SELECT id FROM E WHERE json_valid(metadata) AND json_extract_string(metadata, '$.owner') = 'frio'")
def _(g):
    return L.json_filter(g.entities.filter(F.try_parse_json("metadata").isNotNull()), "$.owner", "frio").select("id")


_EXCERPT = "CASE WHEN length(body) > 140 THEN substring(body, 1, 140) || '…' ELSE coalesce(body, '') END"
_BY_TERM = f"SELECT id, type, name, {_EXCERPT} AS snippet FROM E WHERE id IN (SELECT entity_id FROM T WHERE term = 'operación')"


@_query("by_term", f"{_BY_TERM} ORDER BY updated_at DESC, id LIMIT 20")
def _(g):
    return L.by_term(g.entities, g.terms, "Operación").drop("updated_at")


@_query("by_term_typed", f"{_BY_TERM} AND type = 'rule'")
def _(g):
    return L.by_term(g.entities, g.terms, "operación", "rule", -1).drop("updated_at")


@_query("excerpt", f"SELECT id, {_EXCERPT} AS snippet FROM E")
def _(g):
    return g.entities.select("id", excerpt(F.col("body")).alias("snippet"))


# graph

@_query("outgoing", "SELECT * FROM G WHERE src = (SELECT id FROM S)")
def _(g):
    return G.outgoing(g.edges, g.start())


@_query("outgoing_relation", "SELECT * FROM G WHERE src = (SELECT id FROM S) AND relation = (SELECT min(relation) FROM G WHERE src = (SELECT id FROM S))")
def _(g):
    start = g.start()
    return G.outgoing(g.edges, start, G.outgoing(g.edges, start).agg(F.min("relation")).first()[0])


_HUB = "module:nucleo-logistico"


@_query("incoming", f"SELECT * FROM G WHERE dst = '{_HUB}'")
def _(g):
    return G.incoming(g.edges, _HUB)


@_query("incoming_relation", f"SELECT * FROM G WHERE dst = '{_HUB}' AND relation = 'depends_on'")
def _(g):
    return G.incoming(g.edges, _HUB, "depends_on")


@_query("related", "SELECT 'outgoing' AS direction, * FROM G WHERE src = (SELECT id FROM S) UNION ALL SELECT 'incoming', * FROM G WHERE dst = (SELECT id FROM S)")
def _(g):
    return G.related(g.edges, g.start())


def _walk_sql(depth: int, where: str = "TRUE") -> str:
    return f""", walk(id, depth) AS (
        SELECT id, 0 FROM S UNION
        SELECT G.dst, w.depth + 1 FROM walk w JOIN G ON G.src = w.id JOIN E ON E.id = G.dst WHERE w.depth < {depth} AND {where})
      SELECT id, min(depth) AS depth FROM walk GROUP BY id"""


def _walk(g, **options) -> DataFrame:
    return G.traverse(g.entities, g.edges, g.start(), **options).select("id", "depth")


@_query("traverse_d1", ", " .join(["", "found AS (SELECT G.dst AS id, 1 AS depth, min(relation) AS relation FROM G JOIN E ON E.id = G.dst WHERE src = (SELECT id FROM S) AND dst <> src GROUP BY G.dst) SELECT id, 0 AS depth, NULL AS relation FROM S UNION ALL SELECT * FROM found"]))
def _(g):
    return G.traverse(g.entities, g.edges, g.start()).select("id", "depth", "relation")


@_query("traverse_relation", _walk_sql(4, "G.relation = 'depends_on'"), recursive=True)
def _(g):
    return _walk(g, relation="depends_on", max_depth=4)


@_query("traverse_d10", _walk_sql(10), recursive=True)
def _(g):
    return _walk(g, max_depth=10)


# mutations

@_query("upsert_last_wins", "SELECT id, type, name, body, coalesce(metadata, '{}') AS metadata, source_path FROM entities WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY landed_at DESC, updated_at DESC) = 1")
def _(g):
    rows = g.raw["entities"].withColumn("batch_order", F.struct("landed_at", "updated_at"))
    base = g.entities.filter(F.lit(False))
    return M.upsert_entities(base, rows, NOW, "batch_order").drop("updated_at")


_CITES = "SELECT src, dst, 'cites' AS relation, '{\"checked\": true}' AS metadata FROM (SELECT DISTINCT src, dst FROM G WHERE relation IN ('depends_on', 'cites'))"


@_query("edge_upsert", f"SELECT * FROM G WHERE (src, dst, relation) NOT IN (SELECT src, dst, relation FROM ({_CITES})) UNION ALL {_CITES}")
def _(g):
    delta = g.edges.filter(F.col("relation").isin("depends_on", "cites")).select("src", "dst", F.lit("cites").alias("relation"), F.lit('{"checked": true}').alias("metadata"))
    return M.upsert_edges(g.edges, delta)


@_query("edge_delete", "SELECT * FROM G WHERE relation <> 'applies'")
def _(g):
    return M.delete_edges(g.edges, g.edges.filter(F.col("relation") == "applies"))


_GONE = "(SELECT entity_id FROM deletions WHERE entity_id IS NOT NULL)"


@_query("delete_cascade", f"""SELECT 'entities' AS kept, id AS key FROM E WHERE id NOT IN {_GONE}
    UNION ALL SELECT 'edges', concat_ws(' ', src, relation, dst) FROM G WHERE src NOT IN {_GONE} AND dst NOT IN {_GONE}
    UNION ALL SELECT 'terms', concat_ws(' ', term, entity_id) FROM T WHERE entity_id NOT IN {_GONE}""")
def _(g):
    entities, edges, terms = M.delete_entities(g.entities, g.edges, g.terms, g.raw["deletions"].select(F.col("entity_id").alias("id")))
    kept = entities.select(F.lit("entities").alias("kept"), F.col("id").alias("key"))
    kept = kept.unionAll(edges.select(F.lit("edges"), F.concat_ws(" ", "src", "relation", "dst")))
    return kept.unionAll(terms.select(F.lit("terms"), F.concat_ws(" ", "term", "entity_id")))


@_query("term_add_idempotent", "SELECT term, entity_id FROM T UNION SELECT lower(t), id FROM (SELECT id, unnest(terms) AS t FROM components) WHERE t IS NOT NULL UNION SELECT lower(name), id FROM E WHERE name IS NOT NULL")
def _(g):
    """New terms of components, repeated ones too, and those of records that may have them already."""
    words = g.raw["components"].select(F.col("id").alias("entity_id"), "terms").unionAll(g.entities.select("id", F.array("name")))
    return M.add_terms(g.terms, words)


@_query("term_clear", "SELECT * FROM T WHERE entity_id NOT IN (SELECT id FROM E WHERE type = 'rule')")
def _(g):
    return M.clear_terms(g.terms, g.entities.filter(F.col("type") == "rule"))


@_query("term_replace", "SELECT * FROM T WHERE entity_id NOT IN (SELECT id FROM E WHERE type = 'sla') UNION SELECT lower(name), id FROM E WHERE type = 'sla' AND name IS NOT NULL")
def _(g):
    words = g.entities.filter(F.col("type") == "sla").select(F.col("id").alias("entity_id"), F.array("name").alias("terms"))
    return M.replace_terms(g.terms, words)


# integrity

@_query("fk_violations", """SELECT ref_table, ref_field, target_id, count(*) AS n FROM (
      SELECT 'edges' AS ref_table, 'src' AS ref_field, src AS target_id FROM G UNION ALL SELECT 'edges', 'dst', dst FROM G UNION ALL SELECT 'terms', 'entity_id', entity_id FROM T)
    WHERE target_id NOT IN (SELECT id FROM E) GROUP BY ALL""")
def _(g):
    return X.fk_violations(g.entities, g.edges, g.terms)


@_query("duplicate_keys", "SELECT src, dst, relation, count(*) AS n FROM edges GROUP BY ALL HAVING count(*) > 1")
def _(g):
    return X.duplicate_keys(g.raw["edges"], ["src", "dst", "relation"])


@_query("endpoint_exists", "SELECT DISTINCT src, dst, src IN (SELECT id FROM E) AS src_exists, dst IN (SELECT id FROM E) AS dst_exists FROM G")
def _(g):
    return X.endpoints_exist(g.entities, g.edges)


_COMPONENTS = "C AS (SELECT DISTINCT ON (id) * FROM components)"


@_query("orphan_edges", f", {_COMPONENTS}, N AS (SELECT id AS src, unnest(depends_on) AS dst FROM C WHERE type IN ('component', 'module', 'service')) SELECT src, dst, 'depends_on' AS relation FROM N WHERE dst <> '' AND dst NOT IN (SELECT id FROM E) AND dst NOT IN (SELECT id FROM C WHERE type IN ('component', 'module', 'service'))")
def _(g):
    delta = P.entries_delta(g.entries(), _no_rejects(g), g.entities)
    return delta.dropped.select("src", "dst", "relation")


def _no_rejects(g) -> DataFrame:
    return g.raw["components"].filter(F.lit(False)).select(F.col("path").alias("source_path"), F.col("path").alias("reason"))


@_query("missing_refs", f", {_COMPONENTS} SELECT id, ref FROM (SELECT id, unnest(depends_on) AS ref FROM C) WHERE ref IS NOT NULL AND ref NOT IN (SELECT id FROM E)")
def _(g):
    refs = g.raw["components"].dropDuplicates(["id"]).select("id", F.explode("depends_on").alias("ref")).filter(F.col("ref").isNotNull())
    return X.missing_refs(refs, g.entities).select("id", "ref")


@_query("ref_mentions", f", {_COMPONENTS}, R AS (SELECT id, unnest(depends_on) AS ref FROM C) SELECT ref, count(*) AS mentions, (arg_min(k, id))::BIGINT AS in_first FROM (SELECT *, count(*) OVER (PARTITION BY ref, id) AS k FROM R) WHERE ref IS NOT NULL AND ref NOT IN (SELECT id FROM E) GROUP BY ref")
def _(g):
    refs = g.raw["components"].dropDuplicates(["id"]).select(F.col("id").alias("n"), F.explode("depends_on").alias("ref")).filter(F.col("ref").isNotNull())
    return mentions(X.missing_refs(refs, g.entities).select("n", "ref", F.lit("").alias("kind"), F.lit("").alias("name"))).select("ref", "mentions", "in_first")


# ingest

@_query("type_allowlist_reject", f", {_COMPONENTS} SELECT path AS source_path, 'invalid type \"' || coalesce(type, 'undefined') || '\"' AS reason FROM C WHERE type IS NULL OR type NOT IN ('rule', 'decision', 'term', 'component', 'endpoint', 'module', 'service')")
def _(g):
    return P.entries_delta(g.entries(), _no_rejects(g), g.entities).rejects


@_query("field_to_edges", f", {_COMPONENTS}, N AS (SELECT id AS src, unnest(depends_on) AS dst FROM C) SELECT src, dst, 'depends_on' AS relation FROM N WHERE dst <> ''")
def _(g):
    entries = g.entries().withColumn("id", P._text(F.element_at("values", "id")))
    return P.field_edges(entries, P.RELATIONS, True)


@_query("metadata_residual", f", {_COMPONENTS} SELECT id, owner, stability FROM C WHERE type = 'component'")
def _(g):
    delta = P.entries_delta(g.entries(), _no_rejects(g), g.entities)
    meta = lambda k: F.get_json_object("metadata", f"$.{k}").alias(k)
    return delta.entities.select("id", meta("owner"), meta("stability"))


@_query("ingest_delta_counts", f", {_COMPONENTS} SELECT (SELECT count(*) FROM E) AS entities_before, (SELECT count(*) FROM (SELECT id FROM E UNION SELECT id FROM C WHERE type = 'component')) AS entities_after")
def _(g):
    delta = P.entries_delta(g.entries(), _no_rejects(g), g.entities)
    after = M.upsert_entities(g.entities, delta.entities, NOW)
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return g.entities.limit(1).select(count(g.entities).alias("entities_before"), count(after).alias("entities_after"))


@_query("rule_schema_issues", r""", R AS (SELECT id, type, json_extract_string(m, '$.owner') AS owner, json_extract_string(m, '$.status') AS status, json_extract_string(m, '$.severity') AS risk_note,
      source_path, json_array_length(json_extract(m, '$.eventos')) AS n FROM (SELECT *, CASE WHEN json_valid(metadata) THEN metadata END AS m FROM E) WHERE type IN ('rule', 'exception', 'sla', 'decision'))
    SELECT code, detail, count(*) AS n FROM (
      SELECT 'missing_field' AS code, 'owner' AS detail FROM R WHERE owner IS NULL UNION ALL SELECT 'missing_field', 'status' FROM R WHERE status IS NULL
      UNION ALL SELECT 'missing_field', 'source_ref' FROM R WHERE source_path IS NULL
      UNION ALL SELECT 'bad_id', type FROM R WHERE NOT regexp_matches(id, '^(R|E|G|S)-[A-Z]{2,5}-\d{3,4}$') UNION ALL SELECT 'bad_type', type FROM R WHERE type = 'decision'
      UNION ALL SELECT 'bad_status', status FROM R WHERE status NOT IN ('active', 'deprecated', 'draft') UNION ALL SELECT 'empty_evento', 'applicability.evento' FROM R WHERE coalesce(n, 0) = 0
      UNION ALL SELECT 'missing_risk_note', 'risk_note' FROM R WHERE risk_note IS NULL) GROUP BY code, detail""")
def _(g):
    valid = g.rules()
    issues = schema_issues(valid).join(valid.select(F.col("id").alias("label"), "type"), "label")
    detail = F.when(F.col("code") == "bad_id", F.col("type")).otherwise(F.col("detail"))
    return issues.groupBy("code", detail.alias("detail")).agg(F.count(F.lit(1)).alias("n"))


_RULES = r""", R AS (SELECT id, type, name, json_extract_string(m, '$.owner') AS owner, json_extract_string(m, '$.severity') AS severity, source_path,
      coalesce(from_json(json_extract(m, '$.eventos'), '["VARCHAR"]'), []) AS eventos FROM (SELECT *, CASE WHEN json_valid(metadata) THEN metadata END AS m FROM E) WHERE type IN ('rule', 'exception', 'sla', 'decision'))"""


@_query("rule_body", _RULES + " SELECT id, concat_ws(chr(10), coalesce(name, ''), 'Riesgo: ' || severity, 'Fuente: ' || source_path) AS body FROM R")
def _(g):
    return g.rules().select("id", P.rule_body().alias("body"))


@_query("rule_terms", _RULES + r"""
    SELECT DISTINCT id, term FROM (SELECT id, unnest([owner, lower(id)] || eventos || list_filter(regexp_split_to_array(lower(coalesce(name, '')), '[\s—,;:()]+'), lambda x: length(x) > 4)) AS term FROM R) WHERE term <> ''""")
def _(g):
    return g.rules().select("id", F.explode(P.rule_terms(F.col("owner"))).alias("term"))


@_query("summary_keywords", r", W AS (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(name, '')), '[\s—,;:()]+'), lambda x: length(x) > 4) AS w FROM E) SELECT id, array_to_string(w, ' ') AS words FROM W")
def _(g):
    return g.entities.select("id", F.array_join(keywords(F.col("name")), " ").alias("words"))


@_query("file_domain", r"SELECT DISTINCT source_path, regexp_replace(regexp_extract(source_path, '([^/]+)$', 1), '\.yaml$', '') AS domain FROM E WHERE source_path <> ''")
def _(g):
    paths = g.entities.filter(F.col("source_path") != "").select("source_path").distinct()
    return paths.select("source_path", P.file_domain(F.col("source_path")).alias("domain"))


def _front(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", D.front_matter(F.col("text")).alias("m")).filter(F.size("m.values") > 0)
    return docs.select("doc_id", F.array_join(F.array_sort(F.map_keys("m.values")), " ").alias("keys"), F.md5("m.body").alias("body"))


QUERIES["frontmatter_parse"] = _front
ORACLE_SQL["frontmatter_parse"] = r"""
    WITH parts AS (SELECT doc_id, regexp_extract(text, '(?s)^---[ \t\r\n\f]*?\n(.*?)\n---[ \t\r\n\f]*?\n(.*)$', ['head', 'body']) AS p FROM documents
                   WHERE regexp_matches(text, '(?s)^---[ \t\r\n\f]*?\n(.*?)\n---[ \t\r\n\f]*?\n(.*)$')),
    keys AS (SELECT doc_id, p.body AS body, list_distinct(list_transform(list_filter(regexp_split_to_array(p.head, '\r?\n'), lambda x: regexp_matches(x, '^[\w.-]+:')), lambda x: regexp_extract(x, '^([\w.-]+):', 1))) AS k FROM parts)
    SELECT doc_id, array_to_string(list_sort(k), ' ') AS keys, md5(trim(body, E' \t\r\n')) AS body FROM keys WHERE len(k) > 0"""


# full text

_WORDS = r"regexp_extract_all(strip_accents(lower(coalesce({}, ''))), '[\p{{L}}\p{{N}}]+')"


def _tf(test: str, columns: tuple[int, ...] = (0, 1), size: int = 1) -> str:
    """Occurrences in SQL: ``test`` over a word list w at place i."""
    one = "len(list_filter(range(1, len(w{c}) + {end}), lambda i: {test}))"
    return "(" + " + ".join(one.format(c=c, end=2 - size, test=test.replace("w[", f"w{c}[").replace("w,", f"w{c},")) for c in columns) + ")"


def _find_sql(tfs: list, where: str, score: list[int] | None = None, limit: str = "", columns: str = "id", type_: str = "") -> str:
    """BM25 in SQL. ``tfs``: expressions, or pairs of one for scores and one for the document frequency."""
    pairs = [t if isinstance(t, tuple) else (t, t) for t in tfs]
    tf = ", ".join(f"{a} AS tf{k}, {b} AS d{k}" for k, (a, b) in enumerate(pairs))
    df = ", ".join(f"count(*) FILTER (d{k} > 0) AS df{k}" for k in range(len(pairs)))
    idf = "(CASE WHEN df{k} * 2 < n THEN ln((n - df{k} + 0.5) / (df{k} + 0.5)) ELSE 1e-6 END)"
    part = idf + " * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))"
    total = " + ".join(part.format(k=k) for k in (score or range(len(pairs))))
    return f""", D AS (SELECT id, type, {_WORDS.format("name")} AS w0, {_WORDS.format("body")} AS w1 FROM E),
      Q AS (SELECT id, type, len(w0) + len(w1) AS dl, {tf} FROM D),
      Z AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl, {df} FROM Q)
      SELECT {columns}, round(-({total}), 10) AS rank FROM Q, Z WHERE {where} {type_} {limit}"""


_is = "w[i] = '{}'".format
_near = "w[i] = '{}' AND list_contains(w[greatest(1, i - 4):i + 4], '{}')".format


@_query("find_scan", _find_sql([(_tf(_near("rampa", "flota")), _tf(_is("rampa"))), (_tf(_near("flota", "rampa")), _tf(_is("flota")))], "tf0 > 0 AND tf1 > 0"))
def _(g):
    """Without an index, over the texts."""
    return search(g.entities, "NEAR(rampa flota, 3)", limit=-1, with_snippet=False).select("id", F.round("rank", 10).alias("rank"))


@_query("find_index", _find_sql([_tf(_is("rampa")), _tf(_is("muelle"))], "tf0 > 0 OR tf1 > 0"))
def _(g):
    found = search(g.entities, "rampa OR muelle", limit=-1, postings=build_postings(g.entities), size=corpus_size(g.entities), with_snippet=False)
    return found.select("id", F.round("rank", 10).alias("rank"))


@_query("find_snippet")
def _(g):
    return search(g.entities, '"salvo los feriados" OR rampa', limit=20).select("id", "snippet")
