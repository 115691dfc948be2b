"""Ingestion plugins: from sources to a delta of the graph, as lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import keywords
from ..operators.integrity import split_orphans
from ..schema import ORDER, conform, empty
from . import documents as D


@dataclass
class GraphDelta:
    """What an ingest adds. ``terms`` has ``entity_id, terms array``: the terms of these entities are replaced.

    Batches carry the order of their sources (schema.ORDER). ``counters`` are filled when the delta has been applied.
    """

    entities: DataFrame
    edges: DataFrame
    terms: DataFrame
    rejects: DataFrame | None = None
    dropped: DataFrame | None = None
    clear_empty: bool = False
    counters: dict = field(default_factory=dict)


# Keys of a document that become relations, and the types a manifest may have.
BASIC_RELATIONS = ["depends_on", "cites", "supersedes", "applies_to"]
RELATIONS = ["cites", "defines", "supersedes", "implements", "applies", "tested_by", "exposes", "consumes", "depends_on"]
TYPES = ["rule", "decision", "term", "component", "endpoint", "module", "service"]


def _text(value: Column) -> Column:
    """Text of a JSON value: strings without quotes, other values as they are written."""
    return F.when(value == "null", None).when(value.startswith('"'), F.get_json_object(F.concat(F.lit('{"x":'), value, F.lit("}")), "$.x")).otherwise(value)


def _items(value: Column, scalars: bool) -> Column:
    """Items of a JSON value: a list's; of a scalar itself, if scalars count."""
    listed = F.from_json(value, "array<string>")
    single = F.array(_text(value)) if scalars else F.array().cast("array<string>")
    found = F.when(value.startswith("["), listed).otherwise(single)
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def field_edges(entries: DataFrame, relations: list[str], scalars: bool) -> DataFrame:
    """``src, dst, relation``: an edge per relation key and target, by unpivoting the values."""
    wanted = F.filter(F.map_entries("values"), lambda e: e["key"].isin(relations))
    order = [ORDER] if ORDER in entries.columns else []
    rows = entries.select("id", *order, F.explode(wanted).alias("e"))
    return rows.select(F.col("id").alias("src"), *order, F.explode(_items(F.col("e.value"), scalars)).alias("dst"), F.col("e.key").alias("relation"))


def in_order(entries: DataFrame, *first: Column) -> DataFrame:
    """Entries with the order of their sources: folder by folder as names sort, and by place within a file."""
    return entries.withColumn(ORDER, F.struct(*first, F.split("source_path", "/").alias("path"), F.col("n").alias("n")))


def residual(values: Column, reserved: list[str]) -> Column:
    """JSON object of the values that have no column of their own."""
    kept = F.map_filter(values, lambda k, v: ~k.isin(reserved))
    parts = F.transform(F.map_entries(kept), lambda e: F.concat(F.regexp_replace(F.to_json(F.array(e["key"])), r"^\[|\]$", ""), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def _entities(entries: DataFrame, reserved: list[str]) -> DataFrame:
    value = lambda k: _text(F.element_at("values", k))
    return entries.select(
        "id",
        F.col("type"),
        F.coalesce(value("name"), F.col("id")).alias("name"),
        value("body").alias("body"),
        residual(F.col("values"), reserved).alias("metadata"),
        "source_path",
        *([ORDER] if ORDER in entries.columns else []),
    )


def markdown_plugin(spark: SparkSession, root: str) -> GraphDelta:
    """Markdown documents with front matter. No id: skipped; no type: ``note``. An unknown edge target is an error at commit."""
    return markdown_delta(D.read_markdown(spark, root, tolerant=False))


def markdown_delta(docs: DataFrame) -> GraphDelta:
    """The delta of ``source_path, values, body`` documents."""
    entries = in_order(D.markdown_entries(docs)).withColumn("id", _text(F.element_at("values", "id")))
    good = entries.filter(F.coalesce("id", F.lit("")) != "").withColumn("type", F.coalesce(_text(F.element_at("values", "type")), F.lit("note")))
    rejects = entries.filter(F.coalesce("id", F.lit("")) == "").select("source_path", F.lit("missing id").alias("reason"))
    terms = good.select(F.col("id").alias("entity_id"), _items(F.element_at("values", "terms"), False).alias("terms"), ORDER)
    reserved = ["id", "type", "name", "body", "terms", *BASIC_RELATIONS]
    return GraphDelta(conform(_entities(good, reserved), "entities"), conform(field_edges(good, BASIC_RELATIONS, False), "edges"), terms, rejects)


def manifest_plugin(spark: SparkSession, root: str, base: DataFrame | None = None) -> GraphDelta:
    """Documents under ``docs`` and manifests under ``manifests``.

    Records without an id or with a type outside TYPES are rejected; edges to targets that are neither in the
    batch nor in ``base`` are dropped. Neither is fatal.
    """
    docs = D.markdown_entries(D.read_markdown(spark, f"{root}/docs", quotes=True))
    listed, unread = D.read_manifests(spark, f"{root}/manifests")
    entries = docs.withColumn("source", F.lit(0)).unionByName(D.manifest_entries(listed).withColumn("source", F.lit(1)))
    return entries_delta(in_order(entries, F.col("source")), unread, base if base is not None else empty(spark, "entities"))


def entries_delta(entries: DataFrame, unread: DataFrame, base: DataFrame, types: list[str] = TYPES, relations: list[str] = RELATIONS) -> GraphDelta:
    """The delta of ``source_path, values`` entries: checked, unpivoted, split into live and dropped."""
    entries = entries.withColumns({k: _text(F.element_at("values", k)) for k in ("id", "type")})
    bad = F.when(F.coalesce("id", F.lit("")) == "", "missing id").when(
        ~F.coalesce(F.col("type").isin(types), F.lit(False)), F.concat(F.lit('invalid type "'), F.coalesce("type", F.lit("undefined")), F.lit('"'))
    )
    checked = entries.withColumn("reason", bad)
    good = checked.filter(F.col("reason").isNull())
    rejects = unread.select("source_path", "reason").unionByName(checked.filter(F.col("reason").isNotNull()).select("source_path", "reason"))
    entities = conform(_entities(good, ["id", "type", "name", "body", "terms", *relations]), "entities")
    live, dropped = split_orphans(conform(field_edges(good, relations, True), "edges"), entities, base)
    order = [ORDER] if ORDER in good.columns else []
    terms = good.select(F.col("id").alias("entity_id"), _items(F.element_at("values", "terms"), True).alias("terms"), *order)
    return GraphDelta(entities, live, terms, rejects, dropped)


# Labels of the parts of a rule's body.
BODY_LABELS = {"risk_note": "Riesgo: ", "action": "Acción: ", "source_ref": "Fuente: "}


def rule_body() -> Column:
    """Summary, risk, action, conditions and source of a rule, a line each; what is missing has no line."""
    part = lambda c: F.concat(F.lit(BODY_LABELS[c]), F.col(c))
    conditions = F.array_join(F.transform("conditions", lambda c: F.concat_ws(" ", c["field"], c["op"], c["value"])), "\n")
    return F.concat_ws("\n", F.coalesce("summary", F.lit("")), part("risk_note"), part("action"), F.when(F.size("conditions") > 0, conditions), part("source_ref"))


def rule_terms(domain: Column) -> Column:
    """Domain, subdomain, id, events, objects and keywords of the summary; distinct, in this order."""
    lower = lambda c: F.transform(c, lambda x: F.lower(x))
    parts = F.concat(F.array(domain, F.col("subdomain"), F.lower("id")), F.col("eventos"), lower("tables"), lower("sps"), keywords(F.col("summary")))
    return F.filter(F.array_distinct(parts), lambda x: x.isNotNull() & (x != ""))


def file_domain(path: Column) -> Column:
    """Domain of a rule file by its name: without ``.yaml``, the first ``seed-`` and the first ``-rules``."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.yaml$", "")
    first = lambda text, what: F.when(F.instr(text, what) > 0, F.concat(F.substring_index(text, what, 1), text.substr(F.instr(text, what) + len(what), F.length(text)))).otherwise(text)
    return first(first(name, "seed-"), "-rules")


# Prefix, type, relation and body of the objects that rules name.
OBJECTS = {
    "tables": ("table", "table", "uses_table", "Tabla Sybase: "),
    "sps": ("sp", "stored_procedure", "uses_sp", "Stored Procedure Sybase: "),
}


def yaml_plugin(spark: SparkSession, root: str, only: str | None = None) -> GraphDelta:
    """Rules of YAML files with the objects they name. A rule without id is skipped; terms are always replaced.

    An object named by several rules takes the domain of the last file and rule. Overrides of unknown rules are
    an error at commit.
    """
    return yaml_delta(D.read_yaml(spark, root))


def yaml_delta(files: DataFrame) -> GraphDelta:
    """The delta of ``source_path, content`` rule files."""
    rules = D.parse_rules(files).filter(F.col("id").isNotNull())
    domain = F.coalesce("domain", file_domain(F.col("source_path")))
    kind = F.coalesce("type", F.lit("rule"))
    rules = rules.withColumns({"domain": domain, "kind": kind}).withColumn("entity_id", F.concat_ws(":", "kind", "id"))
    meta = F.to_json(
        F.struct(
            "domain", F.col("version").alias("domainVersion"), F.col("created_at").alias("domainCreatedAt"), "subdomain", F.coalesce("status", F.lit("active")).alias("status"), "owner",
            F.col("risk_note").alias("riskNote"), "eventos", "actors", F.col("tables").alias("relatedTables"), F.col("sps").alias("relatedSps"), F.col("source_ref").alias("sourceRef"),
            F.parse_json(F.coalesce("formal_rule", F.lit("null"))).alias("formalRule"),
        ),
        {"ignoreNullFields": "false"},
    )
    name = F.concat(F.lit("["), F.col("id"), F.lit("] "), F.coalesce("summary", F.lit("Sin resumen")))
    own = rules.select(F.col("entity_id").alias("id"), F.col("kind").alias("type"), name.alias("name"), rule_body().alias("body"), meta.alias("metadata"), "source_path", "n")
    best = F.max(F.struct("source_path", "n", "type", "name", "body", "metadata")).alias("m")
    entities = conform(own.groupBy("id").agg(best).select("id", "m.*"), "entities")
    edges = rules.filter((F.col("kind") == "exception") & F.col("overrides").isNotNull()).select(
        F.col("entity_id").alias("src"), F.concat(F.lit("rule:"), F.col("overrides")).alias("dst"), F.lit("overrides").alias("relation")
    )
    for column, (prefix, type_, relation, label) in OBJECTS.items():
        named = rules.select("entity_id", "domain", "source_path", "n", F.explode(column).alias("object")).withColumn("dst", F.concat(F.lit(f"{prefix}:"), F.col("object")))
        last = named.groupBy("dst", "object").agg(F.max(F.struct("source_path", "n", "domain")).alias("m"))
        metadata = F.to_json(F.struct(F.col("m.domain").alias("domain")))
        objects = last.select(F.col("dst").alias("id"), F.lit(type_).alias("type"), F.col("object").alias("name"), F.concat(F.lit(label), F.col("object")).alias("body"), metadata.alias("metadata"))
        entities = entities.unionByName(conform(objects, "entities"))
        edges = edges.unionByName(named.select(F.col("entity_id").alias("src"), "dst", F.lit(relation).alias("relation")))
    states = D.rule_files(files)
    rejects = states.filter(F.col("state") != "ok").select("source_path", F.col("state").alias("reason"))
    terms = in_order(rules).select("entity_id", rule_terms(F.col("domain")).alias("terms"), ORDER)
    return GraphDelta(entities, conform(edges.distinct(), "edges"), terms, rejects, clear_empty=True)
