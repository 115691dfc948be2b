"""Checks of rule files: fields, allowed values, references.

What a rule must look like is a parameter (:class:`RuleSpec`). All checks of all rules are one DataFrame of
issues; references are checked by one anti-join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators.lookup import json_distinct
from .operators.integrity import missing_refs
from .schema import conform
from .session import path_exists, read_text
from .sources import documents as D
from .sources.plugins import GraphDelta
from .store import GraphStore


# Bodies of objects that validation registers.
REGISTERED = {
    "table": "Tabla nueva registrada durante validación de reglas",
    "stored_procedure": "SP nuevo registrado durante validación de reglas",
}


@dataclass(frozen=True)
class RuleSpec:
    """Fixed values of the default rule format."""

    required: tuple[str, ...] = ("id", "type", "summary", "applicability", "source_ref", "owner", "status")
    id_pattern: str = r"^(R|E|G|S)-[A-Z]{2,5}-\d{3,4}$"
    types: tuple[str, ...] = ("rule", "exception", "gap", "sla")
    statuses: tuple[str, ...] = ("active", "deprecated", "draft")
    prefixes: tuple[tuple[str, str], ...] = (("R", "rule"), ("E", "exception"), ("G", "gap"), ("S", "sla"))


def schema_issues(rules: DataFrame, spec: RuleSpec = RuleSpec()) -> DataFrame:
    """``source_path, n, label, ord, code, detail``: every failed check of every rule, in the order of the checks."""

    def given(name: str) -> Column:
        return F.coalesce(F.col("has_applicability"), F.lit(False)) if name == "applicability" else F.col(name).isNotNull()

    def issue(bad: Column, code: str, detail: Column) -> Column:
        return F.when(bad, F.struct(F.lit(code).alias("code"), detail.alias("detail")))

    id_ok = F.col("id").rlike(spec.id_pattern)
    expected = F.create_map(*[F.lit(x) for pair in spec.prefixes for x in pair])[F.substring("id", 1, 1)]
    checks = [issue(~given(f), "missing_field", F.lit(f)) for f in spec.required]
    checks += [
        issue(F.col("id").isNotNull() & ~id_ok, "bad_id", F.col("id")),
        issue(F.col("type").isNotNull() & ~F.col("type").isin(*spec.types), "bad_type", F.col("type")),
        issue(id_ok & F.col("type").isNotNull() & (expected != F.col("type")), "prefix_type", F.col("type")),
        issue(F.col("status").isNotNull() & ~F.col("status").isin(*spec.statuses), "bad_status", F.col("status")),
        issue(F.col("has_applicability") & ~F.col("evento_valid"), "empty_evento", F.lit("applicability.evento")),
        issue(F.col("risk_note").isNull(), "missing_risk_note", F.lit("risk_note")),
    ]
    label = F.coalesce("id", F.concat(F.lit("rules["), F.col("n"), F.lit("]")))
    return rules.select("source_path", "n", label.alias("label"), F.posexplode(F.array_compact(F.array(*checks))).alias("ord", "i")).select(
        "source_path", "n", "label", "ord", "i.code", "i.detail"
    )


def rule_refs(rules: DataFrame) -> DataFrame:
    """``source_path, n, rule_id, ref, kind, name``: objects named by rules, every mention."""
    both = F.concat(
        F.transform("tables", lambda x: F.struct(F.concat(F.lit("table:"), x).alias("ref"), F.lit("table").alias("kind"), x.alias("name"))),
        F.transform("sps", lambda x: F.struct(F.concat(F.lit("sp:"), x).alias("ref"), F.lit("stored_procedure").alias("kind"), x.alias("name"))),
    )
    return rules.select("source_path", "n", F.col("id").alias("rule_id"), F.explode(both).alias("r")).select("source_path", "n", "rule_id", "r.*")


def mentions(missing: DataFrame) -> DataFrame:
    """``ref, kind, name, mentions, in_first``: missing objects, how often, and how often in the first rule that names them.

    If an object is registered when its first rule is met, that rule's mentions all count, later ones no more.
    """
    per_rule = missing.groupBy("ref", "kind", "name", "n").agg(F.count(F.lit(1)).alias("c"))
    return per_rule.groupBy("ref", "kind", "name").agg(F.sum("c").alias("mentions"), F.min(F.struct("n", "c"))["c"].alias("in_first"))


@dataclass
class ValidateResult:
    valid: bool
    errors: list[str]
    warnings: list[str]
    stats: dict = field(default_factory=dict)


def _stats(rules: int = 0, domain: str = "unknown", registered: int = 0, rejected: int = 0) -> dict:
    return {"totalRules": rules, "domain": domain, "newObjectsRegistered": registered, "referencesRejected": rejected}


def validate_rules_file(
    store: GraphStore,
    path: str,
    auto_register: bool = False,
    known_domains: list[str] | None = None,
    decide: Callable[[str], bool] = lambda ref: False,
    spec: RuleSpec = RuleSpec(),
) -> ValidateResult:
    """Validate one rule file against the graph.

    Missing objects are registered if ``auto_register`` or if ``decide`` says so, else they are errors. What is
    registered stays, even if the file is invalid.
    """
    spark = store.spark
    store.migrate()
    snapshot = store.read()
    domains = set(known_domains) if known_domains is not None else {r["value"] for r in json_distinct(snapshot.entities, "$.domain").collect()}
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    files = spark.createDataFrame([(path, read_text(spark, path))], D.FILES)  # this file only, whatever its name
    state = D.rule_files(files).first()
    if state["state"] == "unparsable":
        return ValidateResult(False, [f"error parsing YAML: {state['message']}"], [], _stats())
    if state["state"] == "no rules":
        return ValidateResult(False, ['the file has no valid "rules" array'], [], _stats())
    rules = D.parse_rules(files).cache()
    errors, warnings = [], []
    domain = state["domain"] or "unknown"
    if not state["domain"]:
        errors.append("metadata.domain is required")
    elif domains and state["domain"] not in domains:
        warnings.append(f'metadata.domain "{state["domain"]}" is not known')
    errors += [f"metadata.{k} is required" for k in ("version", "created_at") if not state[k]]
    missing = missing_refs(rule_refs(rules), snapshot.entities)
    # A file's issues are its report; they are as many as its rules.
    for r in schema_issues(rules, spec).orderBy("n", "ord").collect():
        errors.append(f"{r['label']}: {r['code']} {r['detail']}")
    for r in rules.filter(~F.col("has_related")).orderBy("n").collect():
        warnings.append(f"{r['id'] or 'rules[%d]' % r['n']}: no related_objects")
    found = mentions(missing).collect()
    accepted = [r for r in found if auto_register or decide(r["ref"])]
    rejected = {r["ref"] for r in found} - {r["ref"] for r in accepted}
    if accepted:
        new = [{"id": r["ref"], "type": r["kind"], "name": r["name"], "body": REGISTERED[r["kind"]], "metadata": None} for r in accepted]
        rows = D.inline(spark, "entities", new).withColumn("metadata", F.to_json(F.create_map(F.lit("domain"), F.lit(domain), F.lit("status"), F.lit("new"))))
        terms = rows.select(F.col("id").alias("entity_id"), F.array(F.lower("name"), F.lit(domain)).alias("terms"))
        store.apply(GraphDelta(rows, conform(rows.filter("false"), "edges"), terms), "register objects")
    if rejected:
        for r in missing.orderBy("n").collect():
            if r["ref"] in rejected:
                errors.append(f"{r['rule_id']}: reference to {r['ref']} is not in the graph and was not registered")
    rules.unpersist()
    n_rejected = sum(r["mentions"] for r in found if r["ref"] in rejected)
    return ValidateResult(not errors, errors, warnings, _stats(state["n_rules"], domain, sum(r["in_first"] for r in accepted), n_rejected))
