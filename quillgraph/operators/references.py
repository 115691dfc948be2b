"""References to records that do not exist.

The state of the operator is two tables of signed counts, both built only from change deltas:

* reference counts: ``(ref_table, ref_field, target_id, at) -> n`` - how many rows landed at ``at``
  refer to ``target_id``;
* existence counts: ``(id, kind, at) -> n`` - how often ``id`` landed, was deleted, or is always there.

A delta adds or takes back rows (``delta`` +1 or -1). Folding deltas into a state is a union and a sum,
so the state can be kept up batch by batch (see ``streaming.reference_stream``) and no base table is read
again. Keys with a positive reference count and no existence (never, no longer, or not yet at the time of
the reference) are the report.

Scale: a hot target (a tenth or a third of all rows) never meets a join before it is reduced. The first
sum is keyed by target *and* time, which spreads a hot target over all partitions, and both sums combine
map-side; the join with existence then sees at most one row per target, field and month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REF_KEYS = ["ref_table", "ref_field", "target_id", "at"]
EXIST_KEYS = ["id", "kind", "at"]


def _named(df: DataFrame, table: str, refs, at: str, delta: int) -> DataFrame:
    return df.select(F.lit(table).alias("ref_table"), refs, F.col(at).alias("at")).select(
        "ref_table",
        F.col("r.ref_field").alias("ref_field"),
        F.col("r.target_id").alias("target_id"),
        "at",
        F.lit(delta).cast("bigint").alias("delta"),
    )


def _one(field: str, col) -> F.Column:
    return F.struct(F.lit(field).alias("ref_field"), col.cast("string").alias("target_id"))


def reference_deltas(edges: DataFrame, components: DataFrame, terms: DataFrame, sign: int = 1) -> DataFrame:
    """Change deltas of the four referring fields. Null and empty references are none."""
    ends = F.explode(F.array(_one("src", F.col("src")), _one("dst", F.col("dst")))).alias("r")
    needs = F.explode(F.transform("depends_on", lambda x: _one("depends_on", x))).alias("r")
    words = _one("entity_id", F.col("entity_id")).alias("r")
    parts = [
        _named(edges, "edges", ends, "landed_at", sign),
        _named(components, "components", needs, "landed_at", sign),
        _named(terms, "terms", words, "landed_at", sign),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.filter(F.col("target_id").isNotNull() & (F.col("target_id") != ""))


def existence_deltas(
    entities: DataFrame, components: DataFrame, modules: DataFrame, deletions: DataFrame, sign: int = 1
) -> DataFrame:
    """Change deltas of what exists: landings, deletions, and ids that always exist."""

    def part(df: DataFrame, key: str, kind: str, at) -> DataFrame:
        return df.select(
            F.col(key).alias("id"),
            F.lit(kind).alias("kind"),
            at.alias("at"),
            F.lit(sign).cast("bigint").alias("delta"),
        )

    stamp = F.col("landed_at")
    never = F.lit(None).cast(entities.schema["landed_at"].dataType)
    return (
        part(entities, "id", "landed", stamp)
        .unionByName(part(components, "id", "landed", stamp))
        .unionByName(part(modules, "id", "always", never))
        .unionByName(part(deletions, "entity_id", "deleted", F.col("deleted_at")))
        .filter(F.col("id").isNotNull())
    )


def fold(deltas: DataFrame, keys: list[str], state: DataFrame | None = None) -> DataFrame:
    """Add deltas to a state of signed counts; keys whose count returns to zero leave the state."""
    rows = deltas.select(*keys, F.col("delta").alias("n"))
    if state is not None:
        rows = state.select(*keys, "n").unionByName(rows)
    return rows.groupBy(*keys).agg(F.sum("n").alias("n")).filter(F.col("n") != 0)


def orphan_report(references: DataFrame, existence: DataFrame) -> DataFrame:
    """Current orphans: ``ref_table, ref_field, target_id, period, reason, n_refs``.

    ``missing``: the id never landed; ``deleted``: its last deletion is at or after its last landing;
    ``late``: it exists, but landed first only after the reference. ``period`` is the month in which the
    reference landed (null if it has no time; such a reference is never late). Empty inputs give no rows;
    extra columns of the inputs play no part.
    """
    per_month = (
        references.filter(F.col("n") > 0)
        .withColumn("period", F.date_format("at", "yyyy-MM"))
        .groupBy("ref_table", "ref_field", "target_id", "period")
        .agg(F.min("at").alias("first_ref"), F.sum("n").alias("n_refs"))
    )
    kind, at = F.col("kind"), F.col("at")
    known = (
        existence.filter(F.col("n") > 0)
        .groupBy("id")
        .agg(
            F.max(F.when(kind == "always", True)).alias("always"),
            F.max(F.when(kind == "landed", True)).alias("landed"),
            F.min(F.when(kind == "landed", at)).alias("first_landed"),
            F.max(F.when(kind == "landed", at)).alias("last_landed"),
            F.max(F.when(kind == "deleted", at)).alias("last_deleted"),
        )
    )
    reason = (
        F.when(F.col("always"), None)
        .when(F.col("landed").isNull(), "missing")
        .when(F.col("last_deleted") >= F.col("last_landed"), "deleted")
        .when(F.col("first_landed") > F.col("first_ref"), "late")
    )
    joined = per_month.join(known, per_month["target_id"] == known["id"], "left")
    return joined.select("ref_table", "ref_field", "target_id", "period", reason.alias("reason"), "n_refs").filter(
        F.col("reason").isNotNull()
    )


def find_orphans(
    entities: DataFrame,
    components: DataFrame,
    modules: DataFrame,
    edges: DataFrame,
    terms: DataFrame,
    deletions: DataFrame,
) -> DataFrame:
    """The orphan report of whole tables: all their rows are one delta on an empty state."""
    refs = fold(reference_deltas(edges, components, terms), REF_KEYS)
    known = fold(existence_deltas(entities, components, modules, deletions), EXIST_KEYS)
    return orphan_report(refs, known)


def orphans_per_period(report: DataFrame) -> DataFrame:
    """Orphans per referring table, field and month."""
    return report.groupBy("ref_table", "ref_field", "period", "reason").agg(
        F.count(F.lit(1)).alias("n_targets"), F.sum("n_refs").alias("n_refs")
    )
