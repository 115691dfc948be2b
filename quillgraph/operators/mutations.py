"""Keyed upserts, deletes with cascade, and term maintenance, on whole tables.

Each takes a table and a delta and returns the next table; the store commits it. Batches are the unit: a
delta of any size is one anti-join and one union.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEYS, ORDER, conform


def last_of_batch(delta: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The last row per key of a batch, combined map-side.

    The order is the column ``order``, else the batch's own (schema.ORDER, as sources give it), else that of its
    partitions and rows: of a list of rows, or of files read. Rows that tie count as copies; if they are not, the greatest holds.
    """
    if order is not None:
        delta = delta.withColumn(ORDER, F.col(order))
    elif ORDER not in delta.columns:
        delta = delta.withColumn(ORDER, F.monotonically_increasing_id())
    rest = [c for c in delta.columns if c not in (*keys, ORDER)]
    best = delta.groupBy(*keys).agg(F.max(F.struct(ORDER, *rest)).alias("__last"))
    return best.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest])


def upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the delta replace those with the same key as a whole; others stay."""
    columns = [c for c in base.columns if c != ORDER]
    return base.join(delta.select(*keys), keys, "left_anti").select(*columns).unionByName(delta.select(*columns))


def entity_rows(delta: DataFrame, now, order: str | None = None) -> DataFrame:
    """The rows an upsert writes: the last of each id, metadata ``{}`` where there is none, ``updated_at`` now. A null id is no row."""
    rows = last_of_batch(conform(delta, "entities") if order is None else delta, KEYS["entities"], order)
    rows = conform(rows.filter(F.col("id").isNotNull()), "entities")
    return rows.withColumn("metadata", F.coalesce("metadata", F.lit("{}"))).withColumn("updated_at", F.lit(str(now)).cast("timestamp_ntz"))


def edge_rows(delta: DataFrame, order: str | None = None) -> DataFrame:
    """The last of each (src, dst, relation), metadata ``{}`` where there is none."""
    rows = conform(last_of_batch(conform(delta, "edges") if order is None else delta, KEYS["edges"], order), "edges")
    return rows.withColumn("metadata", F.coalesce("metadata", F.lit("{}")))


def upsert_entities(entities: DataFrame, delta: DataFrame, now, order: str | None = None) -> DataFrame:
    """Full replacement by id: what the delta leaves out becomes null (metadata ``{}``); ``updated_at`` is now.

    The last row of a batch wins. Edges and terms of the entity stay. A null id is an error of the caller and is
    dropped here.
    """
    return upsert(entities, entity_rows(delta, now, order), KEYS["entities"])


def upsert_edges(edges: DataFrame, delta: DataFrame, order: str | None = None) -> DataFrame:
    """By (src, dst, relation); metadata is replaced, ``{}`` where the delta has none. The last row of a batch wins."""
    return upsert(edges, edge_rows(delta, order), KEYS["edges"])


def delete_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Without the exact triples of ``keys``."""
    return edges.join(keys.select(*KEYS["edges"]), KEYS["edges"], "left_anti").select(*edges.columns)


def edges_without(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the edges at either end of these entities."""
    gone = ids.select("id").distinct()
    for end in ("src", "dst"):
        edges = edges.join(gone.select(F.col("id").alias(end)), end, "left_anti").select(*edges.columns)
    return edges


def delete_entities(
    entities: DataFrame, edges: DataFrame, terms: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without these entities, the edges at either end of them, and their terms."""
    return entities.join(ids.select("id").distinct(), "id", "left_anti"), edges_without(edges, ids), clear_terms(terms, ids)


def term_rows(words: DataFrame) -> DataFrame:
    """``term, entity_id`` from ``entity_id, terms array``: lower case, nothing trimmed or folded."""
    return words.select(F.explode(F.transform("terms", F.lower)).alias("term"), "entity_id").filter(F.col("term").isNotNull())


def add_terms(terms: DataFrame, words: DataFrame) -> DataFrame:
    """Insert or ignore by (term, entity)."""
    return terms.unionByName(term_rows(words)).dropDuplicates(KEYS["terms"])


def clear_terms(terms: DataFrame, ids: DataFrame) -> DataFrame:
    return terms.join(ids.select(F.col("id").alias("entity_id")), "entity_id", "left_anti").select(*terms.columns)


def replace_terms(terms: DataFrame, words: DataFrame, clear_empty: bool = False) -> DataFrame:
    """The terms of each entity in ``words`` become exactly these; of several rows of an entity the last holds.

    Entities with an empty list keep their old terms, unless ``clear_empty``.
    """
    touched = words if clear_empty else words.filter(F.size("terms") > 0)
    order = [ORDER] if ORDER in words.columns else []
    last = last_of_batch(touched.select("entity_id", "terms", *order), ["entity_id"])
    return add_terms(clear_terms(terms, last.select(F.col("entity_id").alias("id"))), last)
