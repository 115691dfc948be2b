"""Reads by key, type, term and metadata; counts and the status document.

Optional filters follow two conventions: ``count``, ``outgoing`` and ``incoming`` filter whenever a value is
given, even the empty string (which matches nothing); searches take an empty type as no filter. A negative
limit means all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import excerpt


def limited(df: DataFrame, limit: int | None) -> DataFrame:
    """A negative limit takes all, zero none; anything but a whole number is an error."""
    if isinstance(limit, bool) or not isinstance(limit, int):
        raise ValueError(f"datatype mismatch: limit {limit!r} is not an integer")
    return df if limit < 0 else df.limit(limit)


def get_entity(entities: DataFrame, id: str) -> DataFrame:
    """The entity with this id: one row or none. The filter reaches the parquet scan."""
    return entities.filter(F.col("id") == id).limit(1)


def list_by_type(entities: DataFrame, type: str, limit: int = 100) -> DataFrame:
    """Latest entities of a type; ties by id."""
    return limited(entities.filter(F.col("type") == type).orderBy(F.desc("updated_at"), "id"), limit)


def count_entities(entities: DataFrame, type: str | None = None) -> DataFrame:
    rows = entities if type is None else entities.filter(F.col("type") == type)
    return rows.agg(F.count(F.lit(1)).alias("c"))


def count_by_type(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.count(F.lit(1)).alias("c")).orderBy("type")


def status(entities: DataFrame, edges: DataFrame, terms: DataFrame) -> DataFrame:
    """One row: ``total, by_type array<struct<type,c>>, edges, terms``; each table is counted once."""
    kinds = F.sort_array(F.collect_list(F.struct("type", "c"))).alias("by_type")
    types = entities.groupBy("type").agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), kinds)
    return types.select("total", "by_type", _size(edges).alias("edges"), _size(terms).alias("terms"))


def _size(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def json_value(column: Column, path: str) -> Column:
    """The value at a JSON path as text; null where the text is no JSON or the path is absent."""
    return F.get_json_object(column, path)


def json_filter(entities: DataFrame, path: str, value: str) -> DataFrame:
    return entities.filter(json_value(F.col("metadata"), path) == value)


def json_distinct(entities: DataFrame, path: str) -> DataFrame:
    """Distinct non-empty values at a JSON path."""
    value = json_value(F.col("metadata"), path).alias("value")
    return entities.select(value).filter(F.col("value").isNotNull() & (F.col("value") != "")).distinct()


def by_term(entities: DataFrame, terms: DataFrame, term: str, type: str | None = None, limit: int = 20) -> DataFrame:
    """``id, type, name, snippet, updated_at`` of the records that list a term: exact, but for its letter case; latest first.

    The term is filtered before the join, so only its own records are looked up.
    """
    listed = terms.filter(F.col("term") == term.lower()).select(F.col("entity_id").alias("id")).distinct()
    rows = entities.filter(F.col("type") == type) if type else entities
    hits = rows.join(listed, "id").select("id", "type", "name", excerpt(F.col("body")).alias("snippet"), "updated_at")
    return limited(hits.orderBy(F.desc("updated_at"), "id"), limit)
