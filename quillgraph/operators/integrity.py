"""Keys, foreign keys and references between the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class IntegrityError(ValueError):
    """A commit would break a key or a foreign key; nothing was written."""


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def fk_violations(entities: DataFrame, edges: DataFrame, terms: DataFrame) -> DataFrame:
    """``ref_table, ref_field, target_id, n``: targets of edges and terms that are no entity.

    Targets are counted first, so the anti-join sees one row per field and target.
    """
    ends = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("id")) for c in ("src", "dst")])).alias("r")
    refs = edges.select(F.lit("edges").alias("ref_table"), ends).select("ref_table", F.col("r.f").alias("ref_field"), F.col("r.id").alias("target_id"))
    words = terms.select(F.lit("terms").alias("ref_table"), F.lit("entity_id").alias("ref_field"), F.col("entity_id").alias("target_id"))
    counted = refs.unionByName(words).groupBy("ref_table", "ref_field", "target_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(entities.select(F.col("id").alias("target_id")), "target_id", "left_anti").select(
        "ref_table", "ref_field", "target_id", "n"
    )


def endpoints_exist(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """``src, dst, src_exists, dst_exists`` for candidate edges."""
    ids = entities.select("id").distinct()
    src = ids.select(F.col("id").alias("src"), F.lit(True).alias("src_exists"))
    dst = ids.select(F.col("id").alias("dst"), F.lit(True).alias("dst_exists"))
    both = pairs.select("src", "dst").distinct().join(src, "src", "left").join(dst, "dst", "left")
    no = F.lit(False)
    return both.select("src", "dst", F.coalesce("src_exists", no).alias("src_exists"), F.coalesce("dst_exists", no).alias("dst_exists"))


def split_orphans(edges: DataFrame, batch: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose target is in the batch or in the base, and those dropped. The source is not checked."""
    known = batch.select(F.col("id").alias("dst")).union(entities.select("id")).distinct()
    return edges.join(known, "dst", "left_semi").select(*edges.columns), edges.join(known, "dst", "left_anti").select(*edges.columns)


def missing_refs(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows of ``refs`` (column ``ref``) that are no entity; repeated mentions stay."""
    return refs.join(entities.select(F.col("id").alias("ref")), "ref", "left_anti")
