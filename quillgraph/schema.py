"""The property graph: entities, edges, terms, and the tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_S, _TS = T.StringType(), T.TimestampNTZType()

#: Key ``id``. ``metadata`` is the text of a JSON object.
ENTITIES = _struct(id=_S, type=_S, name=_S, body=_S, metadata=_S, source_path=_S, updated_at=_TS)
#: Key ``(src, dst, relation)``: a multigraph by relation; self-loops are allowed.
EDGES = _struct(src=_S, dst=_S, relation=_S, metadata=_S)
#: Key ``(term, entity_id)``; terms are lower case.
TERMS = _struct(term=_S, entity_id=_S)
#: One row per token, record and column; ``positions`` count from 0 within the column, ``dl`` is the length of the record.
POSTINGS = _struct(token=_S, id=_S, col=T.IntegerType(), positions=T.ArrayType(T.IntegerType()), dl=T.IntegerType())

#: Records of a part of a store and their tokens in all.
SIZE = _struct(n=T.LongType(), length=T.LongType())

TABLES = {"entities": ENTITIES, "edges": EDGES, "terms": TERMS}
KEYS = {"entities": ["id"], "edges": ["src", "dst", "relation"], "terms": ["term", "entity_id"]}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


#: Column with the order of the rows of a batch; the last row of a key holds.
ORDER = "__order"


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in their types, and the order of the batch if it has one; missing ones are null, others are dropped."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[table].fields
        ],
        *([ORDER] if ORDER in have else []),
    )
