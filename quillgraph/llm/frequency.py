"""Frequency of every distinct term, by range-partitioned external sort and run-length scanning.

Pairs of term and record are combined within each Arrow batch, range-partitioned by (term, record), sorted
(externally: Spark's sorter spills), and scanned: a run of equal pairs is one record of the term. A very
frequent term spans several ranges, as the range bounds include the record; since a pair never does, the
counts of the ranges add up exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_term

#: A term is common if more than this share of all records holds it.
COMMON_SHARE = 0.2


def term_pairs(terms: DataFrame) -> DataFrame:
    """``term, entity_id`` in normal form; null and blank terms are none; an empty record id counts as null."""
    record = F.when(F.col("entity_id") != "", F.col("entity_id"))
    pairs = terms.select(normal_term(F.col("term")).alias("term"), record.alias("entity_id"))
    return pairs.filter(F.col("term") != "")


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal pairs of a batch become one row with their number."""
    for batch in batches:
        if batch.num_rows:
            t = pa.Table.from_batches([batch]).group_by(["term", "entity_id"]).aggregate([([], "count_all")])
            t = t.rename_columns(["term", "entity_id", "n"]) if t.column_names[0] == "term" else t.select(["term", "entity_id", "count_all"]).rename_columns(["term", "entity_id", "n"])
            yield from t.cast(pa.schema([("term", pa.string()), ("entity_id", pa.string()), ("n", pa.int64())])).combine_chunks().to_batches()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run lengths over sorted pairs: ``term, n_rows, n_records``, one row per term of this range."""
    schema = pa.schema([("term", pa.string()), ("n_rows", pa.int64()), ("n_records", pa.int64())])
    last, held = None, None  # the last pair, and the open run of its term
    for batch in batches:
        if not batch.num_rows:
            continue
        term, record, n = (batch.column(i).cast(k) for i, k in ((0, pa.string()), (1, pa.string()), (2, pa.int64())))
        first = (term[0].as_py(), record[0].as_py())
        if batch.num_rows > 1:
            same_term = pc.equal(term[1:], term[:-1])
            same_pair = pc.and_(same_term, pc.fill_null(pc.equal(record[1:], record[:-1]), False))
            fresh = pa.concat_arrays([pa.array([first != last]), pc.invert(same_pair)])
        else:
            fresh = pa.array([first != last])
        fresh = pc.cast(pc.and_(fresh, pc.is_valid(record)), pa.int64())
        t = pa.table([term, n, fresh], ["term", "n", "fresh"]).group_by("term", use_threads=False).aggregate([("n", "sum"), ("fresh", "sum")])
        rows = list(zip(t["term"].to_pylist(), t["n_sum"].to_pylist(), t["fresh_sum"].to_pylist()))
        if held and held[0] == rows[0][0]:
            rows[0] = (held[0], held[1] + rows[0][1], held[2] + rows[0][2])
        elif held:
            rows.insert(0, held)
        held, last = rows.pop(), (term[-1].as_py(), record[-1].as_py())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*rows), schema)], schema=schema)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x], k.type) for x, k in zip(held, schema)], schema=schema)


def term_frequencies(terms: DataFrame, common_share: float = COMMON_SHARE) -> DataFrame:
    """``term, n_rows, n_records, mark`` for every distinct term.

    ``n_rows`` counts rows, repeated ones too, ``n_records`` distinct non-empty records; ``mark`` is ``rare``
    for one record, ``common`` for more than ``common_share`` of all records (``common`` wins where both
    hold, with under five records), else null. An empty table gives no rows.
    """
    pairs = term_pairs(terms)
    combined = pairs.mapInArrow(_combine, "term string, entity_id string, n bigint")
    ordered = combined.repartitionByRange("term", "entity_id").sortWithinPartitions("term", "entity_id")
    runs = ordered.mapInArrow(_scan, "term string, n_rows bigint, n_records bigint")
    counts = runs.groupBy("term").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_records").alias("n_records"))
    ids = terms.filter(F.col("entity_id") != "").select("entity_id").distinct()
    total = ids.agg(F.count(F.lit(1))).scalar()
    mark = F.when(F.col("n_records") > total * common_share, "common").when(F.col("n_records") == 1, "rare")
    return counts.select("term", "n_rows", "n_records", mark.alias("mark"))
