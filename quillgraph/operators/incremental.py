"""Processing only new or changed records.

The commit sequence is ``landed_at``: it only grows as rows arrive, while ``updated_at`` may come late or
out of order. A run has an upper limit that is fixed when it starts; it takes the rows with a sequence in
``(watermark, upper]`` of its root, folds them into the state (best row per root and id), and reports the ids
whose state differs. Rows, state and watermarks become visible together, by one commit file; a run
that fails before leaves nothing behind that a later run would read.

A call takes all runs of a log that are later than the watermarks, each with its own limits, in one fold: each row
belongs to the first successful run that started at or after its landing. The best row per (root, id, run) is
combined map-side, so an id with a third of all rows is reduced to at most one row per run before the window over
runs. The state is kept in parts by hash of the id; a commit reads and writes only the parts its rows touch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..commits import CommitLog

CONTENT = ["type", "name", "body", "metadata"]
STATE = "struct<updated_at: timestamp_ntz, fp: binary>"
#: Parts of the state; a run is folded by at most so many tasks.
PARTS = 64


def normal_path(path: Column) -> Column:
    """Backslashes become slashes; leading ``./`` and ``/`` go, repeated ones too. Null and empty paths are alike: empty."""
    return F.coalesce(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\./|/)+", ""), F.lit(""))


def root_of(path: Column) -> Column:
    """First segment of a normal path; ``none`` for an empty one."""
    return F.when(path == "", F.lit("none")).otherwise(F.substring_index(path, "/", 1))


def fingerprinted(rows: DataFrame, seq: str = "landed_at") -> DataFrame:
    """``root, id, seq, updated_at, fp``: what a run has to know of a row.

    Null fields differ from empty ones, but for the path. Rows without an id are no records, and rows without a
    sequence have not landed: neither is ever taken.
    """
    path = normal_path(F.col("source_path"))
    content = F.struct(*CONTENT, path.alias("path"))
    return rows.filter(F.col("id").isNotNull() & F.col(seq).isNotNull()).select(
        root_of(path).alias("root"),
        "id",
        F.col(seq).alias("seq"),
        F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
        F.unhex(F.sha2(F.to_json(content), 256)).alias("fp"),
    )


def successful(runs: DataFrame) -> DataFrame:
    return runs.filter((F.col("status") == "ok") & F.col("finished_at").isNotNull() & F.col("started_at").isNotNull())


def run_slots(runs: DataFrame, marks: DataFrame):
    """Pending runs as the intervals ``(after, upper]`` they take, one row per day an interval touches, and their bounds.

    ``marks`` has ``root, mark, mark_run``: the last run taken of each root. Earlier runs of the log are done; rows of
    a run that is logged late were taken by the next one. The bounds are ``first``, the day of the earliest pending run (all rows landed
    before it belong to that day's slot), ``low``, after which all rows to take have landed (null if some root has no run
    before), and ``high``, the last upper limit. The day makes the as-of lookup an equi-join; a day holds only the
    runs of that day and the next one.
    """
    order = Window.partitionBy("source_root").orderBy("started_at", "run_id")
    ok = successful(runs).select(F.col("source_root").alias("root"), "source_root", "run_id", "started_at").join(F.broadcast(marks), "root", "left")
    later = F.struct("started_at", "run_id") > F.struct(F.col("mark").alias("started_at"), F.col("mark_run").alias("run_id"))
    ok = ok.filter(F.col("mark").isNull() | later)
    ok = ok.withColumn("after", F.coalesce(F.lag("started_at").over(order), "mark")).withColumn("k", F.row_number().over(order))
    low = F.when(F.count_if(F.col("after").isNull()) == 0, F.min("after"))
    bounds = ok.agg(F.min(F.to_date("started_at")).alias("first"), low.alias("low"), F.max("started_at").alias("high")).first()
    first = bounds["first"]
    days = F.sequence(F.greatest(F.coalesce(F.to_date("after"), F.lit(first)), F.lit(first)), F.to_date("started_at"))
    return ok.select(F.col("root").alias("run_root"), "run_id", "k", "after", F.col("started_at").alias("upper"), F.explode(days).alias("day")), bounds


def best_rows(rows: DataFrame, slots: DataFrame, bounds) -> DataFrame:
    """``root, id, k, run_id, best``: the best row of each id among those a run takes. The bounds reach the scan of ``rows``."""
    seq, kind = F.col("landed_at"), rows.schema["landed_at"].dataType
    at = lambda bound: F.lit(str(bounds[bound])).cast(kind)
    rows = rows.filter(seq <= at("high"))
    if bounds["low"] is not None:
        rows = rows.filter(seq > at("low"))
    marked = fingerprinted(rows).withColumn("day", F.greatest(F.to_date("seq"), F.lit(bounds["first"])))
    taken = marked.join(
        slots,
        (marked["root"] == slots["run_root"])
        & (marked["day"] == slots["day"])
        & (marked["seq"] <= slots["upper"])
        & (slots["after"].isNull() | (marked["seq"] > slots["after"])),
    )
    return taken.groupBy("root", "id", "k", "run_id").agg(F.max(F.struct("updated_at", "fp")).cast(STATE).alias("best"))


def fold(best: DataFrame) -> DataFrame:
    """``part, root, id, run_id, change, state``: per run, whether an id is ``new``, ``changed`` or null; ``state`` in the last row only.

    Rows with ``k`` 0 are the state before; they are no run. Rows are moved by part, so each part is written by one task.
    """
    over = Window.partitionBy("part", "root", "id").orderBy("k")
    best = best.repartition("part")
    state = best.withColumn("now", F.max("best").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    state = state.withColumn("before", F.lag("now").over(over)).withColumn("last", F.lead("k").over(over).isNull())
    change = F.when(F.col("k") == 0, None).when(F.col("before").isNull(), "new").when(F.col("before.fp") != F.col("now.fp"), "changed")
    out = state.select("part", "root", "id", "run_id", change.alias("change"), F.when(F.col("last"), F.col("now")).alias("state"))
    return out.filter(F.col("change").isNotNull() | F.col("state").isNotNull())


class IncrementalRunner:
    """Exactly-once runs, with output, state and watermarks in a folder all executors share.

    ``<base>/commits/<n>.json`` names the last run of each root, the folder of each part of the state, and the folder
    of the commit's output. Of two runners that start from one commit, one fails (``commits.ConflictError``).
    """

    def __init__(self, spark: SparkSession, base: str, parts: int = PARTS):
        self.spark, self.base, self.parts = spark, base.rstrip("/"), parts
        self.log = CommitLog(spark, f"{self.base}/commits")

    def _marks(self, last: dict) -> DataFrame:
        rows = [(root, m["started_at"], m["run_id"]) for root, m in last["marks"].items()]
        return self.spark.createDataFrame(rows, "root string, mark string, mark_run bigint").withColumn("mark", F.col("mark").cast("timestamp_ntz"))

    def _state(self, last: dict, parts: list[int]) -> DataFrame | None:
        folders = [last["state"][str(p)] for p in parts if str(p) in last["state"]]
        if not folders:
            return None
        held = self.spark.read.parquet(*folders).filter(F.col("state").isNotNull())
        return held.select("root", "id", F.lit(0).alias("k"), F.lit(None).cast("bigint").alias("run_id"), F.col("state").alias("best"))

    def run_log(self, rows: DataFrame, runs: DataFrame) -> DataFrame:
        """Take all pending runs of a log (``run_id, source_root, started_at, finished_at, status``); returns ``run_id, id, change``.

        A run succeeded if its status is ``ok`` and it has an end; other runs take nothing. Rows of ``rows`` that tie on
        ``updated_at`` count as copies; a null ``updated_at`` is older than any other. Rows that landed after the last
        run of their root stay pending. Without pending runs, or with empty tables, nothing is committed and no row comes
        out.
        """
        last = self.log.latest() or {"n": 0, "marks": {}, "state": {}}
        slots, bounds = run_slots(runs, self._marks(last))
        if bounds["first"] is None:
            return self.spark.createDataFrame([], "run_id bigint, id string, change string")
        part = F.pmod(F.xxhash64("id"), F.lit(self.parts)).cast("int")
        home = f"{self.base}/data/{uuid.uuid4().hex}"
        best = best_rows(rows, slots, bounds).withColumn("part", part)
        if last["state"]:
            best.write.parquet(f"{home}/taken")
            taken = self.spark.read.parquet(f"{home}/taken")
            touched = taken.agg(F.collect_set("part")).first()[0]  # at most self.parts numbers
            old = self._state(last, touched)
            best = taken if old is None else taken.unionByName(old.withColumn("part", part))
        fold(best).write.partitionBy("part").parquet(f"{home}/out")
        names = [s.getPath().getName() for s in self.log._fs.listStatus(self.log._path(f"{home}/out"))]
        written = {n.removeprefix("part="): f"{home}/out/{n}" for n in names if n.startswith("part=")}
        ends = slots.groupBy("run_root").agg(F.max(F.struct("upper", "run_id")).alias("m"))
        marks = {r["run_root"]: {"started_at": str(r["m"]["upper"]), "run_id": r["m"]["run_id"]} for r in ends.collect()}  # a row for each root
        entry = {"n": last["n"] + 1, "marks": last["marks"] | marks, "state": last["state"] | written, "output": f"{home}/out"}
        self.log.append(entry["n"], entry)
        return self.output(entry)

    def output(self, entry: dict | None = None) -> DataFrame:
        """``run_id, id, change`` of a commit, the last one by default."""
        entry = entry or self.log.latest()
        schema = f"root string, id string, run_id bigint, change string, state {STATE}, part int"
        out = self.spark.read.schema(schema).parquet(entry["output"])
        return out.filter(F.col("change").isNotNull()).select("run_id", "id", "change")

    def run(self, rows: DataFrame, root: str, run_id: int, started_at) -> DataFrame:
        """One run over one root, its upper limit fixed at ``started_at``."""
        log = self.spark.createDataFrame([(run_id, root, str(started_at), "ok")], "run_id bigint, source_root string, started_at string, status string")
        log = log.withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))
        return self.run_log(rows, log.withColumn("finished_at", F.col("started_at")))
