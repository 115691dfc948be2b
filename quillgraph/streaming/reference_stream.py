"""Orphan references kept up by a stream of change deltas (an extension: the base tables are batches).

Each micro-batch folds its deltas into the two tables of signed counts. The new state is written to a folder
of its own and becomes current by the creation of one file named after the batch, so a batch that is run
again after a failure does not count twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.references import EXIST_KEYS, REF_KEYS, fold, orphan_report


class ReferenceState:
    """State after each batch: ``<base>/<batch>/{references,existence}``, complete if ``<batch>/done`` is there."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _done(self) -> list[int]:
        folder = self._path(self.base)
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit() and self._fs.exists(self._path(f"{self.base}/{n}/done")))

    def current(self) -> tuple[DataFrame, DataFrame] | None:
        done = self._done()
        if not done:
            return None
        return tuple(self.spark.read.parquet(f"{self.base}/{done[-1]}/{t}") for t in ("references", "existence"))

    def apply(self, references: DataFrame, existence: DataFrame, batch: int) -> None:
        """Fold one batch of deltas; a batch that is done is left out."""
        done = self._done()
        if done and done[-1] >= batch:
            return
        old = self.current() or (None, None)
        home = f"{self.base}/{batch}"
        fold(references, REF_KEYS, old[0]).write.mode("overwrite").parquet(f"{home}/references")
        fold(existence, EXIST_KEYS, old[1]).write.mode("overwrite").parquet(f"{home}/existence")
        self._fs.create(self._path(f"{home}/done"), True).close()

    def report(self) -> DataFrame | None:
        state = self.current()
        return None if state is None else orphan_report(*state)


def start(deltas: DataFrame, state: ReferenceState, checkpoint: str, trigger: dict | None = None):
    """Run a stream of deltas with columns ``side`` (reference or existence), the keys of both, and ``delta``."""

    def fold_batch(batch: DataFrame, number: int) -> None:
        side = lambda name, keys: batch.filter(batch["side"] == name).select(*keys, "delta")
        batch.persist()
        state.apply(side("reference", REF_KEYS), side("existence", EXIST_KEYS), number)
        batch.unpersist()

    writer = deltas.writeStream.foreachBatch(fold_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
