"""Snapshot store: immutable versions of the graph, and transactions that make the next one.

    <root>/commits/<version>.json          manifest: the folder of each part of each table, note, migrations
    <root>/data/<uuid>/<table>/part=<n>/   parquet; a part that a commit does not change keeps its old folder

Every table is kept in parts by hash: entities and postings by record, terms by record, edges by both ends, so a
hot term, token or target is spread over all parts; within a part rows are sorted by access path (edges are kept
twice, by source and by target), so a read of one key takes a row group of each part. A transaction pins the version
it starts from, stages any number of mutations, and rewrites only the parts they touch; the keys it adds are
checked against the staged version. It ends in one manifest, created whole and once (``commits``), with the number
after the pinned version: readers see one state, a failed transaction leaves nothing, and of two
writers that started from one version the second fails with ConflictError and can start again.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import CommitLog
from .operators import mutations as M
from .operators.integrity import IntegrityError, duplicate_keys, fk_violations
from .plans.fts_plan import build_postings, corpus_size
from .schema import KEYS, POSTINGS, SIZE, TABLES
from .session import list_files, read_text
from .sources.plugins import GraphDelta

MIGRATION = re.compile(r"^(\d{4})_.+\.sql$")
#: Parts of each table: about one for every GB of the largest.
PARTS = 16

#: Of each stored table: the table it holds, the columns whose hash gives the part, the order within a part.
LAYOUT = {
    "entities": ("entities", ["id"], ["type", "id"]),
    "edges": ("edges", ["src", "dst"], ["src", "relation", "dst"]),
    "edges_by_dst": ("edges", ["src", "dst"], ["dst", "relation", "src"]),
    "terms": ("terms", ["entity_id"], ["term", "entity_id"]),
    "postings": ("postings", ["id"], ["token", "id"]),
    "size": ("size", [], []),
}
_SCHEMAS = TABLES | {"postings": POSTINGS, "size": SIZE}


def now_iso() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def migration_files(names: list[str]) -> list[tuple[str, str]]:
    """``(id, name)`` of migration files in order of their names; other names are ignored."""
    return sorted(((m.group(1), n) for n in names if (m := MIGRATION.match(n))), key=lambda x: x[1])


def part_of(name: str, parts: int, columns: list[str] | None = None) -> Column:
    """The part of a row of a stored table; ``columns`` are those that hold its key, if they have other names."""
    return F.pmod(F.xxhash64(*(columns or LAYOUT[name][1])), F.lit(parts)).cast("int")


class Snapshot:
    """One version of the graph; every table is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, manifest: dict):
        self.spark, self.manifest = spark, manifest
        self.version: int = manifest["version"]

    def table(self, name: str, parts: set[int] | None = None) -> DataFrame:
        """A stored table, or these parts of it."""
        schema = _SCHEMAS[LAYOUT[name][0]]
        folders = [f for p, f in self.manifest["tables"].get(name, {}).items() if parts is None or int(p) in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    @property
    def entities(self) -> DataFrame:
        return self.table("entities")

    @property
    def edges(self) -> DataFrame:
        return self.table("edges")

    @property
    def terms(self) -> DataFrame:
        return self.table("terms")

    @property
    def postings(self) -> DataFrame | None:
        return self.table("postings") if "postings" in self.manifest["tables"] else None

    @property
    def size(self) -> DataFrame | None:
        """Records and their tokens in all, in one row."""
        if "size" not in self.manifest["tables"]:
            return None
        return self.table("size").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))


class Transaction:
    """Mutations on one version that become the next one together. Reads within it see what it has staged."""

    def __init__(self, store: GraphStore, base: Snapshot, note: str):
        self.store, self.base, self.note = store, base, note
        self.staged: dict[str, tuple[set[int], DataFrame]] = {}
        self.required: list[DataFrame] = []
        self.migrations = base.manifest["migrations"]
        self.done: Snapshot | None = None

    # staging

    def _parts(self, name: str, rows: DataFrame, columns: list[str] | None = None) -> set[int]:
        """Parts that hold these keys: at most as many numbers as there are parts."""
        return set(rows.agg(F.collect_set(part_of(name, self.store.parts, columns))).first()[0])

    def _parts_of_each(self, **rows: DataFrame) -> dict[str, set[int]]:
        """As :meth:`_parts` for several tables, in one job."""
        each = [df.select(F.lit(name).alias("name"), part_of(name, self.store.parts).alias("part")) for name, df in rows.items()]
        found = reduce(DataFrame.unionAll, each).groupBy("name").agg(F.collect_set("part").alias("parts")).collect()
        return {name: set() for name in rows} | {r["name"]: set(r["parts"]) for r in found}

    def table(self, name: str, parts: set[int] | None = None) -> DataFrame:
        """A table with what is staged, or these parts of it."""
        touched, rows = self.staged.get(name, (set(), None))
        wanted = set(range(self.store.parts)) if parts is None else parts
        out = self.base.table(name, wanted - touched)
        if rows is None or not wanted & touched:
            return out
        return out.unionByName(rows if touched <= wanted else rows.filter(part_of(name, self.store.parts).isin(*wanted)))

    def _stage(self, name: str, parts: set[int], rows: DataFrame) -> None:
        """These parts of a table become ``rows``."""
        touched, old = self.staged.get(name, (set(), None))
        if touched - parts:
            rows = rows.unionByName(old.filter(~part_of(name, self.store.parts).isin(*parts)))
        self.staged[name] = (touched | parts, rows)

    def _change(self, name: str, parts: set[int], change) -> None:
        if parts:
            self._stage(name, parts, change(self.table(name, parts)))

    def _need(self, table: str, rows: DataFrame, *columns: str) -> None:
        """The ids in these columns must be entities when the transaction ends."""
        for c in columns:
            self.required.append(rows.select(F.lit(table).alias("ref_table"), F.lit(c).alias("ref_field"), F.col(c).alias("target_id")))

    # mutations

    def upsert_entities(self, rows: DataFrame, order: str | None = None, parts: set[int] | None = None) -> None:
        rows = M.entity_rows(rows, self.store._now(), order)
        self._change("entities", self._parts("entities", rows) if parts is None else parts, lambda old: M.upsert(old, rows, KEYS["entities"]))

    def upsert_edges(self, rows: DataFrame, order: str | None = None, parts: set[int] | None = None) -> None:
        rows = M.edge_rows(rows, order)
        self._need("edges", rows, "src", "dst")
        self._change("edges", self._parts("edges", rows) if parts is None else parts, lambda old: M.upsert(old, rows, KEYS["edges"]))

    def delete_edges(self, keys: DataFrame) -> int:
        """Number of edges that were there."""
        keys = keys.select(*KEYS["edges"]).distinct()
        parts = self._parts("edges", keys)
        n = self.table("edges", parts).join(keys, KEYS["edges"], "left_semi").count()
        if n:
            self._change("edges", parts, lambda old: M.delete_edges(old, keys))
        return n

    def delete_entities(self, ids: DataFrame) -> int:
        """Number of entities that were there; their edges and terms go too."""
        ids = ids.select("id").distinct()
        parts = self._parts("entities", ids)
        n = self.table("entities", parts).join(ids, "id", "left_semi").count()
        if n:
            self._change("entities", parts, lambda old: old.join(ids, "id", "left_anti"))
            gone = reduce(DataFrame.unionByName, [self.table("edges").join(ids.withColumnRenamed("id", c), c, "left_semi").select("src", "dst") for c in ("src", "dst")])
            self._change("edges", self._parts("edges", gone), lambda old: M.edges_without(old, ids))
            self._change("terms", self._parts("terms", ids, ["id"]), lambda old: M.clear_terms(old, ids))
        return n

    def add_terms(self, words: DataFrame) -> None:
        rows = M.term_rows(words)
        self._need("terms", rows, "entity_id")
        self._change("terms", self._parts("terms", rows), lambda old: M.add_terms(old, words))

    def clear_terms(self, ids: DataFrame) -> None:
        self._change("terms", self._parts("terms", ids, ["id"]), lambda old: M.clear_terms(old, ids))

    def replace_terms(self, words: DataFrame, clear_empty: bool = False, parts: set[int] | None = None) -> None:
        self._need("terms", words.filter(F.size("terms") > 0), "entity_id")
        self._change("terms", self._parts("terms", words) if parts is None else parts, lambda old: M.replace_terms(old, words, clear_empty))

    def apply(self, delta: GraphDelta) -> None:
        """Entities, edges and terms of an ingest. Of records with one key the last in the order of their sources holds."""
        parts = self._parts_of_each(entities=delta.entities, edges=delta.edges, terms=delta.terms)
        self.upsert_entities(delta.entities, parts=parts["entities"])
        self.upsert_edges(delta.edges, parts=parts["edges"])
        self.replace_terms(delta.terms, delta.clear_empty, parts["terms"])

    # the end

    def commit(self) -> Snapshot:
        """Write the touched parts, check the staged version, publish it."""
        tables = {n: dict(t) for n, t in self.base.manifest["tables"].items()}
        staged = Snapshot(self.base.spark, self.base.manifest | {"version": self.base.version + 1, "tables": tables})
        with ThreadPoolExecutor(4) as pool:  # the jobs of a small commit are short, so they run beside each other
            tables |= dict(zip(self.staged, pool.map(lambda name: self._written(name, *self.staged[name]), self.staged)))
            later = [pool.submit(self._check, staged)]
            if "edges" in self.staged:
                parts = self.staged["edges"][0]
                later.append(pool.submit(self._derive, tables, "edges_by_dst", parts, staged.table("edges", parts)))
            if "entities" in self.staged and self.store.index:
                parts = self.staged["entities"][0]
                sizes = corpus_size(staged.table("entities", parts).withColumn("part", part_of("entities", self.store.parts)), "part")
                later.append(pool.submit(self._derive, tables, "size", parts, sizes))
                later.append(pool.submit(self._derive, tables, "postings", parts, self._postings(staged, parts)))
            for job in later:
                job.result()
        staged.manifest |= {"at": self.store.clock(), "note": self.note, "migrations": self.migrations, "parts": self.store.parts}
        self.store._publish(staged.manifest)
        self.done = staged
        return staged

    def _written(self, name: str, parts: set[int], rows: DataFrame) -> dict[str, str]:
        """The folders of all parts of a table after these have been written."""
        kept = {p: f for p, f in self.base.manifest["tables"].get(name, {}).items() if int(p) not in parts}
        folder = f"{self.store.root}/data/{uuid.uuid4().hex}/{name}"
        _, _, order = LAYOUT[name]
        rows = rows if "part" in rows.columns else rows.withColumn("part", part_of(name, self.store.parts))
        rows.repartition("part").sortWithinPartitions("part", *order).write.partitionBy("part").parquet(folder)
        return kept | {str(p): f"{folder}/part={p}" for p in self.store._written_parts(folder)}

    def _derive(self, tables: dict, name: str, parts: set[int], rows: DataFrame) -> None:
        tables[name] = self._written(name, parts, rows)

    def _postings(self, staged: Snapshot, parts: set[int]) -> DataFrame:
        """The full-text index of these parts: the postings of changed records are made again, others kept."""
        now, was = staged.table("entities", parts), self.base.table("entities", parts)
        if self.base.postings is None:
            return build_postings(now)
        text = F.struct("name", "body")
        both = now.select("id", text.alias("now")).join(was.select("id", text.alias("was")), "id", "full_outer")
        changed = both.filter(~F.col("now").eqNullSafe(F.col("was"))).select("id")
        kept = self.base.table("postings", parts).join(changed, "id", "left_anti").select(*POSTINGS.names)
        return kept.unionByName(build_postings(now.join(changed, "id", "left_semi")))

    def _check(self, staged: Snapshot) -> None:
        if not self.required:
            return
        needed = reduce(DataFrame.unionByName, self.required).distinct()
        parts = self._parts("entities", needed, ["target_id"])
        known = staged.table("entities", parts).select(F.col("id").alias("target_id"))
        broken = needed.join(known, "target_id", "left_anti").limit(3).collect()
        if broken:
            raise IntegrityError(f"FOREIGN KEY constraint failed: {broken[0].asDict()}")


class GraphStore:
    """A folder of versions. ``clock`` gives the time of a write, for tests; ``parts`` holds for a new store."""

    def __init__(self, spark: SparkSession, root: str, clock=now_iso, index: bool = True, parts: int = PARTS):
        self.spark, self.root, self.clock, self.index = spark, root.rstrip("/"), clock, index
        self.log = CommitLog(spark, f"{self.root}/commits")
        self.parts = (self.log.latest() or {}).get("parts", parts)

    # versions

    def exists(self) -> bool:
        return bool(self.log.numbers())

    def read(self, version: int | None = None) -> Snapshot:
        versions = self.log.numbers()
        if version is not None and version not in versions:
            raise KeyError(f"no version {version}")
        if not versions:
            return Snapshot(self.spark, {"version": 0, "tables": {}, "migrations": []})
        return Snapshot(self.spark, self.log.read(version or versions[-1]))

    def history(self) -> list[dict]:
        return [{k: m[k] for k in ("version", "at", "note")} for m in map(self.log.read, self.log.numbers())]

    def _publish(self, manifest: dict) -> None:
        self.log.append(manifest["version"], manifest)

    def _written_parts(self, folder: str) -> list[int]:
        names = [s.getPath().getName() for s in self.log._fs.listStatus(self.log._path(folder))]
        return sorted(int(n.removeprefix("part=")) for n in names if n.startswith("part="))

    def vacuum(self, keep: int = 1) -> int:
        """Delete the parts that none of the last ``keep`` versions names; returns their number. Older versions can't be read after.

        A transaction that has not ended has parts that no version names yet: run this when none is open.
        """
        named = {f for n in self.log.numbers()[-keep:] for folders in self.log.read(n)["tables"].values() for f in folders.values()}
        fs, path = self.log._fs, self.log._path
        found = [s.getPath() for s in fs.globStatus(path(f"{self.root}/data/*/*/part=*")) or []]
        qualified = {fs.makeQualified(path(f)).toString() for f in named}
        old = [p for p in found if p.toString() not in qualified]
        for p in old:
            fs.delete(p, True)
        return len(old)

    @contextmanager
    def transaction(self, note: str = "transaction") -> Iterator[Transaction]:
        """Several mutations as one commit; an error within leaves the store as it was."""
        t = Transaction(self, self.read(), note)
        yield t
        if t.staged or t.migrations != t.base.manifest["migrations"]:
            t.commit()

    def commit(self, note: str = "", base: Snapshot | None = None, check: bool = True, **tables: DataFrame) -> Snapshot:
        """Replace whole tables, computed from version ``base`` (the latest by default); fails if it is no longer the latest."""
        t = Transaction(self, base or self.read(), note)
        every = set(range(self.parts))
        for name, rows in tables.items():
            if check and (twice := duplicate_keys(rows, KEYS[name]).limit(3).collect()):
                raise IntegrityError(f"{name}: repeated key {twice[0].asDict()}")
            t._stage(name, every, rows.select(*TABLES[name].names))
        if check and (broken := fk_violations(*(t.table(n) for n in TABLES)).limit(3).collect()):
            raise IntegrityError(f"FOREIGN KEY constraint failed: {broken[0].asDict()}")
        return t.commit()

    # migrations

    def migrate(self, folder: str | None = None) -> list[dict]:
        """Apply the pending migrations of a folder in order of their names, each in a commit of its own.

        A migration is a file of SQL statements, separated by semicolons at line ends. ``INSERT``, ``UPDATE`` and ``DELETE`` are not
        Spark's on such tables; a statement is ``REPLACE entities|edges|terms AS SELECT ...`` over the tables as they
        are. The built-in 0001 has none: it creates the empty store. Applied migrations are skipped; a failing
        one leaves nothing of itself and stops the rest.
        """
        files = {"0001_init.sql": ""}
        if folder is not None:
            names = [p.rpartition("/")[2] for p in list_files(self.spark, folder)]
            files |= {name: read_text(self.spark, f"{folder.rstrip('/')}/{name}") for _, name in migration_files(names)}
        for id, name in migration_files(list(files)):
            if id in {m["id"] for m in self.migrations()}:
                continue
            with self.transaction(f"migration {name}") as t:
                t.migrations = [*t.migrations, {"id": id, "filename": name, "applied_at": self.clock()}]
                for statement in filter(None, (s.strip() for s in re.split(r";\s*(?:\n|\Z)", files[name]))):
                    m = re.match(r"REPLACE\s+(entities|edges|terms)\s+AS\s+(SELECT\b.*)", statement, re.I | re.S)
                    if not m:
                        raise ValueError(f"{name}: not a statement of a migration: {statement[:80]}")
                    query, table = m.group(2), m.group(1).lower()
                    rows = self.spark.sql(query, **{n: t.table(n) for n in TABLES if re.search(rf"\{{{n}\}}", query)})
                    if twice := duplicate_keys(rows, KEYS[table]).limit(1).collect():
                        raise IntegrityError(f"{table}: repeated key {twice[0].asDict()}")
                    t._stage(table, set(range(self.parts)), rows.select(*TABLES[table].names))
                if t.staged and (broken := fk_violations(*(t.table(n) for n in TABLES)).limit(1).collect()):
                    raise IntegrityError(f"FOREIGN KEY constraint failed: {broken[0].asDict()}")
        return self.migrations()

    def migrations(self) -> list[dict]:
        return sorted(self.read().manifest["migrations"], key=lambda m: m["id"])

    # mutations; each is one transaction

    def apply(self, delta: GraphDelta, note: str = "ingest") -> Snapshot:
        """Entities, edges and terms of an ingest, in one commit."""
        with self.transaction(note) as t:
            t.apply(delta)
        return t.done or t.base

    def _now(self):
        return datetime.fromisoformat(self.clock().replace("Z", "+00:00")).replace(tzinfo=None)

    def upsert_entities(self, rows: DataFrame, order: str | None = None) -> int:
        with self.transaction("upsert entities") as t:
            t.upsert_entities(rows, order)
        return rows.count()

    def upsert_edges(self, rows: DataFrame, order: str | None = None) -> int:
        with self.transaction("upsert edges") as t:
            t.upsert_edges(rows, order)
        return rows.count()

    def delete_entities(self, ids: DataFrame) -> int:
        """Number of entities that were there."""
        with self.transaction("delete entities") as t:
            return t.delete_entities(ids)

    def delete_edges(self, keys: DataFrame) -> int:
        with self.transaction("delete edges") as t:
            return t.delete_edges(keys)

    def add_terms(self, words: DataFrame) -> None:
        with self.transaction("add terms") as t:
            t.add_terms(words)

    def clear_terms(self, ids: DataFrame) -> None:
        with self.transaction("clear terms") as t:
            t.clear_terms(ids)
