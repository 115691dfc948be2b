"""Plugin contract and runner."""

from __future__ import annotations

import importlib.util
import re
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce
from pathlib import Path
from types import ModuleType
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.plugins import GraphDelta
from .store import GraphStore


@dataclass
class IngestContext:
    """What a plugin gets: the session, the store, its options and a log. ``view`` opens the tables to SQL."""

    spark: SparkSession
    store: GraphStore
    options: dict[str, Any] = field(default_factory=dict)
    log: Callable[[str], None] = print

    def view(self) -> None:
        for name in ("entities", "edges", "terms"):
            self.store.read().table(name).createOrReplaceTempView(name)

    def sql(self, query: str) -> DataFrame:
        self.view()
        return self.spark.sql(query)


@runtime_checkable
class Plugin(Protocol):
    name: str

    def run(self, ctx: IngestContext) -> GraphDelta | None: ...


class PluginError(ValueError):
    """The module does not give a plugin."""


def _is_plugin(x: Any) -> bool:
    return isinstance(getattr(x, "name", None), str) and callable(getattr(x, "run", None))


def resolve_plugin(module: ModuleType | None) -> Plugin:
    """The plugin of a module: its PLUGIN, or what its PLUGIN or make_plugin returns without arguments."""
    if module is None:
        raise PluginError("plugin module did not export anything")
    value = getattr(module, "PLUGIN", None) or getattr(module, "make_plugin", None)
    if value is None:
        raise PluginError("plugin module has no PLUGIN or make_plugin")
    if _is_plugin(value) and not isinstance(value, type):
        return value
    if callable(value):
        made = value()
        if _is_plugin(made):
            return made
        raise PluginError("plugin factory did not return a valid plugin")
    raise PluginError("PLUGIN is not a valid plugin (missing name or run)")


def load_plugin(path: str) -> Plugin:
    file = Path(path).resolve()
    if not file.exists():
        raise FileNotFoundError(f"no plugin at {file}")
    spec = importlib.util.spec_from_file_location(f"plugin_{file.stem}", file)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return resolve_plugin(module)


def coerce_options(pairs: list[str]) -> dict[str, Any]:
    """``key``, ``key=true|false``, ``key=<integer>`` or ``key=text``; split at the first equals sign."""
    out: dict[str, Any] = {}
    for pair in pairs:
        key, sign, value = pair.partition("=")
        if not sign:
            out[key] = True
        elif value in ("true", "false"):
            out[key] = value == "true"
        else:
            out[key] = int(value) if re.fullmatch(r"-?[0-9]+", value) else value
    return out


@dataclass
class IngestResult:
    plugin: str
    entities_before: int
    entities_after: int
    edges_before: int
    edges_after: int
    duration_ms: int

    def as_dict(self) -> dict[str, Any]:
        """As the command line prints it, in camel case."""
        return {re.sub("_(.)", lambda m: m.group(1).upper(), k): v for k, v in asdict(self).items()}


def batch_counters(delta: GraphDelta) -> dict[str, int]:
    """Rows of a batch as its sources gave them: entities, edges, entities with terms, rejects, dropped edges; one job."""
    tables = {"entities": delta.entities, "edges": delta.edges, "term_sets": delta.terms.filter(F.size("terms") > 0), "rejected": delta.rejects, "dropped": delta.dropped}
    ones = [df.select(F.lit(name).alias("name")) for name, df in tables.items() if df is not None]
    counted = reduce(DataFrame.unionAll, ones).groupBy("name").count().collect()  # a row for each table
    return dict.fromkeys(tables, 0) | {r["name"]: r["count"] for r in counted}


def run_ingest(store: GraphStore, plugin: Plugin | str, options: dict | None = None, log=print) -> IngestResult:
    """Migrate, run the plugin, commit its delta once. A failure leaves the store as it was."""
    store.migrate()
    plugin = load_plugin(plugin) if isinstance(plugin, str) else plugin
    before = store.read()
    counts = before.entities.count(), before.edges.count()
    began = time.monotonic()
    delta = plugin.run(IngestContext(store.spark, store, dict(options or {}), log))
    if delta is not None:
        store.apply(delta, f"ingest {plugin.name}")
        delta.counters |= batch_counters(delta)
        log("loaded {entities} entities, {edges} edges, {term_sets} term sets".format(**delta.counters))
        for label, rows, n in (("rejected", delta.rejects, delta.counters["rejected"]), ("dropped edge", delta.dropped, delta.counters["dropped"])):
            if n:
                log(f"{label}: {n}")
                for r in rows.limit(20).collect():  # a log has its limit; all rows are in the delta
                    log("  - " + ", ".join(str(x) for x in r.asDict().values() if not isinstance(x, tuple)))
    took = round((time.monotonic() - began) * 1000)
    after = store.read()
    return IngestResult(plugin.name, counts[0], after.entities.count(), counts[1], after.edges.count(), took)
