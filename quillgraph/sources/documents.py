"""Sources: markdown with front matter, JSON manifests, YAML rule files, inline rows.

Every reader gives one row per record with ``source_path``, and keeps what it can't read as reject rows.
Files are read whole and in parallel; a missing folder is an empty source where the reader is tolerant.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from ..schema import conform
from ..session import path_exists

FILES = "source_path string, content string"


def read_files(spark: SparkSession, root: str, glob: str, tolerant: bool = True) -> DataFrame:
    """``source_path, content`` of all files under a folder whose name matches; one row per file.

    A missing folder gives no rows if ``tolerant``, else an error.
    """
    if tolerant and not path_exists(spark, root):
        return spark.createDataFrame([], FILES)
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.select(F.regexp_replace("_metadata.file_path", "^file:(?://)?", "").alias("source_path"), F.col("value").alias("content"))


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\r\n"))


def _unquote(text: Column) -> Column:
    return F.regexp_replace(text, "^[\"']|[\"']$", "")


def front_matter(content: Column, quotes: bool = False) -> Column:
    """``struct<values: map<string, struct<text, list>>, body>`` of a document.

    The head lies between lines of three dashes; without one there are no values and the body is the whole
    text. A line ``key: value`` gives a text, ``key: [a, b]`` a list; other lines are skipped and the last of
    equal keys holds. Nothing is converted; with ``quotes`` one quote at each end is removed. A null content
    gives null values and body.
    """
    shape = r"(?s)^---[ \t\r\n\f]*?\n(.*?)\n---[ \t\r\n\f]*?\n(.*)$"
    has = content.rlike(shape)
    head = F.when(has, F.regexp_extract(content, shape, 1)).otherwise("")
    body = F.when(has, _strip(F.regexp_extract(content, shape, 2))).otherwise(content)
    line = r"^([\w.-]+):\s*(.*)$"
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(line))
    clean = _unquote if quotes else (lambda x: x)

    def entry(x: Column) -> Column:
        raw = _strip(F.regexp_extract(x, line, 2))
        is_list = raw.startswith("[") & raw.endswith("]") & (F.length(raw) >= 2)
        items = F.transform(F.split(raw.substr(F.lit(2), F.length(raw) - 2), ","), lambda i: clean(_strip(i)))
        value = F.struct(
            F.when(~is_list, clean(raw)).alias("text"),
            F.when(is_list, F.filter(items, lambda i: i != "")).alias("list"),
        )
        return F.struct(F.regexp_extract(x, line, 1).alias("key"), value.alias("value"))

    entries = F.transform(lines, entry)
    keys = F.transform(entries, lambda e: e["key"])
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
    return F.struct(F.when(content.isNotNull(), F.map_from_entries(last)).alias("values"), body.alias("body"))


def read_markdown(spark: SparkSession, root: str, quotes: bool = False, tolerant: bool = True) -> DataFrame:
    """``source_path, values, body`` of all markdown files."""
    return parse_markdown(read_files(spark, root, "*.md", tolerant), quotes)


def parse_markdown(files: DataFrame, quotes: bool = False) -> DataFrame:
    return files.select("source_path", front_matter(F.col("content"), quotes).alias("d")).select("source_path", "d.values", "d.body")


def read_manifests(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Entries ``source_path, n, entry variant`` of JSON files that hold an array, and rejects ``source_path, reason``."""
    return parse_manifests(read_files(spark, root, "*.json"))


def parse_manifests(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    files = files.withColumn("v", F.try_parse_json("content"))
    is_array = F.schema_of_variant("v").startswith("ARRAY")
    entries = files.filter(is_array).select("source_path", F.posexplode(F.col("v").cast("array<variant>")).alias("n", "entry"))
    reason = F.when(F.col("v").isNull(), "invalid JSON").when(~is_array, "manifest must be a top-level array")
    return entries, files.select("source_path", reason.alias("reason")).filter(F.col("reason").isNotNull())


def markdown_entries(docs: DataFrame) -> DataFrame:
    """``source_path, n, values map<string,string>`` of JSON values, as manifests have them; the body is the value ``body``."""
    values = F.transform_values("values", lambda k, v: F.when(v["list"].isNotNull(), F.to_json(v["list"])).otherwise(F.regexp_replace(F.to_json(F.array(v["text"])), r"(?s)^\[(.*)\]$", "$1")))
    body = F.create_map(F.lit("body"), F.regexp_replace(F.to_json(F.array("body")), r"(?s)^\[(.*)\]$", "$1"))
    rest = F.map_filter(values, lambda k, v: k != "body")
    return docs.select("source_path", F.lit(0).alias("n"), F.map_concat(rest, body).alias("values"))


def manifest_entries(entries: DataFrame) -> DataFrame:
    """As :func:`markdown_entries`; entries that are no object have null values."""
    is_object = F.schema_of_variant("entry").startswith("OBJECT")
    parts = F.when(is_object, F.col("entry")).cast("map<string,variant>")
    return entries.select("source_path", "n", F.transform_values(parts, lambda k, v: F.to_json(v)).alias("values"))


RULES = """source_path string, domain string, version string, created_at string, n int, id string, type string, summary string,
subdomain string, owner string, status string, risk_note string, source_ref string, has_applicability boolean, evento_valid boolean,
eventos array<string>, actors array<string>, action string, overrides string, formal_rule string,
conditions array<struct<field:string,op:string,value:string>>, has_related boolean, tables array<string>, sps array<string>"""

FILE_STATE = "source_path string, state string, message string, domain string, version string, created_at string, n_rules int"


def _load(text: str):
    import yaml

    return yaml.safe_load(text)


def _text(x) -> str | None:
    return None if x is None or x is False or x == "" else str(x)


def _texts(x) -> list[str]:
    return [str(i) for i in x if i is not None] if isinstance(x, list) else []


def _rule_row(path: str, meta: dict, n: int, rule) -> dict:
    import json

    rule = rule if isinstance(rule, dict) else {}
    inner = lambda key: rule.get(key) if isinstance(rule.get(key), dict) else {}
    formal, applies, objects = inner("formal_rule"), inner("applicability"), inner("related_objects")
    plain = {k: _text(rule.get(k)) for k in ("id", "type", "summary", "subdomain", "owner", "status", "risk_note", "source_ref")}
    evento = applies.get("evento")
    conditions = [c for c in formal.get("conditions") or [] if isinstance(c, dict)]
    return plain | {
        "source_path": path,
        "domain": _text(meta.get("domain")),
        "version": _text(meta.get("version")),
        "created_at": _text(meta.get("created_at")),
        "n": n,
        "has_applicability": bool(rule.get("applicability")),
        "evento_valid": isinstance(evento, list) and bool(evento),
        "eventos": _texts(evento),
        "actors": _texts(applies.get("actor")),
        "action": _text(formal.get("action")),
        "overrides": _text(formal.get("overrides")),
        "formal_rule": json.dumps(formal, ensure_ascii=False, default=str) if formal else None,
        "conditions": [{"field": _text(c.get("field")), "op": _text(c.get("op")), "value": json.dumps(c.get("value"), ensure_ascii=False, default=str)} for c in conditions],
        "has_related": isinstance(rule.get("related_objects"), dict),
        "tables": _texts(objects.get("tables")),
        "sps": _texts(objects.get("sps")),
    }


def _parsed(path: str, content: str) -> tuple[dict, list]:
    """State of a rule file and its rules."""
    try:
        doc = _load(content)
    except Exception as error:  # whatever the parser raises makes the file a reject
        return {"state": "unparsable", "message": str(error)[:500]}, []
    meta = doc.get("metadata") if isinstance(doc, dict) and isinstance(doc.get("metadata"), dict) else {}
    rules = doc.get("rules") if isinstance(doc, dict) else None
    if not isinstance(rules, list):
        return {"state": "no rules"}, []
    head = {k: _text(meta.get(k)) for k in ("domain", "version", "created_at")}
    return {"state": "ok", "n_rules": len(rules)} | head, [_rule_row(path, meta, i, r) for i, r in enumerate(rules)]


def _by_file(files: DataFrame, ddl: str, rows_of) -> DataFrame:
    """Rows made of each file in Python: ``rows_of(path, content)`` gives dictionaries with the columns of ``ddl``."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_pylist([r for path, text in files for r in rows_of(path, text)], schema)

    return files.select("source_path", "content").mapInArrow(parse, ddl)


def parse_rules(files: DataFrame) -> DataFrame:
    """One row per rule of YAML files: ``n`` is its place in the file. Files that can't be parsed give none.

    YAML is parsed in Python, as Spark has no reader for it; a row is a file.
    """
    return _by_file(files, RULES, lambda path, text: _parsed(path, text)[1])


def rule_files(files: DataFrame) -> DataFrame:
    """State of each YAML file: ``ok``, ``unparsable`` or ``no rules``, with its metadata."""
    return _by_file(files, FILE_STATE, lambda path, text: [{"source_path": path} | _parsed(path, text)[0]])


def read_yaml(spark: SparkSession, root: str) -> DataFrame:
    return read_files(spark, root, "*.{yaml,yml}")


def inline(spark: SparkSession, table: str, rows: list[dict]) -> DataFrame:
    """Rows given as dictionaries, in their order; missing columns are null."""
    from ..schema import ORDER, TABLES

    schema = TABLES[table]
    ordered = StructType([*schema.fields, StructField(ORDER, LongType())])
    return spark.createDataFrame([(*(r.get(c) for c in schema.names), n) for n, r in enumerate(rows)], ordered)
