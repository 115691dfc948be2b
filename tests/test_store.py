"""Store, ingest, rule files, tools and command line, end to end on small corpora."""

from __future__ import annotations

import json
import types

import pytest

from quillgraph.cli import main
from quillgraph.commits import ConflictError
from quillgraph.facade import KnowledgeGraph
from quillgraph.ingest import PluginError, coerce_options, load_plugin, resolve_plugin, run_ingest
from quillgraph.operators.integrity import IntegrityError
from quillgraph.schema import conform, empty
from quillgraph.serve import VERSIONS, Session
from quillgraph.sources import documents as D
from quillgraph.sources import plugins as P
from quillgraph.store import GraphStore, migration_files
from quillgraph.validate import validate_rules_file


def write(root, files: dict):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text if isinstance(text, str) else json.dumps(text, ensure_ascii=False), encoding="utf-8")
    return str(root)


BASIC = {
    "rules/plazo.md": "---\nid: rule:plazo\ntype: rule\nname: Reglas de plazo\nterms: [plazo, Meses Largos, ]\nseverity: critical\nowner: finanzas\n---\n\nEl plazo lo fija el Comité.\n",
    "rules/promo.md": "---\nid: rule:promo\ntype: rule\nname: Promos\nterms: [promo]\ncites: [rule:plazo]\n---\nTexto de meses largos.\n",
    "calc.md": "---\nid: feature:calc\ntype: feature\nname: x\nname: Calculadora\nnot a line\nterms: [Plazo]\ndepends_on: [rule:plazo, rule:promo]\ncites: rule:plazo\n---\nCalcula plazos.\n",
    "none.md": "no front matter",
    "other.txt": "---\nid: x\n---\n",
}


@pytest.fixture
def store(spark, tmp_path):
    ticks = iter(range(10_000))
    return GraphStore(spark, f"file://{tmp_path}/store", clock=lambda: f"2025-01-01T00:{next(ticks) // 60 % 60:02d}:00.000Z")


def plugin(run, name="p"):
    return types.SimpleNamespace(name=name, run=run)


def test_markdown_ingest_end_to_end(spark, store, tmp_path):
    root, log = write(tmp_path / "docs", BASIC), []
    result = run_ingest(store, plugin(lambda ctx: P.markdown_plugin(ctx.spark, ctx.options["root"])), {"root": root}, log.append)
    assert (result.entities_before, result.entities_after, result.edges_after) == (0, 3, 3)
    assert any("missing id" in x for x in log)
    kg = KnowledgeGraph(store)
    got = kg.call("kb_get", id="rule:plazo")
    assert got["entity"]["metadata"] == {"severity": "critical", "owner": "finanzas"} and got["entity"]["body"] == "El plazo lo fija el Comité."
    assert kg.kb_get("feature:calc")["entity"]["name"] == "Calculadora"  # the last of equal keys
    assert {h["id"] for h in kg.call("kb_by_term", term="PLAZO")["hits"]} == {"rule:plazo", "feature:calc"}
    assert kg.kb_by_term("PLAZO")["term"] == "PLAZO"
    assert [h["id"] for h in kg.call("kb_find", query="comite OR comité")["hits"]] == ["rule:plazo"]
    assert kg.kb_find('"meses largos"')["hits"][0]["snippet"] == "Texto de <<meses largos>>."
    walk = kg.call("kb_traverse", id="feature:calc", relation="depends_on", maxDepth=2)
    assert [r["entity"]["id"] for r in walk["results"]] == ["feature:calc", "rule:plazo", "rule:promo"]
    related = kg.call("kb_related", id="rule:plazo")
    assert (related["outgoingCount"], related["incomingCount"]) == (0, 2)
    again = run_ingest(store, plugin(lambda ctx: P.markdown_plugin(ctx.spark, root)), {}, log.append)
    assert (again.entities_before, again.entities_after, again.edges_after) == (3, 3, 3)
    assert kg.status()["terms"] == 4 and kg.status()["entities"]["byType"][0] == {"type": "feature", "c": 1}


def test_unknown_target_leaves_the_store_as_it_was(spark, store, tmp_path):
    root = write(tmp_path / "docs", {"a.md": "---\nid: a\ncites: [ghost]\n---\nx\n"})
    store.migrate()
    before = store.read().version
    with pytest.raises(IntegrityError):
        run_ingest(store, plugin(lambda ctx: P.markdown_plugin(ctx.spark, root)))
    assert store.read().version == before and store.read().entities.count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        P.markdown_plugin(spark, str(tmp_path / "nowhere")).entities.count()


def test_manifest_ingest(spark, store, tmp_path):
    files = {
        "docs/r.md": "---\nid: 'rule:r'\ntype: \"rule\"\nempty:\nsupersedes: [rule:old]\nterms: ['a', \"b\"]\n---\nCuerpo\n",
        "docs/bad.md": "---\nid: x:y\ntype: nope\n---\n",
        "manifests/c.json": [{"id": "component:c", "type": "component", "body": "Cuerpo c", "implements": "rule:r", "depends_on": ["component:c", None, ""], "owner": "o", "props": {"k": [1, "é"]}, "terms": "solo"}, {"type": "module"}, 7],
        "manifests/d.json": {"id": "x"},
        "manifests/e.json": "{broken",
    }
    root = write(tmp_path / "kb", files)
    delta = P.manifest_plugin(spark, root)
    entities = {r["id"]: r for r in delta.entities.collect()}
    assert set(entities) == {"rule:r", "component:c"}
    assert json.loads(entities["component:c"]["metadata"]) == {"owner": "o", "props": {"k": [1, "é"]}}
    assert json.loads(entities["rule:r"]["metadata"]) == {"empty": ""} and entities["rule:r"]["name"] == "rule:r"
    assert {tuple(r)[:3] for r in delta.edges.collect()} == {("component:c", "rule:r", "implements"), ("component:c", "component:c", "depends_on")}
    assert [r["dst"] for r in delta.dropped.collect()] == ["rule:old"]
    assert sorted(r["reason"] for r in delta.rejects.collect()) == ["invalid JSON", 'invalid type "nope"', "manifest must be a top-level array", "missing id", "missing id"]
    run_ingest(store, plugin(lambda ctx: delta), log=lambda x: None)
    assert sorted(tuple(r) for r in store.read().terms.collect()) == [("a", "rule:r"), ("b", "rule:r"), ("solo", "component:c")]
    assert P.manifest_plugin(spark, str(tmp_path / "nowhere")).entities.count() == 0


RULES = """
metadata: {domain: pagos, version: 1.0.0, created_at: "2025-01-01"}
rules:
  - id: R-PAG-001
    type: rule
    subdomain: tarjetas
    summary: "Cobro duplicado, nunca (dos veces)"
    applicability: {evento: [cobro], actor: [cajero]}
    formal_rule: {conditions: [{field: monto, op: ">", value: 10}], action: rechazar}
    source_ref: Manual 4
    owner: finanzas
    status: active
    risk_note: alto
    related_objects: {tables: [Pagos, Pagos, Clientes], sps: [sp_cobro]}
  - id: E-PAG-001
    type: exception
    summary: Excepción
    applicability: {evento: []}
    formal_rule: {overrides: R-PAG-001}
    source_ref: x
    owner: y
    status: revision
    related_objects: {tables: [Pagos]}
  - {id: R-PAG-002, type: exception}
  - {type: rule, related_objects: {}}
"""


def test_yaml_ingest(spark, store, tmp_path):
    root = write(tmp_path / "r", {"seed-x-rules.yaml": RULES.replace("domain: pagos, ", ""), "bad.yml": "a: [", "none.yaml": "x: 1"})
    delta = P.yaml_plugin(spark, root)
    assert {r["reason"] for r in delta.rejects.collect()} == {"unparsable", "no rules"}
    run_ingest(store, plugin(lambda ctx: delta), log=lambda x: None)
    s = store.read()
    rule = s.entities.filter("id = 'rule:R-PAG-001'").first()
    assert rule["body"] == "Cobro duplicado, nunca (dos veces)\nRiesgo: alto\nAcción: rechazar\nmonto > 10\nFuente: Manual 4"
    meta = json.loads(rule["metadata"])
    assert (meta["domain"], meta["formalRule"]["conditions"][0]["field"], meta["actors"]) == ("x", "monto", ["cajero"])
    terms = {r["term"] for r in s.terms.filter("entity_id = 'rule:R-PAG-001'").collect()}
    assert terms == {"x", "tarjetas", "r-pag-001", "cobro", "pagos", "clientes", "sp_cobro", "duplicado", "nunca", "veces"}
    edges = {tuple(r)[:3] for r in s.edges.collect()}
    assert ("exception:E-PAG-001", "rule:R-PAG-001", "overrides") in edges and ("rule:R-PAG-001", "sp:sp_cobro", "uses_sp") in edges and len(edges) == 5
    assert s.entities.count() == 6


def codes(result):
    return [" ".join(e.split(": ", 1)[1].split()[:2]) for e in result.errors if ": " in e]


def test_validate(spark, store, tmp_path):
    path = write(tmp_path / "v", {"a.yaml": RULES, "bad.yaml": "a: [", "none.yaml": "x: 1", "meta.yaml": "rules: []"}) + "/"
    result = validate_rules_file(store, path + "a.yaml", known_domains=["otro"])
    assert not result.valid and result.stats == {"totalRules": 4, "domain": "pagos", "newObjectsRegistered": 0, "referencesRejected": 5}
    assert codes(result)[:4] == ["bad_status revision", "empty_evento applicability.evento", "missing_risk_note risk_note", "missing_field summary"]
    assert "prefix_type exception" in codes(result) and any(e.startswith("rules[3]: missing_field id") for e in result.errors)
    assert len(result.warnings) == 2  # an unknown domain, and a rule without related objects
    # under registration the objects of the first rule that names them count, repeats in that rule too
    result = validate_rules_file(store, path + "a.yaml", auto_register=True)
    assert result.stats["newObjectsRegistered"] == 4 and result.stats["referencesRejected"] == 0
    made = store.read().entities.filter("id = 'table:Pagos'").first()
    assert json.loads(made["metadata"]) == {"domain": "pagos", "status": "new"}
    assert {r["term"] for r in store.read().terms.filter("entity_id = 'sp:sp_cobro'").collect()} == {"sp_cobro", "pagos"}
    assert validate_rules_file(store, path + "a.yaml").stats["referencesRejected"] == 0
    for name, n in (("bad", 1), ("none", 1), ("meta", 3)):
        result = validate_rules_file(store, path + f"{name}.yaml")
        assert len(result.errors) == n and result.stats["totalRules"] == 0 and result.stats["domain"] == "unknown"
    asked = validate_rules_file(GraphStore(spark, f"file://{tmp_path}/other"), path + "a.yaml", decide=lambda ref: ref == "table:Pagos")
    assert asked.stats["newObjectsRegistered"] == 2 and asked.stats["referencesRejected"] == 2


def test_versions(spark, store):
    store.migrate()
    assert [m["id"] for m in store.migrate()] == ["0001"]
    one = D.inline(spark, "entities", [{"id": "a", "type": "t", "name": "uno"}, {"id": "b", "type": "t", "name": "dos"}])
    assert store.upsert_entities(one) == 2
    pinned = store.read()
    store.upsert_entities(D.inline(spark, "entities", [{"id": "a", "type": "t", "name": "tres"}]))
    assert pinned.entities.filter("id = 'a'").first()["name"] == "uno" and store.read().entities.filter("id = 'a'").first()["name"] == "tres"
    kg = KnowledgeGraph(store)
    assert kg.kb_find("uno")["count"] == 0 and kg.kb_find("tres")["count"] == 1 and kg.kb_find("dos")["count"] == 1
    edge = D.inline(spark, "edges", [{"src": "a", "dst": "b", "relation": "r"}])
    store.upsert_edges(edge)
    store.add_terms(spark.createDataFrame([("b", ["T"])], "entity_id string, terms array<string>"))
    with pytest.raises(IntegrityError):
        store.upsert_edges(D.inline(spark, "edges", [{"src": "a", "dst": "c", "relation": "ok"}, {"src": "a", "dst": "b", "relation": "ok"}]))
    assert store.read().edges.count() == 1
    with pytest.raises(IntegrityError):
        store.commit(entities=one.unionAll(one))
    assert store.delete_edges(edge) == 1 and store.delete_edges(edge) == 0
    store.upsert_edges(edge)
    assert store.delete_entities(spark.createDataFrame([("b",)], "id string")) == 1
    assert store.delete_entities(spark.createDataFrame([("b",)], "id string")) == 0
    s = store.read()
    assert (s.entities.count(), s.edges.count(), s.table("edges_by_dst").count(), s.terms.count()) == (1, 0, 0, 0) and kg.kb_find("dos")["count"] == 0
    assert [h["version"] for h in store.history()] == list(range(1, s.version + 1))
    with pytest.raises(RuntimeError):
        store._publish(s.manifest)
    with pytest.raises(KeyError):
        store.read(99)
    store.clear_terms(spark.createDataFrame([("a",)], "id string"))


def names(store):
    return {r["id"]: r["name"] for r in store.read().entities.collect()}


def test_two_writers_of_one_version(spark, store):
    """The second to end fails, and what the first wrote stays."""
    row = lambda id: D.inline(spark, "entities", [{"id": id, "type": "t", "name": id}])
    with pytest.raises(ConflictError):
        with store.transaction() as a:
            a.upsert_entities(row("a"))
            store.upsert_entities(row("b"))
    assert names(store) == {"b": "b"}
    base = store.read()
    store.upsert_entities(row("c"))
    with pytest.raises(ConflictError):
        store.commit(base=base, entities=row("d").drop("__order"))
    assert names(store) == {"b": "b", "c": "c"}


def test_a_transaction_is_one_version(spark, store):
    words = spark.createDataFrame([("a", ["x"])], "entity_id string, terms array<string>")
    edge = D.inline(spark, "edges", [{"src": "a", "dst": "b", "relation": "r"}])
    with store.transaction("both") as t:
        t.upsert_edges(edge)  # its ends are checked when the transaction ends
        t.upsert_entities(D.inline(spark, "entities", [{"id": "a", "type": "t", "name": "1"}, {"id": "b", "type": "t", "name": "2"}]))
        t.add_terms(words)
        t.upsert_entities(D.inline(spark, "entities", [{"id": "a", "type": "t", "name": "3"}]))
        assert {r["id"]: r["name"] for r in t.table("entities").collect()} == {"a": "3", "b": "2"}
    assert [h["note"] for h in store.history()] == ["both"]
    s = store.read()
    assert (names(store), s.edges.count(), s.table("edges_by_dst").count(), s.terms.count()) == ({"a": "3", "b": "2"}, 1, 1, 1)
    with pytest.raises(RuntimeError, match="boom"):
        with store.transaction() as t:
            t.delete_entities(spark.createDataFrame([("a",)], "id string"))
            raise RuntimeError("boom")
    with pytest.raises(IntegrityError):
        with store.transaction() as t:
            t.delete_entities(spark.createDataFrame([("b",)], "id string"))
            t.upsert_edges(edge)
    assert store.read().version == 1 and names(store) == {"a": "3", "b": "2"}


def test_the_last_of_a_batch_holds(spark, store, tmp_path):
    rows = [{"id": f"e{n % 3}", "type": "t", "name": str(n)} for n in range(300)]
    store.upsert_entities(D.inline(spark, "entities", rows).repartition(3))
    assert names(store) == {"e0": "297", "e1": "298", "e2": "299"}
    plain = spark.createDataFrame([(r["id"], "t", r["name"]) for r in rows[:10]], "id string, type string, name string")
    store.upsert_entities(plain)
    assert names(store) == {"e0": "9", "e1": "7", "e2": "8"}
    edges = [{"src": "e0", "dst": "e1", "relation": "r", "metadata": json.dumps({"n": n})} for n in range(20)]
    store.upsert_edges(D.inline(spark, "edges", edges))
    assert store.read().edges.first()["metadata"] == '{"n": 19}'
    text = "---\nid: x\ntype: rule\nname: {0}\nterms: [{1}]\n---\n{0}\n"
    files = {"docs/b.md": text.format("b", ""), "docs/b/a.md": text.format("b/a", "t1"), "docs/a.md": text.format("a", "t0")}
    files["manifests/m.json"] = [{"id": "y", "type": "rule", "name": "1"}, {"id": "y", "type": "rule", "name": "2", "terms": ["k"]}, {"id": "y", "type": "rule", "name": "3"}]
    root = write(tmp_path / "kb", files)
    run_ingest(store, plugin(lambda ctx: P.manifest_plugin(ctx.spark, root)), log=lambda x: None)
    got = names(store)
    assert (got["x"], got["y"]) == ("b", "3")  # a folder comes before a file that begins like it
    assert {tuple(r) for r in store.read().terms.collect()} == {("t1", "x"), ("k", "y")}  # the last that has terms


def test_a_small_write_rewrites_its_part_only(spark, store):
    rows = [{"id": f"e{n}", "type": "t", "name": str(n)} for n in range(100)]
    store.upsert_entities(D.inline(spark, "entities", rows))
    before = store.read().manifest["tables"]
    store.upsert_entities(D.inline(spark, "entities", [{"id": "e7", "type": "t", "name": "siete"}]))
    after = store.read().manifest["tables"]
    assert len(before["entities"]) == store.parts
    for table in ("entities", "postings", "size"):
        assert sum(after[table][p] != before[table][p] for p in before[table]) == 1
    kg = KnowledgeGraph(store)
    assert kg.kb_find("siete")["count"] == 1 and kg.kb_find("7")["count"] == 0 and kg.kb_find("8")["count"] == 1
    assert store.read().size.first() == (100, 100)
    assert store.vacuum() > 0 and names(store)["e7"] == "siete" and kg.kb_find("99")["count"] == 1
    assert store.vacuum() == 0


def test_migrations_of_a_folder(spark, store, tmp_path):
    store.migrate()
    store.upsert_entities(D.inline(spark, "entities", [{"id": "a", "type": "old", "name": "uno"}]))
    folder = write(tmp_path / "m", {
        "0002_types.sql": "REPLACE entities AS SELECT id, 'new' AS type, name, body, metadata, source_path, updated_at FROM {entities};\nREPLACE terms AS SELECT 'k' AS term, id AS entity_id FROM {entities};\n",
        "0003_bad.sql": "REPLACE terms AS SELECT 'k' AS term, 'ghost' AS entity_id;",
        "sub/0004_x.sql": "", "note.txt": "x", "0005.sql": "x",
    })
    with pytest.raises(IntegrityError):
        store.migrate(folder)
    assert [m["filename"] for m in store.migrations()] == ["0001_init.sql", "0002_types.sql"]
    assert store.read().entities.first()["type"] == "new" and [tuple(r) for r in store.read().terms.collect()] == [("k", "a")]
    (tmp_path / "m" / "0003_bad.sql").write_text("DROP TABLE terms;")
    with pytest.raises(ValueError):
        store.migrate(folder)
    (tmp_path / "m" / "0003_bad.sql").write_text("")
    assert [m["id"] for m in store.migrate(folder)] == ["0001", "0002", "0003"]


def test_validation_reads_the_named_file_only(spark, store, tmp_path):
    path = write(tmp_path / "v", {"a.yaml": "metadata: {domain: d, version: 1, created_at: x}\nrules: []\n", "sub/a.yaml": RULES, "a[1].yaml": RULES})
    assert validate_rules_file(store, f"{path}/a.yaml").valid
    assert validate_rules_file(store, f"{path}/a[1].yaml").stats["totalRules"] == 4
    with pytest.raises(FileNotFoundError):
        validate_rules_file(store, f"{path}/none.yaml")


def test_counters_of_a_batch(spark, store, tmp_path):
    root = write(tmp_path / "docs", BASIC)
    delta, log = P.markdown_plugin(spark, root), []
    run_ingest(store, plugin(lambda ctx: delta), log=log.append)
    assert delta.counters == {"entities": 3, "edges": 3, "term_sets": 3, "rejected": 1, "dropped": 0}
    assert log[0] == "loaded 3 entities, 3 edges, 3 term sets" and log[1] == "rejected: 1"


def test_migration_files():
    assert migration_files(["0002_b.sql", "0001_a.sql", "x.sql", "1_a.sql", "0003.sql"]) == [("0001", "0001_a.sql"), ("0002", "0002_b.sql")]


def test_tools(spark, store):
    kg = KnowledgeGraph(store)
    assert kg.tools() == ["kb_find", "kb_get", "kb_by_term", "kb_traverse", "kb_related"]
    assert kg.call("kb_add_entity", id="a", type="t", name="n")["isError"]
    store.migrate()
    kg = KnowledgeGraph(store, allow_writes=True)
    assert kg.call("kb_add_entity", id="a", type="t", name="n", metadata={"k": [1]}) == {"upserted": True, "id": "a"}
    missing = kg.call("kb_add_edge", src="a", dst="ghost", relation="r")
    assert missing["isError"] and (missing["srcExists"], missing["dstExists"]) == (True, False)
    assert kg.call("kb_add_edge", src="a", dst="a", relation="r")["upserted"]
    assert kg.kb_get("a")["entity"]["metadata"] == {"k": [1]} and kg.kb_get("a")["entity"]["updatedAt"].endswith("Z")
    assert kg.call("kb_get", id="ghost") == {"found": False, "id": "ghost"}
    assert kg.call("kb_traverse", id="ghost") == {"found": False, "id": "ghost"}
    for bad in (("kb_find", {"query": ""}), ("kb_get", {"id": ""}), ("kb_find", {"query": "a", "limit": 101}), ("kb_by_term", {"term": "a", "limit": 0}), ("kb_traverse", {"id": "a", "max_depth": 11}), ("kb_find", {"query": "(a"}), ("kb_get", {})):
        assert kg.call(bad[0], **bad[1])["isError"]


PLUGIN = "from quillgraph.sources.plugins import markdown_plugin\nclass P:\n    name = 'docs'\n    def run(self, ctx):\n        return markdown_plugin(ctx.spark, ctx.options['root'])\n"


def test_plugins(tmp_path):
    module = lambda **x: types.SimpleNamespace(**x)
    good = plugin(lambda ctx: None)
    assert resolve_plugin(module(PLUGIN=good)) is good and resolve_plugin(module(make_plugin=lambda: good)) is good
    for bad in (None, module(), module(PLUGIN=5), module(make_plugin=lambda: 5), module(PLUGIN=module(name="x"))):
        with pytest.raises(PluginError):
            resolve_plugin(bad)
    with pytest.raises(FileNotFoundError):
        load_plugin(str(tmp_path / "none.py"))
    assert coerce_options(["a", "b=true", "c=-3", "d=x=y", "e=3.5", "f=false"]) == {"a": True, "b": True, "c": -3, "d": "x=y", "e": "3.5", "f": False}


def test_failing_plugin(spark, store):
    def fail(ctx):
        raise RuntimeError("boom")

    with pytest.raises(RuntimeError, match="boom"):
        run_ingest(store, plugin(fail))
    assert run_ingest(store, plugin(lambda ctx: None)).entities_after == 0


def test_command_line(spark, tmp_path, capsys):
    root = write(tmp_path / "docs", BASIC)
    write(tmp_path, {"p.py": PLUGIN + "make_plugin = P\n", "rules.yaml": RULES})
    db = f"file://{tmp_path}/db"
    run = lambda *args: (main(list(args), spark), capsys.readouterr().out)
    assert "1 migration" in run("init", "--db", db)[1]
    assert json.loads(run("ingest", "--db", db, "--plugin", f"{tmp_path}/p.py", "--opt", f"root={root}")[1])["entitiesAfter"] == 3
    assert json.loads(run("status", "--db", db)[1])["entities"]["total"] == 3
    assert json.loads(run("query", "find", "meses", "largos", "--db", db)[1])["count"] == 1
    assert json.loads(run("query", "find", "plazo", "--limit", "-1", "--db", db)[1])["count"] == 1
    assert json.loads(run("query", "term", "Plazo", "--db", db)[1])["count"] == 2
    assert json.loads(run("query", "get", "rule:promo", "--db", db)[1])["found"]
    assert set(json.loads(run("query", "related", "rule:promo", "--db", db)[1])) == {"id", "outgoing", "incoming"}
    assert run("validate", "--db", db, "--file", f"{tmp_path}/rules.yaml", "--auto-register")[0] == 1
    with pytest.raises(ValueError):
        run("query", "find", "x", "--limit", "x", "--db", db)


def test_sessions_answer_by_the_protocol(spark, store):
    store.migrate()
    session = Session(KnowledgeGraph(store, allow_writes=True))
    ask = lambda method, id=1, **params: session.answer({"jsonrpc": "2.0", "id": id, "method": method, "params": params})
    assert ask("initialize", protocolVersion="1999-01-01")["result"]["protocolVersion"] == VERSIONS[0]
    tools = {t["name"]: t["inputSchema"] for t in ask("tools/list")["result"]["tools"]}
    assert list(tools) == session.kg.tools() and tools["kb_find"]["required"] == ["query"]
    assert tools["kb_traverse"]["properties"]["maxDepth"] == {"type": "integer", "minimum": 0, "maximum": 10}
    assert tools["kb_add_entity"]["properties"]["metadata"] == {"type": "object"} and "sourcePath" in tools["kb_add_entity"]["properties"]
    added = ask("tools/call", name="kb_add_entity", arguments={"id": "a", "type": "t", "name": "n"})["result"]
    assert json.loads(added["content"][0]["text"]) == {"upserted": True, "id": "a"} and not added["isError"]
    missing = ask("tools/call", name="kb_add_edge", arguments={"src": "a", "dst": "b", "relation": "r"})["result"]
    assert missing["isError"] and json.loads(missing["content"][0]["text"])["dstExists"] is False
    for name, arguments in (("kb_drop", {}), ("kb_get", {}), ("kb_get", {"id": ""}), ("kb_find", {"query": "a", "limit": 0})):
        assert ask("tools/call", name=name, arguments=arguments)["result"]["isError"]
    for bad in (None, 5, {}, [], {"jsonrpc": "2.0"}, {"jsonrpc": "1.0", "method": "ping"}):
        assert session.answer(bad)["error"]["code"] == -32600
    assert session.answer({"jsonrpc": "2.0", "method": "ping"}) is None
    both = session.answer([{"jsonrpc": "2.0", "id": 1, "method": "ping"}, {"jsonrpc": "2.0", "method": "x"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/call", "params": []}])
    assert [a["id"] for a in both] == [1, 2] and both[1]["error"]["code"] == -32602


def test_front_matter(spark):
    texts = [None, "", "---\nid: a\r\nk: [x, , 'y']\nid: b\nbad line\nq: \"z\"\n---\n\n body \n", "---\nno end", "---\n\n---\nx"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(D.front_matter(df.t).alias("m"), D.front_matter(df.t, True).alias("q")).collect()
    assert (rows[0]["m"]["values"], rows[0]["m"]["body"], rows[1]["m"]["body"]) == (None, None, "")
    assert rows[2]["m"]["values"] == {"id": ("b", None), "k": (None, ["x", "'y'"]), "q": ('"z"', None)} and rows[2]["m"]["body"] == "body"
    assert rows[2]["q"]["values"]["k"]["list"] == ["x", "y"] and rows[2]["q"]["values"]["q"]["text"] == "z"
    assert rows[3]["m"]["body"] == "---\nno end" and rows[3]["m"]["values"] == {} and rows[4]["m"]["body"] == "x"


def test_conform_drops_clashing_columns(spark):
    odd = spark.createDataFrame([("a", 1, "x")], "id string, type int, edges string")
    row = conform(odd, "entities").first()
    assert row["type"] == "1" and row["body"] is None and len(row) == 7
    assert empty(spark, "edges").columns == ["src", "dst", "relation", "metadata"]
