"""Lookups, walks, mutations and integrity on a graph of three nodes."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph as G
from quillgraph.operators import integrity as X
from quillgraph.operators import lookup as L
from quillgraph.operators import mutations as M
from quillgraph.schema import empty
from quillgraph.sources.documents import inline


@pytest.fixture(scope="module")
def abc(spark):
    entities = inline(spark, "entities", [{"id": i, "type": "rule", "name": i.upper(), "metadata": "{}"} for i in "abc"]).cache()
    edges = inline(spark, "edges", [{"src": s, "dst": d, "relation": r, "metadata": "{}"} for s, r, d in (("a", "depends_on", "b"), ("b", "depends_on", "c"), ("a", "cites", "c"))]).cache()
    return entities, edges


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def walk(entities, edges, *args, **kwargs):
    out = G.traverse(entities, edges, *args, **kwargs).orderBy("depth", "place").collect()
    return [(r["id"], r["depth"], r["relation"]) for r in out]


def test_neighbours(abc):
    _, edges = abc
    assert ids(G.outgoing(edges, "a"), "dst") == ["b", "c"]
    assert ids(G.outgoing(edges, "a", "cites"), "dst") == ["c"]
    assert ids(G.incoming(edges, "c"), "src") == ["a", "b"]
    assert G.outgoing(edges, "a", "").count() == 0  # an empty relation filters
    assert sorted((r["direction"], r["src"], r["dst"]) for r in G.related(edges, "b").collect()) == [("incoming", "a", "b"), ("outgoing", "b", "c")]
    assert G.related(edges, "ghost").count() == 0


def test_self_loop_comes_twice(spark):
    loop = inline(spark, "edges", [{"src": "a", "dst": "a", "relation": "r"}])
    assert ids(G.related(loop, "a"), "direction") == ["incoming", "outgoing"]
    node = inline(spark, "entities", [{"id": "a"}])
    assert walk(node, loop, "a", max_depth=5) == [("a", 0, None)]


def test_traverse(spark, abc):
    entities, edges = abc
    assert walk(entities, edges, "a") == [("a", 0, None), ("c", 1, "cites"), ("b", 1, "depends_on")]
    assert walk(entities, edges, "a", "depends_on", 2) == [("a", 0, None), ("b", 1, "depends_on"), ("c", 2, "depends_on")]
    assert walk(entities, edges, "a", max_depth=0) == [("a", 0, None)]
    assert walk(entities, edges, "ghost") == []
    cycle = edges.unionByName(inline(spark, "edges", [{"src": "c", "dst": "a", "relation": "cites"}, {"src": "a", "dst": "ghost", "relation": "cites"}]))
    assert sorted(x[0] for x in walk(entities, cycle, "a", max_depth=10)) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        G.traverse(entities, edges, "a", max_depth=-1)


def test_lookups(spark):
    day = lambda n: dt.datetime(2025, 1, n)
    rows = [{"id": f"r{i}", "type": "rule", "name": "n", "body": "x" * (139 + i), "metadata": m, "updated_at": day(i)} for i, m in ((1, '{"domain": "d", "a": [1]}'), (2, '{"domain": ""}'), (3, "{"))]
    e = inline(spark, "entities", rows)
    assert [r["id"] for r in L.list_by_type(e, "rule", 2).collect()] == ["r3", "r2"]
    assert L.list_by_type(e, "rule", -1).count() == 3 and L.list_by_type(e, "rule", 0).count() == 0
    assert L.count_entities(e).first()["c"] == 3 and L.count_entities(e, "").first()["c"] == 0
    assert ids(L.json_distinct(e, "$.domain"), "value") == ["d"]
    assert ids(L.json_filter(e, "$.a[0]", "1")) == ["r1"]
    assert L.get_entity(e, "ghost").count() == 0
    terms = inline(spark, "terms", [{"term": "comité", "entity_id": "r1"}, {"term": "comité", "entity_id": "ghost"}])
    assert [(r["id"], r["snippet"][-1]) for r in L.by_term(e, terms, "COMITÉ").collect()] == [("r1", "x")]
    assert L.by_term(e, terms, "comite").count() == 0 and L.by_term(e, terms, "comité", "").count() == 1
    for bad in (None, 1.5, True, "3"):
        with pytest.raises(ValueError):
            L.list_by_type(e, "rule", bad)
    s = L.status(e, empty(spark, "edges"), terms).first()
    assert (s["total"], s["edges"], s["terms"], s["by_type"][0]["c"]) == (3, 0, 2, 3)
    none = L.status(empty(spark, "entities"), empty(spark, "edges"), empty(spark, "terms")).first()
    assert (none["total"], none["by_type"]) == (0, [])


def test_upserts(spark, abc):
    entities, edges = abc
    now = "2025-01-01 00:00:00"
    delta = inline(spark, "entities", [{"id": "a", "type": "x", "name": "1"}, {"id": "d", "type": "x", "name": "2"}, {"id": None, "type": "x", "name": "2"}])
    out = {r["id"]: r for r in M.upsert_entities(entities, delta, now).collect()}
    assert set(out) == {"a", "b", "c", "d"} and (out["a"]["type"], out["a"]["metadata"], out["a"]["body"]) == ("x", "{}", None)
    batch = spark.createDataFrame([("a", "1", 1), ("a", "3", 3), ("a", "2", 2)], "id string, name string, seq int")
    assert M.upsert_entities(entities, batch, now, "seq").filter("id = 'a'").first()["name"] == "3"
    new = inline(spark, "edges", [{"src": "a", "dst": "b", "relation": "depends_on", "metadata": '{"weight":2}'}])
    out = M.upsert_edges(edges, new)
    assert out.count() == 3 and G.outgoing(out, "a", "depends_on").first()["metadata"] == '{"weight":2}'
    assert ids(G.outgoing(M.delete_edges(edges, new), "a"), "dst") == ["c"]
    gone = spark.createDataFrame([("c",), ("c",), ("ghost",)], "id string")
    terms = inline(spark, "terms", [{"term": "t", "entity_id": "c"}, {"term": "t", "entity_id": "a"}])
    left = M.delete_entities(entities, edges, terms, gone)
    assert [df.count() for df in left] == [2, 1, 1]


def test_terms(spark):
    words = lambda *rows: spark.createDataFrame(list(rows), "entity_id string, terms array<string>")
    pairs = lambda df: sorted(tuple(r) for r in df.collect())
    terms = M.add_terms(empty(spark, "terms"), words(("a", ["X", "y", None, "x"]), ("b", ["Promoción"])))
    assert pairs(terms) == [("promoción", "b"), ("x", "a"), ("y", "a")]
    assert pairs(M.add_terms(terms, words(("a", ["X"])))) == pairs(terms)
    assert pairs(M.replace_terms(terms, words(("a", ["z"]), ("b", [])))) == [("promoción", "b"), ("z", "a")]
    assert pairs(M.replace_terms(terms, words(("a", ["z"]), ("b", [])), True)) == [("z", "a")]
    assert pairs(M.clear_terms(terms, spark.createDataFrame([("a",)], "id string"))) == [("promoción", "b")]


def test_integrity(spark, abc):
    entities, edges = abc
    more = edges.unionByName(inline(spark, "edges", [{"src": "a", "dst": "ghost", "relation": "r"}, {"src": "a", "dst": "ghost", "relation": "q"}]))
    terms = inline(spark, "terms", [{"term": "t", "entity_id": "lost"}])
    bad = {tuple(r) for r in X.fk_violations(entities, more, terms).collect()}
    assert bad == {("edges", "dst", "ghost", 2), ("terms", "entity_id", "lost", 1)}
    assert X.duplicate_keys(edges.unionAll(edges), ["src", "dst", "relation"]).count() == 3
    probe = X.endpoints_exist(entities, spark.createDataFrame([("a", "ghost")], "src string, dst string")).first()
    assert (probe["src_exists"], probe["dst_exists"]) == (True, False)
    live, dropped = X.split_orphans(more, entities.filter("id = 'b'"), entities.filter("id = 'c'"))
    assert live.count() == 3 and dropped.count() == 2
    refs = spark.createDataFrame([("a",), ("ghost",), ("ghost",)], "ref string")
    assert X.missing_refs(refs, entities).count() == 2
    assert entities.filter(F.col("id") == "a").count() == 1
