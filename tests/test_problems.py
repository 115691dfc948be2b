"""Orphans, incremental runs and hierarchies: edge cases of each."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.commits import ConflictError
from quillgraph.operators import hierarchy as H
from quillgraph.operators import incremental as I
from quillgraph.operators import references as R
from quillgraph.operators.current import current_rows

T = lambda day, hour=0: dt.datetime(2025, 1, day, hour)
NTZ = "timestamp_ntz"
SCHEMAS = {
    "entities": f"id string, landed_at {NTZ}, extra int",
    "components": f"id string, depends_on array<string>, landed_at {NTZ}",
    "modules": "id string, landed_at string",
    "edges": f"src string, dst string, id string, landed_at {NTZ}",
    "terms": f"term string, entity_id string, landed_at {NTZ}",
    "deletions": f"entity_id string, deleted_at {NTZ}",
}


def frames(spark, **rows):
    return {n: spark.createDataFrame(rows.get(n, []), s) for n, s in SCHEMAS.items()}


def orphans(spark, **rows):
    out = R.find_orphans(**frames(spark, **rows)).collect()
    return {(r["ref_table"], r["ref_field"], r["target_id"], r["period"], r["reason"]) for r in out}


def test_orphans(spark):
    found = orphans(
        spark,
        entities=[("a", T(1), 0), ("b", T(10), 0), ("c", T(1), 0), ("c", T(9), 0), (None, T(1), 0), ("d", None, 0)],
        components=[("k", ["a", "ghost", None, "", "ghost", "m"], T(2)), ("l", None, T(2))],
        modules=[("m", "x")],
        edges=[("a", "b", "x", T(5)), ("a", "b", "x", T(11)), ("c", "gone", "x", None), ("d", "a", "x", T(3))],
        terms=[("t", "c", T(3)), ("t", None, T(3)), ("t", "", T(3))],
        deletions=[("c", T(5)), ("a", T(1)), ("a", T(1)), ("gone", T(3))],
    )
    assert found == {
        ("components", "depends_on", "ghost", "2025-01", "missing"),
        ("components", "depends_on", "a", "2025-01", "deleted"),
        ("edges", "dst", "b", "2025-01", "late"),
        ("edges", "src", "a", "2025-01", "deleted"),
        ("edges", "dst", "a", "2025-01", "deleted"),
        ("edges", "dst", "gone", None, "missing"),
    }


def test_orphans_of_empty_tables(spark):
    assert orphans(spark) == set()


def test_deltas_that_take_back(spark):
    """A reference or a record that is taken back leaves the state; folding in steps equals folding at once."""
    f = frames(spark, edges=[("a", "b", "x", T(5)), ("a", "c", "x", T(5))], entities=[("a", T(1), 0), ("c", T(1), 0)])
    refs = R.fold(R.reference_deltas(f["edges"], f["components"], f["terms"]), R.REF_KEYS)
    known = R.fold(R.existence_deltas(f["entities"], f["components"], f["modules"], f["deletions"]), R.EXIST_KEYS)
    assert [r["target_id"] for r in R.orphan_report(refs, known).collect()] == ["b"]
    back = R.reference_deltas(f["edges"].filter("dst = 'b'"), f["components"], f["terms"], -1)
    gone = R.existence_deltas(f["entities"].filter("id = 'c'"), f["components"], f["modules"], f["deletions"], -1)
    refs, known = R.fold(back, R.REF_KEYS, refs), R.fold(gone, R.EXIST_KEYS, known)
    assert [(r["target_id"], r["reason"]) for r in R.orphan_report(refs, known).collect()] == [("c", "missing")]
    assert refs.filter("target_id = 'b'").count() == 0


ENTITY = f"id string, type string, name string, body string, metadata string, source_path string, updated_at {NTZ}, landed_at {NTZ}, run_id int"
RUN = f"run_id bigint, source_root string, started_at {NTZ}, finished_at {NTZ}, status string"


def entity(id, body, updated, landed, path="docs/x.md"):
    return (id, "t", "n", body, "{}", path, updated, landed, 0)


def test_runs_of_a_log(spark, tmp_path):
    rows = [
        entity("a", "1", T(1), T(1)),
        entity("a", "1", T(2), T(3)),  # written again, alike
        entity("a", "2", T(3), T(5)),
        entity("a", "0", T(1), T(7)),  # late and old
        entity("b", "1", None, T(2), "./docs\\y.md"),
        entity("b", None, T(1), T(6), "/docs/y.md"),
        entity("c", "1", T(1), T(1), None),
        entity("c", "1", T(1), T(1), None),
        entity("d", "1", T(1), T(20)),  # after the last run
        entity("e", "1", T(1), None),
        entity(None, "1", T(1), T(1)),
    ]
    runs = [
        (1, "docs", T(2), T(2, 1), "ok"),
        (2, "docs", T(4), T(4, 1), "failed"),
        (3, "docs", T(6), T(6, 1), "ok"),
        (4, "docs", T(8), None, "ok"),
        (5, "docs", T(9), T(9, 1), "ok"),
        (6, "none", T(9), T(9, 1), "ok"),
    ]
    out = run_log(spark, tmp_path, rows, runs)
    assert out == {
        (1, "a", "new"),
        (1, "b", "new"),
        (3, "a", "changed"),
        (3, "b", "changed"),
        (6, "c", "new"),
    }


def run_log(spark, tmp_path, rows, runs, name="runs", **options):
    runner = I.IncrementalRunner(spark, f"file://{tmp_path}/{name}", **options)
    out = runner.run_log(spark.createDataFrame(rows, ENTITY), spark.createDataFrame(runs, RUN)).collect()
    found = {(r["run_id"], r["id"], r["change"]) for r in out}
    assert len(found) == len(out)
    return found


def test_null_and_empty_paths_are_alike(spark, tmp_path):
    """Both are root none with the same normal path, as TESTDATA says; so is a path of slashes only."""
    rows = [entity("a", "1", T(day), T(day), path) for day, path in ((1, None), (3, ""), (5, "./"), (7, "\\"))]
    rows += [entity("b", "1", T(1), T(1), ""), entity("b", "2", T(3), T(3), None)]
    runs = [(day, "none", T(day), T(day), "ok") for day in (2, 4, 6, 8)]
    assert run_log(spark, tmp_path, rows, runs) == {(2, "a", "new"), (2, "b", "new"), (4, "b", "changed")}


def test_runs_of_empty_tables(spark, tmp_path):
    assert run_log(spark, tmp_path, [], []) == set()
    assert run_log(spark, tmp_path, [], [(1, "docs", T(2), T(3), "ok")]) == set()
    assert run_log(spark, tmp_path, [entity("a", "1", T(1), T(1))], [(1, "docs", T(2), T(3), "failed")]) == set()


def test_runs_in_steps_equal_runs_at_once(spark, tmp_path):
    """However the log is cut, with state kept between the steps, each case comes out once."""
    rng = random.Random(6)
    hour = lambda n: T(1) + dt.timedelta(hours=n)
    paths = ["docs/a", "./docs/b", "rules\\c", None, ""]
    rows = [entity(f"e{rng.randrange(9)}", str(rng.randrange(2)), hour(rng.randrange(99)), hour(rng.randrange(99)), rng.choice(paths)) for _ in range(200)]
    # Rows that tie are copies.
    rows = list({(r[0], r[6]): r for r in rows}.values())
    runs = [(n, rng.choice(["docs", "rules", "none"]), hour(4 * n), hour(4 * n), rng.choice(["ok", "ok", "failed"])) for n in range(25)]
    whole = run_log(spark, tmp_path, rows, runs, "whole")
    steps = [run_log(spark, tmp_path, [r for r in rows if r[7] <= runs[n - 1][2]], runs[:n], "steps", parts=3) for n in (7, 8, 15, 25)]
    assert set.union(*steps) == whole and sum(map(len, steps)) == len(whole)


def test_runner_commits_once(spark, tmp_path):
    rows = [entity("a", "1", T(1), T(1)), entity("a", "2", T(2), T(5)), entity("b", "1", T(1), T(5))]
    df = spark.createDataFrame(rows, ENTITY)
    runner = I.IncrementalRunner(spark, f"file://{tmp_path}")
    take = lambda n, upper: sorted((r["id"], r["change"]) for r in runner.run(df, "docs", n, upper).collect())
    assert take(1, T(2)) == [("a", "new")]
    append = runner.log.append
    runner.log.append = lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        runner.run(df, "docs", 2, T(6))
    runner.log.append = append
    assert take(3, T(6)) == [("a", "changed"), ("b", "new")]  # neither skipped nor repeated
    assert take(4, T(7)) == []
    assert take(2, T(6)) == []  # an earlier run is done
    with pytest.raises(ConflictError):
        runner.log.append(1, {})
    assert runner.log.numbers() == [1, 2, 3]


def walk(parents: dict[str, str]) -> set:
    """Brute force: follow the parents of each node."""
    out = set()
    for node in set(parents) | set(parents.values()):
        seen = [node]
        while seen[-1] in parents and parents[seen[-1]] not in seen:
            seen.append(parents[seen[-1]])
        if seen[-1] in parents:
            out.add((node, min(seen[seen.index(parents[seen[-1]]) :]), -1))
        else:
            out.add((node, seen[-1], len(seen) - 1))
    return out


def tree(spark, parents: dict[str, str], **options):
    rows = [(p, c, "Contains") if i % 2 else (c, p, "PART_OF") for i, (c, p) in enumerate(parents.items())]
    return H.hierarchy(spark.createDataFrame(rows, "src string, dst string, relation string"), **options)


def found(df) -> set:
    return {(r["node_id"], r["root_id"], r["depth"]) for r in df.collect()}


def test_hierarchy_against_brute_force(spark):
    rng = random.Random(3)
    parents = {f"n{i}": f"n{rng.randrange(max(0, i - 3), i)}" for i in range(1, 150)}  # deep
    parents |= {"x": "y", "y": "z", "z": "x", "t1": "x", "t2": "t1", "t3": "t2", "self": "self", "q": "self"}
    parents |= {f"c{i}": f"c{(i + 1) % 7}" for i in range(7)}
    assert found(tree(spark, parents)) == walk(parents)


def test_a_deep_chain_takes_few_jobs_and_a_plan_of_one_scan(spark):
    n = 20_000
    edges = spark.range(1, n).select(F.format_string("n%05d", F.col("id") - 1).alias("src"), F.format_string("n%05d", "id").alias("dst"), F.lit("contains").alias("relation"))
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup())
    out = H.hierarchy(edges)
    assert len(set(tracker.getJobIdsForGroup()) - before) < 150
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert out.agg(F.count("*"), F.max("depth"), F.sum("depth"), F.min("root_id"), F.max("root_id")).first() == (n, n - 1, n * (n - 1) // 2, "n00000", "n00000")


def test_hierarchy_edge_cases(spark):
    schema = "src string, dst string, relation string, depth int, node_id string"
    rows = [("a", "b", "contains", 1, "x"), ("a", "b", "contains", 1, "x"), ("a", "b", "part_of", 1, "x"), ("c", "d", "cites", 1, "x")]
    rows += [(None, "b", "contains", 1, "x"), ("a", None, "contains", 1, "x"), ("z", "e", None, 1, "x")]
    out = H.hierarchy(spark.createDataFrame(rows, schema), with_paths=True).collect()
    assert {(r["node_id"], r["depth"], tuple(r["path"] or ())) for r in out} == {("a", -1, ()), ("b", -1, ())}
    assert H.hierarchy(spark.createDataFrame([], schema)).count() == 0
    two = spark.createDataFrame([("b", "x", "contains"), ("a", "x", "contains")], "src string, dst string, relation string")
    assert found(H.hierarchy(two)) == {("a", "a", 0), ("x", "a", 1), ("b", "b", 0)}


def test_descendants(spark):
    parents = {"b": "a", "c": "b", "d": "b"}
    out = H.descendants(tree(spark, parents, with_paths=True)).collect()
    assert {tuple(r) for r in out} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)}


def test_all_descendants_on_and_below_cycles(spark):
    rng = random.Random(4)
    parents = {f"n{i}": f"n{rng.randrange(max(0, i - 2), i)}" for i in range(1, 40)}
    parents |= {"x": "y", "y": "z", "z": "x", "t1": "x", "t2": "t1", "t3": "t2", "u": "z", "self": "self", "q": "self"}
    parents |= {f"c{i}": f"c{(i + 1) % 7}" for i in range(7)}
    want = set()
    for node in parents:
        seen = [node]
        while seen[-1] in parents and parents[seen[-1]] not in seen:
            seen.append(parents[seen[-1]])
            want.add((seen[-1], node, len(seen) - 1))
    rows = [(p, c, "contains") for c, p in parents.items()]
    edges = spark.createDataFrame(rows, "src string, dst string, relation string")
    out = [tuple(r) for r in H.all_descendants(edges).collect()]
    assert set(out) == want and len(out) == len(want)
    assert {("t1", "t3", 2), ("y", "t3", 4), ("z", "x", 2), ("self", "q", 1)} <= want
    assert H.all_descendants(edges.limit(0)).count() == 0


def test_current_rows(spark):
    rows = [("a", "1", T(1)), ("a", "2", T(2)), ("a", "2", T(2)), ("b", None, None), (None, "x", T(1)), ("c", "1", None), ("c", "2", T(1))]
    out = current_rows(spark.createDataFrame(rows, f"id string, body string, updated_at {NTZ}"), "body")
    assert {tuple(r) for r in out.collect()} == {("a", "2"), ("b", None), ("c", "2")}


def test_reference_stream(spark, tmp_path):
    from quillgraph.streaming.reference_stream import ReferenceState, start

    schema = f"side string, ref_table string, ref_field string, target_id string, id string, kind string, at {NTZ}, delta bigint"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    state = ReferenceState(spark, f"file://{tmp_path}/state")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        start(stream, state, f"{tmp_path}/check").awaitTermination()
        return {(r["target_id"], r["reason"], r["n_refs"]) for r in state.report().collect()}

    batch(("reference", "edges", "dst", "a", None, None, T(1), 1), ("reference", "edges", "dst", "b", None, None, T(1), 1))
    assert run() == {("a", "missing", 1), ("b", "missing", 1)}
    batch(("existence", None, None, None, "a", "landed", T(3), 1), ("reference", "edges", "dst", "b", None, None, T(1), -1))
    assert run() == {("a", "late", 1)}
    empty = spark.createDataFrame([], "ref_table string, ref_field string, target_id string, at timestamp_ntz, delta bigint")
    state.apply(empty, empty.select(F.col("target_id").alias("id"), F.col("ref_table").alias("kind"), "at", "delta"), 0)  # done before
    assert state.report().count() == 1
