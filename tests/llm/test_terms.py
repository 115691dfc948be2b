"""Distinctiveness and frequency of terms, against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from quillgraph.llm import distinctive as D
from quillgraph.llm import frequency as Q
from quillgraph.operators.current import current_rows
from quillgraph.session import materialize, read_table

norm = lambda s: re.sub(r"\s+", " ", s).strip().lower()


def brute_scores(bodies: dict, pairs: set) -> dict:
    text = {k: norm(b or "") for k, b in bodies.items()}
    rows = {k: len(re.findall(r"\w+", t)) for k, t in text.items()}
    n = sum(rows.values())
    out = {}
    for record, term in pairs:
        if record not in text:
            continue
        c = lambda t: len(re.findall(rf"(?<!\w){re.escape(term)}(?!\w)", t))
        total, own = sum(map(c, text.values())), c(text[record])
        e = rows[record] * total / n if n else 0
        v = e * (1 - rows[record] / n) * (1 - total / n) if n else 0
        out[record, term] = (own, total, (own - e) / math.sqrt(v) if v > 0 else 0.0)
    return out


def run(spark, entities, terms, **options):
    e = spark.createDataFrame(entities, "id string, body string, updated_at timestamp_ntz, term string, n int")
    t = spark.createDataFrame(terms, "term string, entity_id string, id string, n int")
    return D.distinctive_terms(e, t, current_rows, materialize, **options)


@pytest.mark.parametrize("max_words", [8, 2])
def test_scores_against_brute_force(spark, max_words):
    rng = random.Random(5)
    words = ["Uno", "dos", "tres", "c++", "C", "foo-bar", "ñandú", "x_y", "aa", "++", ".net", "a"]
    bodies = {f"r{i}": "".join(rng.choice(words) + rng.choice([" ", "\xa0 ", ", ", "\n", "-", "."]) for _ in range(rng.randrange(60))) for i in range(25)}
    bodies |= {"empty": "", "null": None}
    listed = ["uno", " UNO ", "dos\ttres", "c++", "c", "foo-bar", "ñandú", "nandu", "aa aa", "++", ".net", "x_y", "uno dos tres", "uno dos", "a a a", "a a", "dos, tres c++", "junk " * 40, "  ", "", None]
    terms = [(t, rng.choice([*bodies, "ghost", "", None]), "z", 1) for t in listed for _ in range(6)] + [("uno", "empty", "z", 1), ("uno", "null", "z", 1)]
    found = run(spark, [(k, b, None, "q", 1) for k, b in bodies.items()], terms, max_words=max_words).collect()
    got = {(r["entity_id"], r["term"]): (r["n_in_body"], r["n_in_all"], r["n_records"], r["score"]) for r in found}
    pairs = {(r, norm(t)) for t, r, *_ in terms if t and norm(t) and r}
    df = Counter(t for _, t in pairs)
    want = brute_scores(bodies, pairs)
    assert set(got) == set(want)
    for k, (own, total, score) in want.items():
        assert got[k][:3] == (own, total, df[k[1]]), k
        assert abs(got[k][3] - score) < 1e-9, k


def test_signs_count_in_all_bodies(spark):
    bodies = {"a": "uno → dos → → tres", "b": "→ uno +++ dos", "c": "uno++ dos ++, → 🚚🚚 x→ →", "d": "uno dos", "e": "🚚 → \n→"}
    listed = {("a", "→"), ("d", "→"), ("a", "++"), ("b", "++"), ("d", "→ →"), ("c", "🚚"), ("a", "uno")}
    rows = run(spark, [(k, b, None, "q", 1) for k, b in bodies.items()], [(t, r, "z", 1) for r, t in listed]).collect()
    got = {(r["entity_id"], r["term"]): (r["n_in_body"], r["n_in_all"], r["score"]) for r in rows}
    want = brute_scores(bodies, listed)
    assert len(rows) == len(want) and set(got) == set(want)
    for k, (own, total, score) in want.items():
        assert got[k][:2] == (own, total) and abs(got[k][2] - score) < 1e-9, k


def test_empty_tables(spark):
    assert run(spark, [], []).count() == 0
    assert run(spark, [("a", "uno", None, "q", 1)], []).count() == 0
    assert run(spark, [], [("uno", "a", "z", 1)]).count() == 0


def test_found_at_a_larger_scale(spark, small):
    data = small.replace("sf0.001", "sf0.01")
    e, t = read_table(spark, data, "entities").toPandas(), read_table(spark, data, "terms").toPandas()
    cur = e.sort_values("updated_at").groupby("id").tail(1).set_index("id").body.to_dict()
    pairs = {(norm(a), b) for a, b in zip(t.term, t.entity_id) if isinstance(a, str) and isinstance(b, str) and b and norm(a)}
    df = Counter(a for a, _ in pairs)
    want = set()
    for a, b in pairs:
        if 2 <= df[a] <= 12 and isinstance(cur.get(b), str):
            rx = r"(?<!\w)" + r"\s+".join(map(re.escape, a.split(" "))) + r"(?!\w)"
            if len(re.findall(rx, cur[b], re.I)) >= 3:
                want.add((b, a))
    from quillgraph.llm.queries import p4_found

    assert {tuple(r) for r in p4_found(spark, data).collect()} == want and want


def frequencies(spark, rows, **options):
    df = spark.createDataFrame(rows, "term string, entity_id string, n int, n_rows int")
    return {r["term"]: (r["n_rows"], r["n_records"], r["mark"]) for r in Q.term_frequencies(df, **options).collect()}


def test_frequencies_against_brute_force(spark):
    rng = random.Random(2)
    rows = [("hot", f"e{rng.randrange(50)}", 1, 1) for _ in range(3000)] + [("Hot ", "e1", 1, 1)] * 2000
    rows += [(rng.choice(["a", "A", " a\xa0b ", "a  B", "", "  ", None, "ñ"]), rng.choice(["e1", "e2", "", None, " "]), 1, 1) for _ in range(500)]
    rows += [(f"t{i}", f"e{i % 60}", 1, 1) for i in range(300)]
    pairs = [(norm(t), r or None) for t, r, *_ in rows if t and norm(t)]
    total = len({r for _, r, *_ in rows if r})
    want = {}
    for term, n in Counter(t for t, _ in pairs).items():
        k = len({r for t, r in pairs if t == term and r})
        want[term] = (n, k, "common" if k > total * 0.2 else "rare" if k == 1 else None)
    assert frequencies(spark, rows) == want
    assert want["hot"] == (5000, 50, "common")


def test_frequencies_edge_cases(spark):
    assert frequencies(spark, []) == {}
    assert frequencies(spark, [("x", None, 1, 1), ("x", "", 1, 1)]) == {"x": (2, 0, None)}
    assert frequencies(spark, [("x", "a", 1, 1)] * 3 + [("y", f"e{i}", 1, 1) for i in range(9)]) == {"x": (3, 1, "rare"), "y": (9, 9, "common")}
