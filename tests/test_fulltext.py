"""Full-text search against SQLite's FTS5, when it is there, and a fixed table of ranks."""

from __future__ import annotations

import random
import sqlite3

import pytest

from quillgraph.functions.snippet import snippet
from quillgraph.plans import fts_plan as P
from quillgraph.plans.fts_query import QuerySyntaxError, parse, tokenize

SCHEMA = "id string, type string, name string, body string"
ROWS = ["aa bb", "aa cc", "bb", "cc", "dd ee", "ee ff gg", "hh", "ii", "jj", "aa", "kk aa bb cc", "mm", "nn"]
GOLDEN = {
    "aa": {1: -0.70481, 2: -0.70481, 10: -0.82680, 11: -0.54422},
    "aa NOT bb cc": {1: -0.70481, 2: -0.70481, 10: -0.82680},
    "(aa AND bb) OR cc": {1: -1.74108, 2: -1.03627, 4: -1.21562, 11: -2.14454},
    "aa OR bb NOT cc": {1: -1.74108, 2: -0.70481, 3: -1.21562, 10: -0.82680, 11: -0.54422},
    "aa aa": {1: -1.40963, 2: -1.40963, 10: -1.65360, 11: -1.08844},
    "NEAR(aa cc, 0)": {2: -1.74108},
    '"kk a" *': {11: -1.54426},
    "^aa": {1: -1.03627, 2: -1.03627, 10: -1.21562},
    "name : n1": {1: -1.99995},
    "and": {},
}
QUERIES = [
    *GOLDEN, "aa NOT (bb AND cc)", "aa bb OR cc", "aa OR aa", "NEAR(aa cc)", "NEAR(aa cc, 1)", "a*", '"kk aa" + bb', "body:^aa", "aa*bb", '"AND"', "aa and bb",
    "{name body}: aa", "- name : aa", "-body:n1", '"" aa', '""', 'aa NOT ""', "body:(aa OR n1)", 'NEAR("aa bb" cc, 3)', "NEAR(kk bb cc, 2)", "aa NEAR bb", "NEAR", "aa OR (bb NOT cc)", "^aa OR ^bb", "aa bb*",
]
ERRORS = ["aa'", "aa:bb", "aa-bb", "aa.bb", "aa, bb", "(aa", "aa)", "*", "''", "aa (bb)", "aa AND", "foo:aa", "AND", "", "what?", "NEAR(aa, x)", "{name", '"aa']


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame([(f"{i:03d}", "t", f"n{i}", b) for i, b in enumerate(ROWS, 1)], SCHEMA).cache()


@pytest.fixture(scope="module")
def index(golden):
    return P.build_postings(golden).cache(), P.corpus_size(golden)


def fts(rows):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE f USING fts5(name, body, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    db.executemany("INSERT INTO f(rowid, name, body) VALUES (?, ?, ?)", [(int(i), n, b) for i, _, n, b in rows])
    return lambda q: [
        (f"{r[0]:03d}", round(r[1], 6), r[2])
        for r in db.execute("SELECT rowid, rank, snippet(f, 1, '<<', '>>', '…', 16) FROM f WHERE f MATCH ? ORDER BY rank, rowid", (q,))
    ]


def found(df):
    return sorted(((r["id"], round(r["rank"], 6), r["snippet"]) for r in df.collect()), key=lambda x: (x[1], x[0]))


@pytest.mark.parametrize("query", list(GOLDEN))
def test_fixed_ranks(golden, query):
    got = {int(r["id"]): round(r["rank"], 5) for r in P.search(golden, query, limit=-1).collect()}
    assert got == pytest.approx(GOLDEN[query], abs=2e-5)


@pytest.mark.parametrize("query", QUERIES)
def test_index_against_fts5(golden, index, query):
    reference = fts([(r["id"], None, r["name"], r["body"]) for r in golden.collect()])
    assert found(P.search(golden, query, limit=-1, postings=index[0], size=index[1])) == sorted(reference(query), key=lambda x: (x[1], x[0]))


@pytest.mark.parametrize("query", ERRORS)
def test_syntax_errors(query):
    with pytest.raises(QuerySyntaxError):
        parse(query)


def test_texts_against_fts5(spark):
    rng = random.Random(7)
    words = "La carga Ñandú lenta pasa. Café: uno_dos, d'or ß ½ ção 漢字 İstanbul Å rápido! año\n\nfin".split(" ")
    rows = [(f"{i:03d}", "t", rng.choice(words), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).cache()
    reference = fts(rows)
    for query in ("nandu", "café OR cafe", '"carga nandu"', "uno dos", "car* NOT lenta", "NEAR(carga pasa, 4)", "istanbul", "cao OR ano", "carga OR lenta OR pasa"):
        assert found(P.search(df, query, limit=-1)) == sorted(reference(query), key=lambda x: (x[1], x[0])), query


def test_search_edges(spark, golden):
    df = spark.createDataFrame([("a", "t", None, None), ("b", "u", "aa", None), ("c", "t", "", "aa")], SCHEMA)
    got = {r["id"]: r["snippet"] for r in P.search(df, "aa").collect()}
    assert got == {"b": None, "c": "<<aa>>"}
    assert [r["id"] for r in P.search(df, "aa", type="u").collect()] == ["b"]
    assert P.search(df, "aa", type="").count() == 2  # an empty type is no filter
    assert P.search(golden, "aa", limit=0).count() == 0
    assert P.search(golden, "aa", limit=2).count() == 2
    assert P.search(df.limit(0), "aa").count() == 0
    with pytest.raises(ValueError):
        P.search(golden, "aa", limit="x")
    same = {r["id"]: r["rank"] for r in P.search(golden, "aa OR n1", limit=-1).collect()}
    assert {r["id"]: r["rank"] for r in P.search(golden, "aa OR n1", type="t", limit=-1).collect()} == same


def test_tokens(spark):
    from pyspark.sql import functions as F

    from quillgraph.functions.text import excerpt, fold, keywords, normal_term, tokens

    text = "Ñandú ÇÃO Å ǖ uno_dos d'or ß ø ﬁ ½ ² ª 漢字 é 😀x"
    row = spark.createDataFrame([(text,), (None,)], "t string").select(tokens(F.col("t")).alias("w"), fold(F.col("t")).alias("f")).collect()
    assert tuple(row[0]["w"]) == tokenize(text) and row[1]["w"] == []
    out = spark.createDataFrame([(" \xa0A\tb  C ", "x" * 141), (None, None)], "t string, b string")
    out = out.select(normal_term(F.col("t")).alias("t"), excerpt(F.col("b")).alias("e"), keywords(F.col("t")).alias("k")).collect()
    assert (out[0]["t"], out[0]["e"]) == ("a b c", "x" * 140 + "…") and (out[1]["t"], out[1]["e"], out[1]["k"]) == (None, "", [])


def test_snippet():
    text = " ".join(f"w{i}" for i in range(60))
    assert snippet(text, [[40]], [1]).startswith("…w33") and "<<w40>>" in snippet(text, [[40]], [1])
    assert snippet(None, [[1]], [1]) is None
    assert snippet("", [], []) == ""
