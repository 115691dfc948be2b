from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import split as S
from quillgraph.operators.current import current_rows


def check_pieces(text, limit, overlap):
    pieces = S.piece_ranges(text, limit, overlap)
    overlap = min(overlap, limit - 1)
    assert pieces[0]["start"] == 0 and pieces[-1]["end"] == len(text)
    for p in pieces:
        assert p["end"] - p["start"] <= limit
    for a, b in zip(pieces, pieces[1:]):
        assert b["start"] == a["end"] - overlap and b["end"] > a["end"]
    return pieces


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab.\n #\r😀́"), max_size=300), st.integers(1, 60), st.integers(0, 70))
def test_pieces_cover_the_text(text, limit, overlap):
    check_pieces(text, limit, overlap)


def test_cuts_are_natural():
    sentence = "Una carga lenta pasa. "
    text = "# Uno\n\n" + sentence * 20 + "\n\n# Dos\n\n" + sentence * 20
    pieces = check_pieces(text, 500, 50)
    assert text[: pieces[0]["end"]].endswith("\n\n") and text[pieces[0]["end"] :].startswith("# Dos")
    for p in check_pieces(sentence * 60, 200, 20)[:-1]:
        assert (sentence * 60)[p["end"] - 2 : p["end"]] == ". "
    for p in check_pieces("palabra " * 100, 90, 10)[:-1]:
        assert ("palabra " * 100)[p["end"] - 1] == " "
    assert len(check_pieces("z" * 10_000, 900, 90)) == 13
    assert len(S.piece_ranges("z" * 900, 900, 90)) == 1


def test_edge_cases():
    assert S.piece_ranges(None, 5, 1) == []
    assert S.piece_ranges("", 5, 1) == [{"start": 0, "end": 0}]
    assert S.piece_ranges("abc", None, None) == [{"start": 0, "end": 3}]
    assert S.piece_ranges("abc", 0, 1) == [{"start": 0, "end": 3}]
    assert len(S.piece_ranges("abc", 1, 5)) == 3
    assert len(S.piece_ranges("a" * 10, 5, float("nan"))) == 2


def test_pieces_of_a_table(spark):
    rng = random.Random(1)
    body = "".join(rng.choice(["😀", "a. ", "b", "\n"]) for _ in range(200))
    schema = "id string, type string, body string, updated_at timestamp_ntz, max_chars int, pieces string"
    rows = [("a", "t", body, None, 1, "x"), ("b", "other", body, None, 1, "x"), ("c", None, body, None, 1, "x"), ("d", "t", None, None, 1, "x"), ("e", "t", "", None, 1, "x")]
    limits = spark.createDataFrame([("t", 40, 5), ("t", 50, 5), ("*", 10_000, 0)], "type string, max_chars int, overlap_chars int")
    entities = spark.createDataFrame(rows, schema)
    out = {r["id"]: r for r in S.split_bodies(entities, limits, current_rows).collect()}
    assert set(out) == {"a", "b", "c", "e"}
    assert [out[k]["n_pieces"] for k in "bce"] == [1, 1, 1] and out["a"]["n_pieces"] > 1
    joined = out["a"]["pieces"][0]["piece"] + "".join(p["piece"][5:] for p in out["a"]["pieces"][1:])
    assert joined == body
    alone = S.split_bodies(entities, limits.filter("type <> '*'"), current_rows)
    assert {r["id"]: r["n_pieces"] for r in alone.collect()}["b"] == 1
    assert S.split_bodies(entities.limit(0), limits.limit(0), current_rows).count() == 0
