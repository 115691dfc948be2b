"""Encoding, leakage and shared spans, against brute force."""

from __future__ import annotations

import random
import string

import numpy as np
import pytest

from quillgraph.llm import encode as E
from quillgraph.llm import leakage as K
from quillgraph.llm import rolling as L
from quillgraph.llm import spans as S
from quillgraph.session import materialize

DOCS = "doc_id bigint, text string, ids string, places int"


@pytest.fixture(scope="module")
def plain():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(E.TOKENIZER.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


ODD = ["a", "the", "'", "s", "'s", " ", "  ", "\n", "é", "漢", "1", "!", "''", "🚚", "\xa0", "\u0301", "\x1c", "<|endoftext|>", "ll", "a" * 24, "!" * 24, "1" * 22, " " * 23, "\n" * 18]


@pytest.mark.parametrize("leaf", [1, 5, 16])
def test_encoding_is_exact(plain, leaf):
    """Cuts fall anywhere: within words, runs, white space and contractions."""
    enc, rng = E.Encoder(leaf_chars=leaf), random.Random(leaf)
    for _ in range(1500):
        text = "".join(rng.choice(ODD) for _ in range(rng.randrange(40)))
        want = plain(text)
        assert enc.encode(text) == want, text
        assert enc.tree([enc.encode(p) for p in E.halves(text, 8)] if text else []) == want, text


@pytest.mark.parametrize("letters", ["z", "ab", string.ascii_lowercase, "áéí", "0123456789", "!?.", " \n", "'s", "漢字漢"])
def test_long_runs_are_joined_exactly(plain, letters):
    enc, rng = E.Encoder(leaf_chars=300), random.Random(4)
    text = "".join(rng.choice(letters) for _ in range(20_000))
    for whole in (text, f"uno {text} dos", f"uno{text}dos"):
        assert enc.encode(whole) == plain(whole)


@pytest.mark.parametrize("letters", [string.ascii_lowercase, "漢字。、", string.ascii_letters + string.digits + "+/", "it's'll", "\n \t"])
def test_a_run_of_a_million_characters_is_joined_in_little_time(plain, letters):
    """The parts of a text without breaks are encoded apart and joined by windows, not encoded again as a whole."""
    enc, rng = E.Encoder(), random.Random(5)
    text = "x " + "".join(rng.choices(letters, k=1_000_000)) + " y"
    parts = [enc.encode(p) for p in E.halves(text, E.PART_CHARS)]
    seen = []
    single = enc.bpe._encode_single_piece

    class Counting:
        def __getattr__(self, name):
            return getattr(bpe, name)

        def _encode_single_piece(self, data):
            seen.append(len(data))
            return single(data)

    bpe, enc.bpe = enc.bpe, Counting()
    ids = enc.tree(parts)
    assert sum(seen) < 10_000 and b"".join(enc.bytes[i] for i in ids).decode() == text
    assert ids == plain(text)


def test_encode_corpus(spark, plain):
    rng = random.Random(2)
    texts = [None, "", "  ", "uno <|endoftext|>", "x" * 900, " ".join("".join(rng.choice(ODD) for _ in range(5)) for _ in range(200)), "x" * 900]
    texts += ["".join(rng.choices("abc", k=10_000)), "uno " + "ñ" * 3000]
    df = spark.createDataFrame([(i, t, "q", 1) for i, t in enumerate(texts)] + [(6, texts[6], "q", 1)], DOCS)
    got = E.encode_corpus(df, materialize, part_chars=100, leaf_chars=9)
    rows = [(r["doc_id"], r["ids"]) for r in got.collect()]
    assert sorted(rows) == sorted([(i, plain(t) if t else []) for i, t in enumerate(texts)] + [(6, plain(texts[6]))])
    assert got.columns == ["doc_id", "ids"]
    assert E.encode_corpus(df.limit(0), materialize).count() == 0


def test_ids_of_the_test_table(spark, small, plain):
    from quillgraph.llm.queries import p8_ids

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r["doc_id"]: r["ids"] for r in p8_ids(spark, small).collect()}
    assert got == {k: plain(t) if t else [] for k, t in docs.items()}


ITEM = "Cuando Dilofeguq supera 32 kg, ¿qué decide Kipufoguk con la canción número 21 hoy?"  # 14 words
ITEMS = "item_id bigint, text string, doc_id int, answer string"


def leaks(spark, docs, items, **options):
    d, i = spark.createDataFrame([(k, t, "q", 1) for k, t in docs], DOCS), spark.createDataFrame([(k, t, 1, "a") for k, t in items], ITEMS)
    return d, K.leaks(d, i, materialize, **options)


def test_leaks(spark):
    words = ITEM.split()
    docs = [
        (1, "antes " + ITEM + " después"),
        (2, "x. " + " ".join(words[1:13]).upper().replace("Ó", "o") + " y"),
        (3, " ".join(words[:11])),
        (4, ITEM.replace("ó", "o\u0301").replace("ú", "u\u0301").replace(" ", "\n--")),
        (5, " ".join(words[:7]) + " otro " + " ".join(words[7:])),
        (6, None),
        (7, ""),
        (8, ITEM + " " + ITEM),
        (8, ITEM + " " + ITEM),
    ]
    items = [(10, ITEM), (11, " ".join(words[:11])), (12, None), (13, ""), (14, ITEM + " con final"), (10, ITEM)]
    want = {(d, i) for d in (1, 2, 4, 8) for i in (10, 14)}
    d, found = leaks(spark, docs, items)
    rows = found.collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(rows) == len(want)
    one = next(r for r in rows if (r["doc_id"], r["item_id"]) == (1, 10))
    assert one["n_words"] == 14 and docs[0][1][one["spans"][0]["start"] : one["spans"][0]["end"]] == ITEM.rstrip("?")
    kept = {r["doc_id"]: r["text"] for r in K.without_leaks(d, found).collect()}
    assert kept[1] == "antes ? después" and kept[3] == docs[2][1] and kept[6] is None
    assert {r["doc_id"] for r in K.without_leaks(d, found, "documents").collect()} == {3, 5, 6, 7}
    for none in (leaks(spark, [], items), leaks(spark, docs, [])):
        assert none[1].count() == 0


def test_hits_are_exact_when_all_windows_pass(spark, monkeypatch):
    """A set beyond the bound of its filter lets any window pass; the join then finds the same."""
    rng = random.Random(11)
    vocabulary = ["uno", "DOS", "tres", "cu\u00e1tro", "5"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12))) for _ in range(60)]
    d, i = [(k, t) for k, t in enumerate(texts)], [(k, t) for k, t in enumerate(texts[:20])]
    grams = lambda t: {tuple(w[k : k + 4]) for w in [K.words(t)] for k in range(len(w) - 3)}
    want = {(a, b) for a, x in d for b, y in i if grams(x) & grams(y)}
    monkeypatch.setattr(K, "_CHUNK", 50)
    monkeypatch.setattr(K, "bit_filter", lambda *_: np.full(1 << 10, 255, np.uint8))
    _, found = leaks(spark, d, i, window=4)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want and want


def test_filter_holds_its_set_and_little_else(spark):
    rng = np.random.default_rng(3)
    h = rng.integers(-(1 << 63), 1 << 63, 60_000)
    bits = L.bit_filter(spark.createDataFrame([(int(x),) for x in h], "h bigint"), len(h))
    assert len(bits) * 8 == 1 << L.filter_bits(60_000) and L.passes(bits, h.view(np.uint64)).all()
    assert L.passes(bits, rng.integers(0, 1 << 63, 100_000).astype(np.uint64)).mean() < 0.01
    assert L.filter_bits(10**12) == L.MOST_BITS and L.filter_bits(0) == L.LEAST_BITS


def test_hashes_do_not_depend_on_the_place():
    texts = ["uno", "", "dos uno", "uno", "\U0001f69a uno"]
    h = L.text_hashes(texts)
    assert h[0] == h[3] and len(set(h.tolist())) == 4 and len(L.text_hashes([])) == 0
    codes = L.code_points("dos uno tres")
    assert L.Stretches(codes).between(np.array([0, 4]), np.array([7, 7])).tolist() == [h[2], h[0]]


def text_of(seed, n, alphabet="abcdefgh"):
    return "".join(random.Random(seed).choices(alphabet, k=n))


def brute_pairs(docs, span):
    where: dict[str, set] = {}
    for k, t in docs:
        for i in range(len(t or "") - span + 1):
            where.setdefault(t[i : i + span], set()).add(k)
    return {(a, b) for ids in where.values() for a in ids for b in ids if a < b}, where


def brute_share(docs, span, where):
    out = {}
    for k, t in docs:
        covered = np.zeros(len(t or ""), bool)
        for i in range(len(t or "") - span + 1):
            if len(where[t[i : i + span]]) > 1:
                covered[i : i + span] = True
        out[k] = int(covered.sum())
    return out


def corpus(seed, n=40, alphabet="abcdefgh ñ😀"):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [text(rng.choice([29, 30, 31, 45, 80])) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = [text(rng.randrange(40)) + (rng.choice(shared) if rng.random() < 0.6 else "") for _ in range(3)]
        docs.append((i, "".join(parts)))
    return docs + [(900, "a" * 200), (901, "b" + "a" * 60), (902, "a" * 29), (903, None), (904, ""), (905, docs[0][1])]


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {}), (1, {"gram": 30}), (3, {"slice_size": 1, "cells": 1})])
def test_shared_spans(spark, seed, options):
    """Short spans stand for long ones; selected windows and all windows give the same; a full sketch loses nothing."""
    docs = corpus(seed)
    df = spark.createDataFrame([(k, t, "q", 1) for k, t in docs], DOCS)
    pairs, where = brute_pairs(docs, 30)
    options = {"span": 30, "gram": 24} | options
    classes = S.shared_classes(df, materialize, **options)
    rows = [tuple(r) for r in S.shared_pairs(classes).collect()]
    assert set(rows) == pairs and len(rows) == len(pairs)
    share = {r["doc_id"]: (r["n_chars"], r["shared_chars"], r["share"]) for r in S.shared_shares(df, materialize, **options).collect()}
    want = brute_share(docs, 30, where)
    assert {k: v[1] for k, v in share.items()} == want
    assert share[903][0] is None and share[903][2] is None and share[904] == (0, 0, 0.0)


def test_classes_have_a_row_for_each_member(spark):
    """Many copies of one page are one class, not all its pairs; a near copy adds one more."""
    page = text_of(6, 200)
    docs = [(i, page) for i in range(300)] + [(1000, page[:100] + "#" + page[101:])]
    df = spark.createDataFrame([(k, t, "q", 1) for k, t in docs], DOCS)
    classes = S.shared_classes(df, materialize, 30, 24)
    sizes = sorted(r["count"] for r in classes.groupBy("class_id").count().collect())
    assert sizes == [300, 301]
    assert S.shared_pairs(classes).count() == 301 * 300 // 2
    assert S.shared_classes(df.limit(0), materialize).count() == 0


def test_records_without_id_and_repeated_ones(spark):
    text = text_of(7, 50)
    df = spark.createDataFrame([(1, text, "q", 1), (1, text, "q", 1), (None, text, "q", 1)], DOCS)
    assert S.shared_classes(df, materialize, 30, 24).count() == 0


@pytest.mark.parametrize("n", [1_000, 100_000])
def test_the_sketch_grows_with_its_input(n):
    """At any size few unique windows pass, and every repeated one does."""
    h = np.random.default_rng(1).integers(0, 1 << 63, n).astype(np.uint64)
    h = np.concatenate([h, h[: n // 10], h[n // 10 : n // 5]])
    several = np.zeros(len(h), bool)
    several[n // 10 + n :] = True
    passed = S.estimated_repeated(h, several)
    assert passed[n:].all() and passed[: n // 5].all()
    assert passed[n // 5 : n].mean() < 0.1


def test_more_slices_for_more_windows(spark):
    docs = [(i, text_of(i, 300)) for i in range(60)]
    df = spark.createDataFrame([(k, t, "q", 1) for k, t in docs], DOCS)
    sketches = materialize(S.sparse_sketches(df, 30, 30), "sketches")
    n = sum(len(r["n"]) // 2 for r in sketches.filter("part >= 0").collect())
    assert n == 60 * 271
    passed = S.repeated_windows(sketches, n, slice_size=16, cells=8)  # 1,024 slices: four for each part of a sketch
    assert sum(len(r["n"]) // 2 for r in passed.collect()) < 0.1 * n


def places(text):
    return sorted({(int(at), int(x)) for _, place, h in S.selected([text], 30, 24) for at, x in zip(place, h)})


def test_chunks_select_the_same(monkeypatch):
    text = text_of(9, 5000, "abcd")
    whole = places(text)
    monkeypatch.setattr(S, "_CHUNK", 100)
    assert places(text) == whole


def test_texts_of_a_batch_do_not_touch():
    rng = random.Random(10)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(20, 90))) for _ in range(50)] + [None, ""]
    together = {(int(i), int(at), int(x)) for index, place, h in S.selected(texts, 30, 24) for i, at, x in zip(index, place, h)}
    assert together == {(i, *x) for i, t in enumerate(texts) for x in places(t)}


def test_windows_of_every_stretch_hold_a_selected_one():
    text = text_of(8, 3000, "ab") + "a" * 300
    at = {x for x, _ in places(text)}
    assert all(at & set(range(i, i + 7)) for i in range(len(text) - 29))
