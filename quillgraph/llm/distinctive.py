"""How distinctive a term is per record: adjusted residuals of the table records x keywords.

The cell is how often the keyword stands in the record's body, the row margin the number of words of the
body, the column margin the occurrences of the keyword in all bodies. With expectation
``E = row * column / total`` the score is ``(count - E) / sqrt(E (1 - row/total) (1 - column/total))``.

Counting keywords in all bodies needs no list of them on the workers. Every run of words of a body, of each length
that keywords have, is hashed, all runs of a batch together, and looked up in a bit filter of bounded size (see
``rolling``). It lets all keywords pass and few other runs; the exact join with the keywords removes those. Runs are
looked up to MAX_WORDS words; a longer keyword is looked up by its first words and then counted exactly in the
bodies that have these. Keywords of signs only are looked up in the stretches between words, at the lengths that
such keywords have.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_term
from .rolling import Stretches, bit_filter, code_points, passes, text_hashes, word_table

#: Words of the longest runs that are looked up. Longer keywords go by their first words.
MAX_WORDS = 8

_CHUNK = 1 << 18  # characters hashed at once

_WORD = re.compile(r"\w+")
_GAP = re.compile(r"\W+")
_EDGES = re.compile(r"^\W+|\W+$")


def keyword_core(term: str) -> str:
    """The term without signs at its ends; what a run of words can match."""
    return _EDGES.sub("", term)


def lookup_of(term: str, max_words: int = MAX_WORDS) -> tuple[str, int]:
    """What is looked up for a term, and its number of words: the core, cut after ``max_words`` words; signs only: the term."""
    core = keyword_core(term)
    words = [m.end() for m in _WORD.finditer(core)][:max_words]
    return (core[: words[-1]], len(words)) if words else (term, 0)


def _lookup_columns(term, max_words: int):
    @F.pandas_udf("struct<lookup:string,words:int,h:bigint>")
    def lookups(term: pd.Series) -> pd.DataFrame:
        found = [lookup_of(t, max_words) for t in term]
        texts = [x[0] for x in found]
        return pd.DataFrame({"lookup": texts, "words": [x[1] for x in found], "h": text_hashes(texts).view(np.int64)})

    return lookups(term)


def canonical(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip().lower()


def count_term(term: str, text: str) -> int:
    """Occurrences of a term in a canonical text, not touching a word character, without overlap."""
    return len(re.findall(rf"(?<!\w){re.escape(term)}(?!\w)", text))


def _apart(starts: np.ndarray, ends: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which occurrences count, left to right without overlap within each group; rows are sorted by group and start."""
    keep = np.ones(len(starts), bool)
    close = np.flatnonzero((group[1:] == group[:-1]) & (starts[1:] < ends[:-1])) + 1
    for g in np.unique(group[close]).tolist():  # runs that repeat within themselves are rare
        until = -1
        for i in range(*np.searchsorted(group, [g, g + 1]).tolist()):
            keep[i] = starts[i] >= until
            until = ends[i] if keep[i] else until
    return keep


def word_runs(texts: list[str], held: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, list[tuple[int, str, int]]]:
    """Words of each canonical text, and ``index, run, n`` of the runs of these lengths that the filter lets pass."""
    n_words, out, at = np.zeros(len(texts), np.int64), [], 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and n < _CHUNK:
            n, end = n + len(texts[end]) + 1, end + 1
        part = "\n".join(texts[at:end]) + "\n"
        codes = code_points(part)
        inside = word_table()[codes]
        edges = np.flatnonzero(np.diff(inside, prepend=False))  # every word begins and ends at one
        starts, ends = edges[::2], edges[1::2]
        owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts[at:end]]), starts, "right")
        n_words[at:end] = np.bincount(owner, minlength=end - at)
        stretches, found = Stretches(codes), []
        for k in lengths:
            first = starts[: max(0, len(starts) - k + 1)]
            last = ends[k - 1 :]
            h = stretches.between(first, last)
            hit = np.flatnonzero((owner[: len(first)] == owner[k - 1 :]) & passes(held, h))
            found.append((owner[hit], h[hit], first[hit], last[hit]))
        if found:
            own, h, first, last = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((first, last - first, h, own))
            own, h, first, last = own[order], h[order], first[order], last[order]
            size = last - first
            fresh = np.ones(len(own), bool)
            fresh[1:] = (own[1:] != own[:-1]) | (h[1:] != h[:-1]) | (size[1:] != size[:-1])
            group = np.cumsum(fresh)
            counts = np.bincount(group[_apart(first, last, group)])[1:]
            heads = np.flatnonzero(fresh)
            out += [(at + i, part[a:b], c) for i, a, b, c in zip(own[heads].tolist(), first[heads].tolist(), last[heads].tolist(), counts.tolist())]
        at = end
    return n_words, out


def sign_runs(text: str, held: np.ndarray, lengths: list[int]) -> list[tuple[str, int]]:
    """Runs of signs of these lengths in a canonical text that the filter lets pass, with their occurrences."""
    runs = sorted({g[i : i + n] for g in set(_GAP.findall(text)) for n in lengths for i in range(len(g) - n + 1)})
    listed = passes(held, text_hashes(runs)) if runs else []
    return [(x, n) for x, ok in zip(runs, listed) if ok and (n := count_term(x, text))]


def _counter(bits, lengths: list[int], signs: list[int]):
    """Rows ``id, lookup, n`` for ``id, body``: runs of words and of signs with their numbers, and the number of words under a null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for batch in batches:
            texts = [canonical(t or "") for t in batch.column(1).to_pylist()]
            n_words, found = word_runs(texts, held, lengths)
            if signs:
                found += [(i, *x) for i, t in enumerate(texts) for x in sign_runs(t, held, signs)]
            index, runs, counts = zip(*found) if found else [()] * 3
            at = pa.array([*range(len(texts)), *index], pa.int64())
            n = np.concatenate([n_words, np.array(counts, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([*[None] * len(texts), *runs], pa.string()), pa.array(n)], names=["id", "lookup", "n"])

    return count


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [count_term(t, canonical(b or "")) for t, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["id", "term", "n"])


def distinctive_terms(entities: DataFrame, terms: DataFrame, current, materialize, max_words: int = MAX_WORDS) -> DataFrame:
    """``entity_id, term, n_records, n_in_body, n_in_all, score`` for every keyword of every current entity.

    Keywords are in normal form, listed once per entity; ``n_records`` is how many distinct non-empty ids list
    the term (existing or not). A keyword that is not in the body has a negative or zero score; a null or empty
    body counts no words and scores 0. Every keyword is counted in all bodies: one that begins or ends with a sign, or
    has more than ``max_words`` words, by its looked-up part first and then by the whole.
    """
    record = F.when(F.col("entity_id") != "", F.col("entity_id"))
    pairs = terms.select(normal_term(F.col("term")).alias("term"), record.alias("entity_id"))
    pairs = pairs.filter((F.col("term") != "") & F.col("entity_id").isNotNull()).distinct()
    pairs = materialize(pairs, "pairs")
    listed = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("n_records"))
    vocab = listed.select("term", "n_records", _lookup_columns(F.col("term"), max_words).alias("c")).select("term", "n_records", "c.*")
    vocab = materialize(vocab, "vocab")
    n, lengths, signs = vocab.agg(
        F.count(F.lit(1)), F.collect_set(F.when(F.col("words") > 0, F.col("words"))), F.collect_set(F.when(F.col("words") == 0, F.length("term")))
    ).first()
    bits = entities.sparkSession.sparkContext.broadcast(bit_filter(vocab.select("h").distinct(), n))

    bodies = materialize(current(entities, "body"), "bodies")
    kind = bodies.schema["id"].dataType.simpleString()
    counted = bodies.select("id", "body").mapInArrow(_counter(bits, sorted(lengths), sorted(signs)), f"id {kind}, lookup string, n bigint")
    counted = materialize(counted, "counted")
    margin = counted.filter(F.col("lookup").isNull()).select("id", F.col("n").alias("row_n"))
    total = margin.agg(F.sum("row_n")).scalar()
    found = counted.filter(F.col("lookup").isNotNull())

    odd = vocab.filter(F.col("term") != F.col("lookup")).select("term", "lookup")
    candidates = found.join(odd, "lookup").select("id", "term").distinct()
    verified = candidates.join(bodies, "id").select("id", "term", "body").mapInArrow(_verify, f"id {kind}, term string, n bigint")
    cells = found.select("id", F.col("lookup").alias("term"), "n").unionByName(verified.filter(F.col("n") > 0))
    cells = materialize(cells, "cells")

    column = cells.groupBy("term").agg(F.sum("n").alias("column_n"))
    column = vocab.select("term", "n_records").join(column, "term", "left")
    mine = pairs.withColumnRenamed("entity_id", "id").join(margin, "id").join(cells, ["id", "term"], "left")
    scored = mine.join(column, "term")
    n, row_n, column_n = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("n", "row_n", "column_n"))
    expected = row_n * column_n / total
    spread = F.sqrt(expected * (1 - row_n / total) * (1 - column_n / total))
    return scored.select(
        F.col("id").alias("entity_id"),
        "term",
        "n_records",
        F.coalesce("n", F.lit(0)).alias("n_in_body"),
        F.coalesce("column_n", F.lit(0)).alias("n_in_all"),
        F.when(spread > 0, (n - expected) / spread).otherwise(0.0).alias("score"),
    )
