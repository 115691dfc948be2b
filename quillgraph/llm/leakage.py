"""Evaluation texts leaking into training text.

The hashes of all windows of words of the held-out items form a set that is broadcast, as a bit filter of bounded
size (see ``rolling``). Documents are read once, however many the items are: all windows of words of a batch are
hashed together, and those the set lets pass are hits with their words. A join with the items' windows verifies
each hit word by word; it also gives the items. A larger set than the filter's bound lets more windows pass to the
join, and loses none.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import Stretches, bit_filter, code_points, passes, text_hashes

#: Words in a row that make a leak.
WINDOW = 12

_CHUNK = 1 << 18  # characters hashed at once
_BREAK = 0x0A  # between words

# A word: letters and digits; combining marks (of decomposed letters) go with the letter before.
_WORD = re.compile("[^\\W_](?:[^\\W_]|[̀-ͯ])*")
_MARKS = re.compile("[̀-ͯ]+")


def fold(text: str) -> str:
    return _MARKS.sub("", unicodedata.normalize("NFD", text.lower()))


def folded_words(text: str | None) -> str:
    """Words of a text, lower-cased and without diacritics, a line each; empty for a null text."""
    return fold("\n".join(_WORD.findall(text))) if text else ""


def words(text: str | None) -> list[str]:
    """As :func:`folded_words`, a list."""
    joined = folded_words(text)
    return joined.split("\n") if joined else []


def word_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text)]


def item_grams(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``gram, h, item_id``: the distinct windows of words of each item, with their hashes; shorter items have none."""
    kind = items.schema["item_id"].dataType

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                w = words(text)
                mine = {"\n".join(w[k : k + window]) for k in range(len(w) - window + 1)}
                at += [i] * len(mine)
                out += mine
            h = text_hashes(out).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(h), batch.column(0).take(pa.array(at, pa.int64()))], names=["gram", "h", "item_id"])

    return items.select("item_id", "text").mapInArrow(grams, f"gram string, h bigint, item_id {kind.simpleString()}").distinct()


def window_hits(texts: list[str | None], held: np.ndarray, window: int = WINDOW) -> Iterator[tuple[int, int, int, str]]:
    """Index of the text, places of the first word and of the end in its words, and words of the windows in the set."""
    joined = [folded_words(t) for t in texts]
    at = 0
    while at < len(joined):
        end, n = at, 0
        while end < len(joined) and n < _CHUNK:
            n, end = n + len(joined[end]) + 1, end + 1
        part = "\n".join(joined[at:end])
        codes = code_points(part)
        breaks = np.flatnonzero(codes == _BREAK)
        starts, ends = np.concatenate([np.zeros(1, np.int64), breaks + 1]), np.append(breaks, len(codes))
        sizes = np.array([x.count("\n") + 1 for x in joined[at:end]])  # an empty text is one empty word
        owner = np.repeat(np.arange(at, end), sizes)
        if len(starts) >= window:
            last = ends[window - 1 :]
            first = starts[: len(last)]
            hit = passes(held, Stretches(codes).between(first, last)) & (owner[: len(last)] == owner[window - 1 :])
            before = np.cumsum(sizes) - sizes
            for k in np.flatnonzero(hit).tolist():
                i = int(owner[k])
                yield i, int(k - before[i - at]), int(k - before[i - at]) + window, part[first[k] : last[k]]
        at = end


def document_hits(documents: DataFrame, held, window: int = WINDOW) -> DataFrame:
    """``doc_id, gram, at, start, end``: windows in the broadcast set ``held``, with places in words and in characters."""
    kind = documents.schema["doc_id"].dataType
    names = ["doc_id", "gram", "at", "start", "end"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows, of, spans = [], -1, []
            for i, at, end, gram in window_hits(texts, held.value, window):
                if i != of:
                    of, spans = i, word_spans(texts[i])
                rows.append((i, gram, at, spans[at][0], spans[end - 1][1]))
            index, *cols = zip(*rows) if rows else [()] * 5
            types = (pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)

    return documents.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind.simpleString()}, gram string, at int, start int, end int")


def leaked_windows(documents: DataFrame, items: DataFrame, materialize, window: int = WINDOW) -> DataFrame:
    """``doc_id, item_id, at, start, end``: the verified hits, each once."""
    grams = materialize(item_grams(items, window), "grams")
    hashes = materialize(grams.select("h").distinct(), "hashes")
    held = documents.sparkSession.sparkContext.broadcast(bit_filter(hashes, hashes.count()))
    hits = document_hits(documents, held, window)
    return hits.join(grams.select("gram", "item_id"), "gram").select("doc_id", "item_id", "at", "start", "end").distinct()


def leaks(documents: DataFrame, items: DataFrame, materialize, window: int = WINDOW) -> DataFrame:
    """``doc_id, item_id, n_words, spans``: each document with each item it leaks.

    ``n_words`` is the number of words covered by leaked windows, ``spans`` their places in the text as
    ``start, end`` in characters. Items with fewer words than the window, and null or empty texts, leak
    nothing. Repeated rows of a document come out once.
    """
    found = leaked_windows(documents, items, materialize, window)
    windows = F.sort_array(F.collect_list(F.struct("at", "start", "end"))).alias("w")  # at most the words of a document
    found = found.groupBy("doc_id", "item_id").agg(windows)
    # Windows that touch or overlap are one span.
    apart = f"x.at > w[i - 1].at + {window}"
    found = found.withColumn("first", F.expr(f"filter(w, (x, i) -> i = 0 OR {apart})"))
    found = found.withColumn("last", F.expr(f"filter(w, (x, i) -> i = size(w) - 1 OR w[i + 1].at > x.at + {window})"))
    spans = F.zip_with("first", "last", lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))
    covered = F.zip_with("first", "last", lambda a, b: b["at"] - a["at"] + window)
    n_words = F.aggregate(covered, F.lit(0), lambda a, x: a + x)
    return found.select("doc_id", "item_id", n_words.alias("n_words"), spans.alias("spans"))


def without_leaks(documents: DataFrame, found: DataFrame, remove: str = "spans") -> DataFrame:
    """The documents without leaking spans (``remove="spans"``) or without leaking documents.

    Other columns stay as they are; a document that leaks nothing is untouched, null texts too.
    """
    if remove == "documents":
        return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    spans = found.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("__spans"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t, s):
            if t is None or s is None:
                return t
            kept, at = [], 0
            for x in sorted(s, key=lambda x: (x["start"], x["end"])):
                kept.append(t[at : max(at, x["start"])])
                at = max(at, x["end"])
            return "".join([*kept, t[at:]])

        return pd.Series([one(t, s) for t, s in zip(text, spans)])

    return documents.join(spans, "doc_id", "left").withColumn("text", cut("text", "__spans")).drop("__spans")
