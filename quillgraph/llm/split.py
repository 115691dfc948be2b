"""Splitting oversized items at natural boundaries.

A text over the limit is split by a hierarchy of separators: sections, paragraphs, lines (list items),
sentences, words, characters. A segment that fits is not split further. Segments are packed greedily: each
piece takes as many as stay within the limit, and starts with the last ``overlap`` characters of the piece
before. The function returns offsets; the pieces are cut from the text in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ends of segments, coarse to fine; a cut is at the end of each match.
SEPARATORS = [
    re.compile(
        r"\n(?=[ \t]{0,3}(?:#{1,6}[ \t]|={2,6}[^=\n]|<h[1-6]\b|\\(?:sub){0,2}section\b|[^\n]+\n[ \t]{0,3}(?:={3,}|-{3,})[ \t]*(?:\r?\n|$)))",
        re.I,
    ),
    re.compile(r"\r?\n[ \t]*\r?\n\s*"),
    re.compile(r"\r?\n"),
    re.compile(r"[.!?…。！？]+[\"'»”’)\]]*(?:\s+|(?<=[。！？]))|[;:]\s+"),
    re.compile(r"\s+"),
]


def _segments(text: str, start: int, end: int, cap: int) -> Iterator[int]:
    """Ends of segments of at most ``cap`` characters, each cut as coarsely as possible."""
    todo = [(start, end, 0)]
    while todo:
        a, b, level = todo.pop()
        if b - a <= cap:
            yield b
        elif level == len(SEPARATORS):
            while b - a > cap:
                a += cap
                yield a
            yield b
        else:
            cuts = [a, *(m.end() for m in SEPARATORS[level].finditer(text, a, b) if a < m.end() < b), b]
            todo.extend((x, y, level + 1) for x, y in reversed(list(zip(cuts, cuts[1:]))))


def piece_ranges(text: str | None, limit: int | None, overlap: int | None) -> list[dict]:
    """``start, end`` of the pieces of one text.

    A null text has no piece, an empty one the piece (0, 0); no limit (null, or under one) leaves it whole. An
    overlap as large as the limit is cut to one character less, so every piece moves on.
    """
    if text is None:
        return []
    if not limit or limit < 1 or limit != limit or len(text) <= limit:
        return [{"start": 0, "end": len(text)}]
    limit = int(limit)
    overlap = 0 if not overlap or overlap != overlap else min(max(int(overlap), 0), limit - 1)
    out, start, done = [], 0, 0
    for end in _segments(text, 0, len(text), limit - overlap):
        if end - start > limit:
            out.append({"start": start, "end": done})
            start = done - overlap
        done = end
    out.append({"start": start, "end": done})
    return out


def ranges_column(text, limit, overlap):
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def ranges(text: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
        return pd.Series([piece_ranges(*x) for x in zip(text, limit, overlap)])

    return ranges(text, limit, overlap)


def split_bodies(entities: DataFrame, limits: DataFrame, current) -> DataFrame:
    """``id, n_chars, max_chars, piece_no, start, end, piece`` of the current entities.

    The limit is that of the entity's type, or that of ``*``; a type listed twice has its least limit. Bodies
    within the limit are one piece; null bodies give none. Extra columns play no part.
    """
    least = limits.groupBy(F.col("type").alias("limit_type")).agg(F.min(F.struct("max_chars", "overlap_chars")).alias("own"))
    rest = least.filter(F.col("limit_type") == "*").agg(F.max("own")).scalar()
    bodies = current(entities, "type", "body").filter(F.col("body").isNotNull())
    limit = F.coalesce(F.col("own"), rest)
    ready = bodies.join(least, (bodies["type"] == least["limit_type"]) & (least["limit_type"] != "*"), "left")
    ready = ready.select("id", "body", F.length("body").alias("n_chars"), limit.alias("own")).select(
        "id", "body", "n_chars", F.col("own.max_chars").alias("max_chars"), F.col("own.overlap_chars").alias("overlap_chars")
    )
    cut = ready.withColumn("ranges", ranges_column("body", "max_chars", "overlap_chars"))
    return cut.select(
        "id",
        "n_chars",
        "max_chars",
        "overlap_chars",
        F.size("ranges").alias("n_pieces"),
        F.expr("transform(ranges, (r, i) -> named_struct('piece_no', i, 'start', r.start, 'end', r.end, 'piece', substring(body, r.start + 1, r.end - r.start)))").alias("pieces"),
    )
