"""Snippets: the best window of a body around the hits, with the hits marked.

Windows start so that the hits in them lie in the middle, or at the start of a sentence. A window scores 1000
for each different phrase in it and 1 for each repetition; one that starts at a sentence gets 100 more, at the
first one 120. The first window of the best score holds. Runs on the survivors of a top-k only.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS = 16
OPEN, CLOSE, ELLIPSIS = "<<", ">>", "…"
_TOKEN = re.compile("[^\\W_](?:[^\\W_]|[̀-ͯ])*")


def _score(start: int, hits: list[tuple[int, int, int]], n_tokens: int, doc_tokens: int) -> tuple[int, int]:
    """Score of the window at ``start``, and where it would start with its hits in the middle."""
    seen: set[int] = set()
    score, first, last = 0, -1, 0
    for at, phrase, size in hits:
        if start <= at < start + n_tokens:
            score += 1 if phrase in seen else 1000
            seen.add(phrase)
            first = at if first < 0 else first
            last = at + size
    middle = first - (n_tokens - (last - first)) // 2
    return score, max(0, min(middle, doc_tokens - n_tokens))


def _sentences(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Tokens that start a sentence: the first, and those after a stop and white space."""
    out = []
    for i, (start, _) in enumerate(spans):
        k = start - 1
        while k >= 0 and text[k] in " \t\r\n":
            k -= 1
        if i == 0 or k != start - 1 and (k < 0 or text[k] in ".:"):
            out.append(i)
    return out


def snippet(text: str | None, places: Sequence[Sequence[int]], sizes: Sequence[int], n_tokens: int = TOKENS) -> str | None:
    """``places``: token positions of each phrase in the text, ``sizes``: its number of tokens. Null text gives null."""
    if text is None:
        return None
    spans = [m.span() for m in _TOKEN.finditer(text)]
    hits = sorted((at, p, sizes[p]) for p, found in enumerate(places) if found is not None for at in found)
    starts = _sentences(text, spans)
    best, begin = 0, 0
    for at, _, _ in hits:
        score, middle = _score(at, hits, n_tokens, len(spans))
        if score > best:
            best, begin = score, middle
        if starts and len(spans) > n_tokens:
            before = [s for s in starts if s <= at]
            near = before[-1] if before else starts[0]
            if near < at:
                score = _score(near, hits, n_tokens, len(spans))[0] + (120 if near == 0 else 100)
                if score > best:
                    best, begin = score, near
    end = begin + n_tokens - 1
    out, done = ([] if begin == 0 else [ELLIPSIS]), (0 if begin == 0 or not spans else spans[begin][0])
    marked = -1
    for at, _, size in hits:
        last = min(at + size - 1, end)
        if last < begin or at > end or last <= marked:
            continue
        first = max(at, begin, marked + 1)
        if first == marked + 1 and marked >= begin and at <= marked:  # overlapping hits are one mark
            out[-1] = text[done : spans[last][1]]
            out.append(CLOSE)
        else:
            out += [text[done : spans[first][0]], OPEN, text[spans[first][0] : spans[last][1]], CLOSE]
        done, marked = spans[last][1], last
    if end >= len(spans) - 1:
        out.append(text[done:])
    else:
        out += [text[done : max(done, spans[end][1])], ELLIPSIS]
    return "".join(out)


def snippet_column(text: Column, places: Column, sizes: list[int]) -> Column:
    @F.pandas_udf("string")
    def make(text: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([snippet(t, p if p is not None else [], sizes) for t, p in zip(text, places)], dtype=object)

    return make(text, places)
