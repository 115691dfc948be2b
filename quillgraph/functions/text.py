"""Column functions on text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_term(term: Column) -> Column:
    """White-space runs (no-break spaces too) become one space; trimmed; lower case; accents stay."""
    return F.lower(F.trim(F.regexp_replace(term, r"(?U)[\s\x1c-\x1f]+", " ")))


def _fold_map() -> tuple[str, str]:
    """Letters with diacritics and their base letters, by Unicode decomposition (Latin blocks, lower case)."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)
        if len(base) > 1 and all(unicodedata.combining(c) for c in base[1:]) and letter == letter.lower():
            pairs.append((letter, base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _fold_map()


def fold(text: Column) -> Column:
    """Lower case without diacritics, composed or decomposed; other letters stay."""
    return F.translate(F.regexp_replace(F.lower(text), "[̀-ͯ]", ""), FOLD_FROM, FOLD_TO)


def tokens(text: Column) -> Column:
    """Tokens of the full-text index: runs of letters, numbers and private-use signs. Null text has none."""
    found = F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


def excerpt(body: Column, size: int = 140) -> Column:
    """The first ``size`` code points with an ellipsis if there are more; '' for null."""
    return F.when(F.length(body) > size, F.concat(F.substring(body, 1, size), F.lit("…"))).otherwise(
        F.coalesce(body, F.lit(""))
    )


def keywords(text: Column, longer_than: int = 4) -> Column:
    """Lower-case words of a summary: split at white space and signs, longer than ``longer_than``."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s—,;:()]+"), lambda w: F.length(w) > longer_than)
