"""From a full-text syntax tree to one DataFrame plan.

Every needed token becomes a column of its positions per text column; phrases, prefixes, initial tokens and
proximity are array expressions over those; the boolean tree and the BM25 score are column arithmetic. So a
query of any shape is one pass without a join. Corpus statistics are one row, read as a scalar subquery.

The positions come from the texts themselves (``scan_hits``: no shuffle at all) or from an index of postings
(``index_hits``: only the needed tokens are read, one shuffle by record).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.snippet import snippet_column
from ..functions.text import tokens
from ..operators.lookup import limited
from ..schema import POSTINGS
from .fts_query import COLUMNS, Near, Nothing, Op, Phrase, nears, parse

K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6

_NONE = "array<int>"


def _empty() -> Column:
    return F.array().cast(_NONE)


def needed(tree) -> list[tuple[str, bool]]:
    """Distinct (token, is a prefix) of a query, in order."""
    out: dict[tuple[str, bool], None] = {}
    for near in nears(tree):
        for p in near.phrases:
            for i, t in enumerate(p.tokens):
                out[(t, p.prefix and i == len(p.tokens) - 1)] = None
    return list(out)


def _is(token: Column, key: tuple[str, bool]) -> Column:
    return token.startswith(key[0]) if key[1] else token == key[0]


def _places(words: Column, key: tuple[str, bool]) -> Column:
    return F.array_compact(F.transform(words, lambda x, i: F.when(_is(x, key), i)))


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def _clumps(first: Column, others: list[Column], reach: int) -> Column:
    """Stretches from a start of ``first`` on, within ``reach`` of which all others start."""

    def whole(s: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.exists(o, lambda x: (x >= s) & (x <= s + reach)) for o in others])

    return F.transform(F.filter(first, whole), lambda s: F.struct(s.alias("a"), (s + reach).alias("b")))


def scan_hits(entities: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """``id, type, name, body, dl, t<key>_<column>``: positions from the texts themselves."""
    split = entities.select("id", "type", "name", "body", *[tokens(F.col(c)).alias(f"w{i}") for i, c in enumerate(COLUMNS)])
    found = [
        _places(F.col(f"w{c}"), key).alias(f"t{k}_{c}")
        for k, key in enumerate(keys)
        for c in range(len(COLUMNS))
    ]
    dl = reduce(lambda a, b: a + b, [F.size(f"w{c}") for c in range(len(COLUMNS))])
    return split.select("id", "type", "name", "body", dl.alias("dl"), *found)


def build_postings(entities: DataFrame) -> DataFrame:
    """The index: a row per token, record and column with the positions; see ``schema.POSTINGS``.

    The texts are spread by record, once; the words of a record are then grouped where they are, so no row is
    moved for each of them, and a token of all records makes no hot group.
    """
    split = entities.repartition("id").select("id", *[tokens(F.col(c)).alias(f"w{i}") for i, c in enumerate(COLUMNS)])
    dl = reduce(lambda a, b: a + b, [F.size(f"w{c}") for c in range(len(COLUMNS))])
    by_column = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"w{c}").alias("w")) for c in range(len(COLUMNS))])
    words = split.select("id", dl.alias("dl"), F.explode(by_column).alias("c"))
    words = words.select("id", "dl", F.col("c.col").alias("col"), F.posexplode("c.w").alias("at", "token"))
    rows = words.groupBy("token", "id", "col").agg(F.sort_array(F.collect_list("at")).alias("positions"), F.first("dl").alias("dl"))
    return rows.select("token", "id", "col", "positions", "dl").to(POSTINGS)


def corpus_size(entities: DataFrame, *by: str) -> DataFrame:
    """One row ``n, length``, or one for each value of ``by``: records (those without text too) and their tokens in all."""
    dl = reduce(lambda a, b: a + b, [F.size(tokens(F.col(c))) for c in COLUMNS])
    return entities.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(dl), F.lit(0)).alias("length"))


def index_hits(postings: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """``id, dl, t<key>_<column>`` from the index; only records with one of the tokens."""
    wanted = reduce(lambda a, b: a | b, [_is(F.col("token"), k) for k in keys])
    found = [
        F.sort_array(F.flatten(F.collect_list(F.when(_is(F.col("token"), key) & (F.col("col") == c), F.col("positions"))))).alias(f"t{k}_{c}")
        for k, key in enumerate(keys)
        for c in range(len(COLUMNS))
    ]
    return postings.filter(wanted).groupBy("id").agg(F.first("dl").alias("dl"), *found)


class _Plan:
    """Columns of one query over a frame of hits."""

    def __init__(self, tree):
        self.tree, self.keys = tree, needed(tree)
        self.leaves = nears(tree)

    def starts(self, p: Phrase, near: Near, c: int) -> Column:
        if c not in near.columns:
            return _empty()
        out = None
        for i, t in enumerate(p.tokens):
            at = F.col(f"t{self.keys.index((t, p.prefix and i == len(p.tokens) - 1))}_{c}")
            out = at if i == 0 else F.array_intersect(out, _shifted(at, i))
        return F.filter(out, lambda x: x == 0) if p.initial else out

    def staged(self, hits: DataFrame) -> DataFrame:
        """Adds ``s<leaf>_<phrase>_<column>`` (all starts) and ``m...`` (those that qualify), each computed once."""
        every = range(len(COLUMNS))
        hits = hits.withColumns(
            {f"s{n}_{i}_{c}": self.starts(p, near, c) for n, near in enumerate(self.leaves) for i, p in enumerate(near.phrases) for c in every}
        )
        return hits.withColumns(
            {f"m{n}_{i}_{c}": self.kept(n, near, i, c) for n, near in enumerate(self.leaves) for i in range(len(near.phrases)) for c in every}
        )

    def kept(self, n: int, near: Near, i: int, c: int) -> Column:
        """Starts of a phrase that lie in a clump: a phrase, and one of each other at most ``distance`` tokens after its end."""
        own = F.col(f"s{n}_{i}_{c}")
        if len(near.phrases) == 1:
            return own
        starts = [F.col(f"s{n}_{j}_{c}") for j in range(len(near.phrases))]
        clumps = [
            _clumps(starts[f], starts[:f] + starts[f + 1 :], len(p.tokens) + near.distance) for f, p in enumerate(near.phrases)
        ]
        return F.filter(own, lambda x: F.exists(F.concat(*clumps), lambda w: (x >= w["a"]) & (x <= w["b"])))

    def count(self, n: int, i: int, kind: str) -> Column:
        return reduce(lambda a, b: a + b, [F.size(f"{kind}{n}_{i}_{c}") for c in range(len(COLUMNS))])

    def matches(self, node, at: int) -> tuple[Column, int]:
        """Whether a node matches, and the number of the leaf after it."""
        if isinstance(node, Op):
            left, at = self.matches(node.left, at)
            right, at = self.matches(node.right, at)
            return {"and": left & right, "or": left | right, "not": left & ~right}[node.kind], at
        if isinstance(node, Nothing):
            return F.lit(False), at
        return self.count(at, 0, "m") > 0, at + 1

    def scores(self, node, at: int, part) -> tuple[Column, int]:
        """Sum of ``part(leaf, phrase)`` over the phrases whose every enclosing expression matches."""
        if isinstance(node, Nothing):
            return F.lit(0.0), at
        ok, after = self.matches(node, at)
        if isinstance(node, Near):
            own = reduce(lambda a, b: a + b, [part(at, i) for i in range(len(node.phrases))])
        else:
            own, middle = self.scores(node.left, at, part)
            if node.kind != "not":
                own = own + self.scores(node.right, middle, part)[0]
        return F.when(ok, own).otherwise(0.0), after

    def places(self, node, at: int) -> list[Column]:
        """Starts in the body of each phrase, empty where an enclosing expression does not match."""
        ok, _ = self.matches(node, at)
        body = len(COLUMNS) - 1
        if isinstance(node, Nothing):
            return []
        if isinstance(node, Near):
            inner = [F.col(f"m{at}_{i}_{body}") for i in range(len(node.phrases))]
        else:
            inner = self.places(node.left, at)
            _, middle = self.matches(node.left, at)
            right = self.places(node.right, middle)
            inner += right if node.kind != "not" else [_empty() for _ in right]
        return [F.when(ok, x).otherwise(_empty()) for x in inner]


def search(
    entities: DataFrame,
    query: str,
    type: str | None = None,
    limit: int = 20,
    postings: DataFrame | None = None,
    size: DataFrame | None = None,
    with_snippet: bool = True,
) -> DataFrame:
    """``id, type, name[, snippet], rank`` of the best hits; a lower rank is better, ties by id.

    Statistics are those of all records, whatever the type. With ``postings`` (and ``size``) the index is read,
    else the texts are scanned. A query without tokens finds nothing; one that breaks the language raises
    QuerySyntaxError.
    """
    tree = parse(query)
    plan = _Plan(tree)
    if not plan.keys:
        out = entities.filter(F.lit(False)).select("id", "type", "name", F.lit(None).cast("string").alias("snippet"), F.lit(0.0).alias("rank"))
        return out if with_snippet else out.drop("snippet")
    hits = scan_hits(entities, plan.keys) if postings is None else index_hits(postings, plan.keys)
    staged = plan.staged(hits)
    phrases = [(n, i) for n, near in enumerate(plan.leaves) for i in range(len(near.phrases))]
    df = [F.count_if(plan.count(n, i, "s") > 0).alias(f"df{n}_{i}") for n, i in phrases]
    if size is None and postings is None:
        stats = staged.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("length"), *df)
        stats = stats.select(F.struct("*").alias("stats")).scalar()
    else:
        own = size if size is not None else corpus_size(entities)
        whole = own.select(F.struct("n", "length")).scalar()
        stats = staged.agg(*df).select(F.struct(whole["n"].alias("n"), whole["length"].alias("length"), "*").alias("stats")).scalar()
    ok, _ = plan.matches(tree, 0)
    matched = staged.filter(ok).withColumn("stats", stats)
    average = F.col("stats.length") / F.col("stats.n")

    def bm25(n: int, i: int) -> Column:
        seen, total = F.col(f"stats.df{n}_{i}"), F.col("stats.n")
        idf = F.log((total - seen + 0.5) / (seen + 0.5))
        tf = plan.count(n, i, "m")
        return F.when(idf > 0, idf).otherwise(IDF_FLOOR) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / average))

    ranked = matched.withColumn("rank", -plan.scores(tree, 0, bm25)[0])
    places = F.array(*plan.places(tree, 0)).alias("places")
    texts = [] if postings is not None else ["type", "name", "body"]
    ranked = ranked.select("id", "rank", *texts, places)
    if postings is not None:
        if type:  # the type is looked up before the limit, the texts after it
            ranked = ranked.join(entities.filter(F.col("type") == type).select("id"), "id", "left_semi")
        ranked = limited(ranked.orderBy("rank", "id"), limit).join(entities.select("id", "type", "name", "body"), "id")
        best = ranked.orderBy("rank", "id")
    else:
        best = limited((ranked.filter(F.col("type") == type) if type else ranked).orderBy("rank", "id"), limit)
    if not with_snippet:
        return best.select("id", "type", "name", "rank")
    sizes = [len(plan.leaves[n].phrases[i].tokens) for n, i in phrases]
    return best.select("id", "type", "name", snippet_column(F.col("body"), F.col("places"), sizes).alias("snippet"), "rank")
