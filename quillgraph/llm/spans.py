"""Long exact spans shared between records, with a count-min prefilter.

Windows. Every stretch of SPAN characters holds SPAN - GRAM + 1 windows of GRAM characters; the one with the
least hash among them is selected. The choice depends on the characters alone, so two records that share a
stretch select the same window of it: about one window in 26 is enough, and none is lost. With GRAM = SPAN
every window is selected; the result is the same (see the tests, and the README for figures of both).

First pass: every FLUSH windows a partition writes a sparse sketch of what it met: each window once, with the
record or with the mark that several records have it. The sketches are cut into slices by hash, and those of a
slice are merged in a count-min sketch, whose size follows from the windows counted there. A cell can only count
too much, so a window of two records is always estimated as repeated; of the others about one in 20 is, whatever the
size of the input, as slices become more and not fuller. A window in very many records is one entry for each
flush. Nothing is broadcast; 10 bytes are moved for each window.

Second pass: only records with windows estimated as repeated are read again. These windows, with the characters
on both sides that a stretch over them can reach, are grouped exactly, by a 128-bit digest of the window and by the
characters beside it.

Classes. A stretch class is a stretch of SPAN characters or more with all records that hold it. Records with the
same characters on both sides of a window are a class at once, however many they are; only where these
characters differ are the stretches over a window compared. Work and rows are linear in the windows; pairs are
made last, from the classes with different members, for those who ask for pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .rolling import Stretches, code_points

SPAN = 300
GRAM = 250
#: Windows and records of a sparse sketch at most; the record's number is 16 bits.
FLUSH = 1 << 18
FLUSH_RECORDS = (1 << 16) - 1
#: Entries of a slice of the merged sketch, about; cells of a row for each entry, at least.
SLICE = 1 << 21
CELLS = 4

_CHUNK = 1 << 18
_STRANDS = 8  # bits: each sparse sketch is written in 256 parts by hash
_SEVERAL = (1 << 16) - 1  # in place of a record's number: several records of the flush have the window
_ODD = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB]
_RECORDS, _REPEATED = -2, -1  # parts of a flush that are no sketch: its records, and its repeated windows


def _sliding(a: np.ndarray, w: int, op) -> np.ndarray:
    """Minimum or maximum of every ``w`` neighbours: block-wise prefixes and suffixes, linear in the length."""
    n = len(a) - w + 1
    pad = -len(a) % w
    b = np.concatenate([a, np.full(pad, a[-1])]).reshape(-1, w)
    ahead = op.accumulate(b, axis=1).ravel()
    behind = op.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:n], ahead[w - 1 : w - 1 + n])


def _chunks(texts: list[str | None], span: int) -> Iterator[list[tuple[int, int, str]]]:
    """``(index, offset, part)`` in lists of about _CHUNK characters; every stretch of ``span`` lies in one part."""
    held: list[tuple[int, int, str]] = []
    n = 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) - span + 1 if text else 0, _CHUNK):
            held.append((i, at, text[at : at + _CHUNK + span - 1]))
            n += len(held[-1][2])
            if n >= _CHUNK:
                yield held
                held, n = [], 0
    if held:
        yield held


def selected(texts: list[str | None], span: int = SPAN, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index of the text, place and hash of the selected windows; texts shorter than ``span`` have none.

    A window at the seam of two parts of a very long text may come twice.
    """
    w = span - gram + 1
    for held in _chunks(texts, span):
        sizes = np.array([len(x[2]) for x in held])
        ends = np.cumsum(sizes)
        codes = code_points("".join(x[2] for x in held))
        part = np.repeat(np.arange(len(held)), sizes)
        first = Stretches(codes).windows(gram) | np.uint64(1)
        least = _sliding(first, w, np.minimum)
        least[np.arange(span, len(codes) + 1) > ends[part[: len(least)]]] = 0  # stretches over the end of a text
        edge = np.zeros(w - 1, np.uint64)
        at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), w, np.maximum) == first)
        part_at = part[at]
        index, offset = np.array([x[0] for x in held]), np.array([x[1] for x in held])
        yield index[part_at], at - (ends - sizes)[part_at] + offset[part_at], first[at]


def _first_of_runs(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before in some column."""
    fresh = np.ones(len(columns[0]), bool)
    fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return fresh


def sparse_sketches(documents: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """First pass: ``flush, part, records, h, n``; ``h`` and ``n`` are packed hashes and numbers of records.

    Parts 0 to 255 are the sketch: each window of the flush once, by hash. Part _RECORDS has the ids of the records
    by number, part _REPEATED the windows that several records of the flush have, with each of these.
    """
    kind = to_arrow_type(documents.schema["doc_id"].dataType)
    names = ["flush", "part", "records", "h", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        flush, n = TaskContext.get().partitionId() << 32, 0

        def sketch() -> pa.RecordBatch:
            number, h = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((number, h))
            h, number = h[order], number[order]
            keep = _first_of_runs(h, number)
            h, number = h[keep], number[keep]
            starts = np.flatnonzero(_first_of_runs(h))
            counts = np.diff(np.append(starts, len(h)))
            several = np.repeat(counts > 1, counts)
            rows = [(flush, _RECORDS, ids, b"", b"")]
            if several.any():
                rows.append((flush, _REPEATED, None, h[several].tobytes(), number[several].tobytes()))
            one, h = np.where(counts > 1, np.uint16(_SEVERAL), number[starts]), h[starts]
            strand = (h >> np.uint64(64 - _STRANDS)).astype(np.int64)
            edges = np.searchsorted(strand, np.arange((1 << _STRANDS) + 1))
            rows += [(flush, i, None, h[a:b].tobytes(), one[a:b].tobytes()) for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
            columns = zip(zip(*rows), (pa.int64(), pa.int32(), pa.list_(kind), pa.binary(), pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=names)

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for index, _, h in selected(texts, span, gram):
                while len(index):
                    room = FLUSH_RECORDS - len(ids)
                    mine, number = np.unique(index, return_inverse=True)
                    now = number < room
                    held.append(((number[now] + len(ids)).astype(np.uint16), h[now]))
                    ids += keys.take(pa.array(mine[:room])).to_pylist()
                    n += len(held[-1][1])
                    if n >= FLUSH or len(ids) >= FLUSH_RECORDS:
                        yield sketch()
                        held, ids = [], []
                        flush, n = flush + 1, 0
                    index, h = index[~now], h[~now]
        if held:
            yield sketch()

    ddl = f"flush bigint, part int, records array<{documents.schema['doc_id'].dataType.simpleString()}>, h binary, n binary"
    return documents.select("doc_id", "text").mapInArrow(count, ddl)


def estimated_repeated(h: np.ndarray, several: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Which entries of a slice its count-min sketch estimates at two or more; an entry of several counts twice."""
    bits = max(4, (cells * max(1, len(h)) - 1).bit_length())
    out = np.ones(len(h), bool)
    for odd in _ODD:
        at = ((h * np.uint64(odd)) >> np.uint64(64 - bits)).astype(np.int64)
        counts = np.bincount(at, minlength=1 << bits)
        counts += np.bincount(at[several], minlength=1 << bits)
        out &= counts[at] > 1
    return out


def repeated_windows(sketches: DataFrame, n: int, slice_size: int = SLICE, cells: int = CELLS) -> DataFrame:
    """``flush, part (_REPEATED), records (null), h, n``: the windows of the sketches that a slice estimates as repeated.

    ``n`` is the number of entries of all sketches, from which the number of slices follows.
    """
    finer = max(0, (-(-n // slice_size) - 1).bit_length() - _STRANDS)
    shift = np.uint64(64 - _STRANDS - finer)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for flush, h, number in zip(*(c.to_pylist() for c in batch.columns)):
                h, number = np.frombuffer(h, np.uint64), np.frombuffer(number, np.uint16)
                at = (h >> shift).astype(np.int64)
                edges = np.append(np.flatnonzero(_first_of_runs(at)), len(at))
                rows += [(int(at[a]), flush, h[a:b].tobytes(), number[a:b].tobytes()) for a, b in zip(edges, edges[1:])]
            columns = zip(zip(*rows) if rows else [()] * 4, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["slice", "flush", "h", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> pa.RecordBatch:
            h, number = (np.concatenate([np.frombuffer(x[i], t) for x in held]) for i, t in ((1, np.uint64), (2, np.uint16)))
            flush = np.repeat(np.array([x[0] for x in held], np.int64), [len(x[1]) // 8 for x in held])
            keep = estimated_repeated(h, number == _SEVERAL, cells) & (number != _SEVERAL)
            h, number, flush = h[keep], number[keep], flush[keep]
            order = np.argsort(flush, kind="stable")
            h, number, flush = h[order], number[order], flush[order]
            edges = np.append(np.flatnonzero(_first_of_runs(flush)), len(flush)) if len(flush) else [0]
            rows = [(int(flush[a]), h[a:b].tobytes(), number[a:b].tobytes()) for a, b in zip(edges, edges[1:])]
            columns = zip(zip(*rows) if rows else [()] * 3, (pa.int64(), pa.binary(), pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["flush", "h", "n"])

        for batch in batches:
            for slice_, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if slice_ != at:
                    if held:
                        yield done()
                    at, held = slice_, []
                held.append(row)
        if held:
            yield done()

    parts = sketches.filter("part >= 0").select("flush", "h", "n", F.col("part").cast("bigint").alias("slice"))
    if finer:
        parts = parts.select("flush", "h", "n").mapInArrow(cut, "slice bigint, flush bigint, h binary, n binary")
    sliced = parts.select("slice", "flush", "h", "n").repartition("slice").sortWithinPartitions("slice")
    found = sliced.mapInArrow(merge, "flush bigint, h binary, n binary")
    records = F.lit(None).cast(sketches.schema["records"].dataType)
    return found.select("flush", F.lit(_REPEATED).alias("part"), records.alias("records"), "h", "n")


def repeated_by_record(sketches: DataFrame, repeated: DataFrame) -> DataFrame:
    """``doc_id, hashes``: the repeated windows of each record, packed."""
    records = sketches.schema["records"].dataType
    kind = to_arrow_type(records.elementType)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, held = None, None, []

        def done() -> pa.RecordBatch:
            h, number = (np.concatenate([np.frombuffer(x[i], t) for x in held]) for i, t in ((0, np.uint64), (1, np.uint16)))
            order = np.argsort(number, kind="stable")
            h, number = h[order], number[order]
            starts = np.flatnonzero(_first_of_runs(number))
            edges = np.append(starts, len(number))
            packed = [h[a:b].tobytes() for a, b in zip(edges, edges[1:])]
            return pa.RecordBatch.from_arrays([pa.array([ids[k] for k in number[starts].tolist()], kind), pa.array(packed, pa.binary())], names=["doc_id", "hashes"])

        for batch in batches:
            for i, (flush, part) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if flush != at:
                    if held:
                        yield done()
                    at, held = flush, []
                if part == _RECORDS:  # the first of each flush
                    ids = batch.column(2)[i].as_py()
                else:
                    held.append((batch.column(3)[i].as_py(), batch.column(4)[i].as_py()))
        if held:
            yield done()

    rows = sketches.filter("part < 0").unionByName(repeated).repartition("flush").sortWithinPartitions("flush", "part")
    return rows.mapInArrow(resolve, f"doc_id {records.elementType.simpleString()}, hashes binary")


#: Digests: of a window, of a window with what stands beside it, of a stretch over a window; two columns each.
_K, _C, _S = ["k1", "k2"], ["c1", "c2"], ["s1", "s2"]


def candidate_windows(documents: DataFrame, wanted: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Second pass: ``doc_id, k1, k2, c1, c2, left, right, places`` of the windows estimated as repeated.

    ``left`` and ``right`` are up to ``span - gram`` characters beside the window. ``k1, k2`` is the digest of the window,
    ``c1, c2`` that of the window with these. Equal rows of a record (in a run of one character) come out once, with all their places.
    """
    reach = span - gram
    names = ["doc_id", *_K, *_C, "left", "right", "places"]

    def digests(texts: Iterator[str]) -> list[pa.Array]:
        packed = b"".join(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in texts)
        return [pa.array(x) for x in np.frombuffer(packed, np.int64).reshape(-1, 2).T]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(1).to_pylist(), [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
            mine: dict[tuple, set[int]] = {}
            for index, place, h in selected(texts, span, gram):
                edges = np.append(np.flatnonzero(_first_of_runs(index)), len(index)) if len(index) else [0]
                for a, b in zip(edges, edges[1:]):
                    i = int(index[a])
                    text = texts[i]
                    for at in place[a:b][np.isin(h[a:b], lists[i])].tolist():
                        mine.setdefault((i, text[at : at + gram], text[max(0, at - reach) : at], text[at + gram : at + gram + reach]), set()).add(at)
            index, window, left, right = zip(*mine) if mine else [()] * 4
            columns = [batch.column(0).take(pa.array(index, pa.int64())), *digests(window), *digests(f"{len(a)} {a}{x}{b}" for x, a, b in zip(window, left, right))]
            columns += [pa.array(x, pa.string()) for x in (left, right)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([sorted(x) for x in mine.values()], pa.list_(pa.int32()))], names=names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    read = documents.select("doc_id", "text").join(wanted, "doc_id")
    return read.select("doc_id", "text", "hashes").mapInArrow(find, f"doc_id {kind}, k1 bigint, k2 bigint, c1 bigint, c2 bigint, left string, right string, places array<int>")


def _set_hash(*members: str) -> list:
    """Two columns that are equal for equal sets of distinct members."""
    return [F.bit_xor(F.xxhash64(*members)).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), *members)).alias("y")]


class _Shared:
    """Windows of several records, and the stretches over them that several records hold."""

    def __init__(self, documents: DataFrame, materialize, span: int, gram: int, slice_size: int, cells: int):
        reach = self.reach = span - gram
        sketches = materialize(sparse_sketches(documents, span, gram), "sketches")
        n = sketches.filter("part >= 0").agg(F.coalesce(F.sum(F.octet_length("n")), F.lit(0))).first()[0] // 2
        repeated = repeated_windows(sketches, n, slice_size, cells)
        wanted = materialize(repeated_by_record(sketches, repeated), "wanted")
        self.rows = materialize(candidate_windows(documents, wanted, span, gram), "windows")
        # Windows with what stands beside them: reach to both sides, and the least and the greatest record that has them.
        reached = F.max(F.length("left")).alias("l"), F.max(F.length("right")).alias("r")
        beside = self.rows.groupBy(*_K, *_C).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), *reached)
        beside = materialize(beside, "beside").filter(F.col("l") + F.col("r") >= reach)
        self.whole = beside.filter(F.col("a") != F.col("b")).select(*_C, "l", "r")
        several = (F.count(F.lit(1)) > 1) & (F.min("a") != F.max("b"))
        differ = beside.groupBy(*_K).agg(several.alias("differ")).filter("differ").select(*_K)
        over = beside.join(differ, _K).select(*_K, *_C, "a", "b")
        texts = self.rows.select(*_C, "left", "right").join(over.select(*_C), _C, "left_semi").dropDuplicates(_C)
        lengths = F.sequence(F.greatest(F.lit(0), reach - F.length("right")), F.least(F.lit(reach), F.length("left")))
        over = over.join(texts, _C).select("*", F.explode(lengths).alias("l"))
        stretch = F.expr(f"concat(right(left, l), left(right, {reach} - l))")
        digest = F.xxhash64(*_K, "l", stretch).alias("s1"), F.xxhash64(F.lit(7), stretch, "l", *_K).alias("s2")
        over = materialize(over.select(*_C, "a", "b", "l", *digest), "over")
        common = over.groupBy(*_S).agg(F.count(F.lit(1)).alias("n"), several.alias("several"), *_set_hash(*_C))
        common = common.filter("several").select(*_S, "n", "x", "y")
        self.parts = materialize(over.join(common, _S).select(*_C, "l", *_S, "n", "x", "y"), "stretches")


def shared_classes(documents: DataFrame, materialize, span: int = SPAN, gram: int = GRAM, slice_size: int = SLICE, cells: int = CELLS) -> DataFrame:
    """``class_id, doc_id``: stretches of ``span`` characters or more with the records that hold them.

    Of classes with the same records one stands for all. Two records are in a common class if and only if they share
    such a stretch. Null texts and texts shorter than ``span`` are in none, nor are rows without an id; repeated
    rows of one id are one record.
    """
    s = _Shared(documents, materialize, span, gram, slice_size, cells)
    # Neighbouring stretches over a window mostly have the same members.
    one = s.parts.select("n", "x", "y", *_S).dropDuplicates(["n", "x", "y"]).select(*_S)
    ids = ["i1", "i2"]
    named = lambda columns: [F.col(c).alias(i) for c, i in zip(columns, ids)]
    held = s.whole.select(*_C, *named(_C)).unionByName(s.parts.join(one, _S).select(*_C, *named(_S)))
    members = held.join(s.rows.select(*_C, "doc_id"), _C).select(*ids, "doc_id").distinct()
    members = materialize(members, "members")
    sets = members.groupBy(*ids).agg(F.count(F.lit(1)).alias("n"), *_set_hash("doc_id"))
    kept = sets.dropDuplicates(["n", "x", "y"]).select(*ids)
    return members.join(kept, ids).select(F.concat(F.hex("i1"), F.lit("-"), F.hex("i2")).alias("class_id"), "doc_id")


def shared_pairs(classes: DataFrame) -> DataFrame:
    """``doc_id_a, doc_id_b`` (the smaller first) of :func:`shared_classes`: as many rows as there are pairs."""
    a, b = (classes.select("class_id", F.col("doc_id").alias(f"doc_id_{x}")) for x in "ab")
    return a.join(b, "class_id").filter(F.col("doc_id_a") < F.col("doc_id_b")).select("doc_id_a", "doc_id_b").distinct()


def shared_shares(documents: DataFrame, materialize, span: int = SPAN, gram: int = GRAM, slice_size: int = SLICE, cells: int = CELLS) -> DataFrame:
    """``doc_id, n_chars, shared_chars, share`` of every record: how much of it stands elsewhere too.

    Only stretches of ``span`` characters or more count. Null texts have null length and share, empty ones
    share 0. No pair is formed.
    """
    s = _Shared(documents, materialize, span, gram, slice_size, cells)
    # The stretches over a window all hold it, so together they are one, from the farthest left to the farthest right.
    part = s.parts.select(*_C, "l", (F.lit(s.reach) - F.col("l")).alias("r"))
    reached = s.whole.unionByName(part).groupBy(*_C).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    found = s.rows.select("doc_id", *_C, "places").join(reached, _C).select("doc_id", "l", "r", F.explode("places").alias("at"))
    parts = found.select("doc_id", (F.col("at") - F.col("l")).alias("start"), (F.col("at") + gram + F.col("r")).alias("end")).distinct()
    before = F.max("end").over(Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))))
    covered = parts.select("doc_id", fresh.alias("fresh")).groupBy("doc_id").agg(F.sum("fresh").alias("shared_chars"))
    docs = documents.select("doc_id", F.length("text").cast("bigint").alias("n_chars"))
    shared = F.coalesce("shared_chars", F.lit(0))
    share = F.when(F.col("n_chars").isNull(), None).when(F.col("n_chars") == 0, 0.0).otherwise(shared / F.col("n_chars"))
    return docs.join(covered, "doc_id", "left").select("doc_id", "n_chars", shared.alias("shared_chars"), share.alias("share"))
