"""Encoding of the whole corpus with a public byte-level BPE tokenizer, by tree concatenation.

A text longer than a leaf is halved, wherever the cut falls, and the ids of two halves are joined by encoding a
window around the cut again. The window grows to twice as many ids each time until both sides agree with it:

* at an edge where the pattern always splits (between characters of two kinds, but for a space before a word and an
  apostrophe before a letter), for there every encoding splits;
* or, inside a run that the pattern does not split, at an edge where the two ids beside it, encoded together, come out
  as the same two ids: a sequence of ids in which all neighbours do so is the encoding of the run.

So the result is exact, and each join is local: a few ids in ordinary text, and in a run without any break as far
as merges reach. All texts take this path, by the same rule at every size; a text within a leaf is a tree of one
leaf. Texts over PART_CHARS are halved into parts that several tasks encode, and their ids are joined by the same tree.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary files lie; a parameter of every function here.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which byte-level BPE of this vocabulary splits a text first.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a leaf of the tree, which is encoded at once.
LEAF_CHARS = 2048
#: Characters that one task encodes of a text, at most.
PART_CHARS = 1 << 18
#: Ids on each side of a join that are encoded again first.
FIRST_WINDOW = 8

_SPLIT = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
#: Between which characters no piece of the pattern reaches: letters, numbers, white space and signs end at another kind,
#: but a space goes with what follows, and an apostrophe may begin a contraction.
_ALWAYS = (
    r"(?<=\P{White_Space})(?=\p{White_Space})|(?<=\p{L})(?=[^\p{L}\p{White_Space}])|(?<=\p{N})(?=[^\p{N}\p{White_Space}])"
    r"|(?<=[^\p{L}\p{N}\p{White_Space}])(?=\p{N})|(?<=[^\p{L}\p{N}\p{White_Space}'])(?=\p{L})"
)
_SAFE = regex.compile(_ALWAYS)
_LAST_SAFE = regex.compile("(?r)" + _ALWAYS)
_SPACE = regex.compile(r"\p{White_Space}")
#: A stretch of one kind of characters, which the pattern never splits in its middle.
_ONE_KIND = regex.compile(r"\p{L}{2,}|\p{N}{2,}|[^\p{White_Space}\p{L}\p{N}]{2,}|\p{White_Space}{2,}")


def halves(text: str, size: int) -> list[str]:
    """The text halved until no part has more than ``size`` characters."""
    if len(text) <= size:
        return [text]
    middle = len(text) // 2
    return halves(text[:middle], size) + halves(text[middle:], size)


class Encoder:
    def __init__(self, path: str = TOKENIZER, leaf_chars: int = LEAF_CHARS):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bpe = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {v: k for k, v in ranks.items()}
        if not {b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d"} <= ranks.keys():  # a join must not cut in their middle
            raise ValueError("the vocabulary lacks the contractions of the pattern")
        self.inside = frozenset(i for i, b in self.bytes.items() if 0x80 <= b[0] < 0xC0)  # ids that begin within a character
        self.leaf = max(1, leaf_chars)
        self.agree = lru_cache(1 << 16)(self._agree)

    def _agree(self, a: int, b: int) -> bool:
        return self.bpe._encode_single_piece(self.bytes[a] + self.bytes[b]) == [a, b]

    def _data(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def _tail(self, ids: list[int], n_bytes: int) -> int:
        """How many ids make up the last ``n_bytes``; an edge that every encoding has lies there."""
        n = 0
        while n_bytes > 0:
            n += 1
            n_bytes -= len(self.bytes[ids[-n]])
        assert n_bytes == 0
        return n

    def _head(self, ids: list[int], n_bytes: int) -> int:
        n = 0
        while n_bytes > 0:
            n_bytes -= len(self.bytes[ids[n]])
            n += 1
        assert n_bytes == 0
        return n

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the concatenation of two texts from the ids of each."""
        if not left or not right:
            return left + right
        k = FIRST_WINDOW
        while True:
            a, b = max(0, len(left) - k), min(k, len(right))
            while a and left[a] in self.inside:
                a -= 1
            while b < len(right) and right[b] in self.inside:
                b += 1
            before, after = self._data(left[a:]).decode(), self._data(right[:b]).decode()
            # an edge on the left: the begin of the text, a place that always splits, or one within a run
            start = 0 if a == 0 else m.start() if (m := _LAST_SAFE.search(before)) else None
            if _SAFE.search(before[-1] + after[0]):
                return left + right  # the cut itself always splits
            stop = len(after) if b == len(right) else m.start() if (m := _SAFE.search(after)) else None
            runs_left = start is None and _ONE_KIND.fullmatch(before)
            runs_right = stop is None and _ONE_KIND.fullmatch(after)
            if runs_right and _SPACE.match(after):  # the last of white space goes with what follows
                runs_right = _SPACE.match(self._data(right[b : b + 4]).decode(errors="ignore"))
            if (start is not None or runs_left) and (stop is not None or runs_right):
                text = before[start or 0 :] + (after if stop is None else after[:stop])
                cut = len(before) - (start or 0)
                pieces = [m.span() for m in _SPLIT.finditer(text)]
                # within a run, the first piece must reach over the cut, or the last from before it to the end
                if (not runs_left or pieces[0][1] > cut) and (not runs_right or pieces[-1][0] < cut):
                    mid = [i for x, y in pieces for i in self.bpe._encode_single_piece(text[x:y].encode())]
                    low = a if runs_left else len(left) - self._tail(left, len(before[start:].encode()))
                    high = b if runs_right else self._head(right, len(after[:stop].encode()))
                    if (not runs_left or self.agree(left[low - 1], mid[0])) and (not runs_right or self.agree(mid[-1], right[high])):
                        return left[:low] + mid + right[high:]
            k *= 2

    def tree(self, parts: list[list[int]]) -> list[int]:
        """Ids of a text from those of its halves' halves, joined as they were halved."""
        if len(parts) <= 1:
            return parts[0] if parts else []
        middle = (len(parts) + 1) // 2
        return self.join(self.tree(parts[:middle]), self.tree(parts[middle:]))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null and empty. The strings of special tokens are ordinary text."""
        if not text:
            return []
        if len(text) <= self.leaf:
            return self.bpe.encode_ordinary(text)
        return self.tree([self.bpe.encode_ordinary(x) for x in halves(text, self.leaf)])


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(*args) -> Encoder:
    """One encoder per Python worker and parameters."""
    if args not in _ENCODERS:
        _ENCODERS[args] = Encoder(*args)
    return _ENCODERS[args]


def _ids(values: list[list[int]]) -> pa.Array:
    return pa.array(values, pa.list_(pa.int32()))


def encode_corpus(
    documents: DataFrame,
    materialize,
    tokenizer: str = TOKENIZER,
    part_chars: int = PART_CHARS,
    leaf_chars: int = LEAF_CHARS,
    key: str = "doc_id",
) -> DataFrame:
    """``doc_id, ids`` of every row: the empty list for empty and null texts. Repeated rows come out repeated.

    The texts are read once. A text over ``part_chars`` leaves its row without ids and with its parts; only these
    are moved, to the tasks that encode them, and their ids back to one row, which the result demands.
    """
    args = (tokenizer, leaf_chars)
    kind = documents.schema[key].dataType.simpleString()
    names = [key, "ids", "row", "part", "text"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, row = encoder(*args), TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                out = []
                for i, text in enumerate(b.column(1).to_pylist()):
                    if text is None or len(text) <= part_chars:
                        out.append((i, enc.encode(text), None, None, None))
                    else:
                        row += 1
                        out += [(i, None, row, n, x) for n, x in enumerate(halves(text, part_chars))]
                index, ids, rows, parts, texts = zip(*out)
                columns = [b.column(0).take(pa.array(index)), _ids(ids), pa.array(rows, pa.int64()), pa.array(parts, pa.int32()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*args)
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns[:3], _ids([enc.encode(batch.column(3)[i].as_py())])], names=[key, "row", "part", "ids"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*args)
        for batch in batches:
            for i in range(batch.num_rows):
                parts = [p["ids"] for p in batch.column(1)[i].as_py()]
                yield pa.RecordBatch.from_arrays([batch.slice(i, 1).column(0), _ids([enc.tree(parts)])], names=[key, "ids"])

    once = documents.select(key, "text").mapInArrow(read, f"{key} {kind}, ids array<int>, row bigint, part int, text string")
    once = materialize(once, "ids")
    parts = once.filter(F.col("part").isNotNull()).select(key, "row", "part", "text").repartition("row", "part")
    pieces = parts.mapInArrow(encode, f"{key} {kind}, row bigint, part int, ids array<int>")
    ordered = F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("parts")
    whole = pieces.groupBy("row").agg(F.first(key).alias(key), ordered).select(key, "parts")
    direct = once.filter(F.col("part").isNull()).select(key, "ids")
    return direct.unionByName(whole.mapInArrow(assemble, f"{key} {kind}, ids array<int>"))
