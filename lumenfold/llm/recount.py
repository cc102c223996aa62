"""Edit-aware token counts.

A document keeps a segment tree over its pre-tokens; nodes hold the sums of characters and tokens. An edit
finds its place by the sums of characters, splits again only the pre-tokens that it touches and a few
characters before, until the new boundaries meet the old ones, encodes what is new, and updates the sums on
the paths above the leaves that changed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import CACHE, CHARS, Cache, Ranks, Splitter
from .common import empty_if_null

#: A pre-token is decided by so many characters after it at most.
CONTEXT = 3


class CountTree:
    """Leaves are the pre-tokens at first; a leaf that edits touch may hold several pieces, or none. ``leaves``
    has the characters and the tokens of each pre-token of the text; pieces are cut out only where an edit
    needs them."""

    def __init__(self, text: str, leaves: np.ndarray):
        self.text, self.n = text, len(leaves)
        self.width = 1 << max(0, (self.n - 1).bit_length())
        self.chars, self.tokens = self._sums(leaves[:, 0]), self._sums(leaves[:, 1])
        self.sizes, self.starts = leaves[:, 0], None
        self.changed: dict[int, list[str]] = {}
        self.encoded = 0

    def _sums(self, level: np.ndarray) -> np.ndarray:
        """Node 1 is the root, nodes 2k and 2k + 1 are below node k."""
        sums = np.zeros(2 * self.width, np.int64)
        sums[self.width : self.width + self.n] = level
        lo = self.width
        while lo > 1:
            sums[lo // 2 : lo] = sums[lo : 2 * lo].reshape(-1, 2).sum(1)
            lo //= 2
        return sums

    def _put(self, sums: np.ndarray, leaf: int, value: int) -> None:
        node = self.width + leaf
        step = value - int(sums[node])
        while node and step:
            sums[node] += step
            node >>= 1

    def pieces(self, leaf: int) -> list[str]:
        got = self.changed.get(leaf)
        if got is None:
            if self.starts is None:
                self.starts = np.cumsum(self.sizes) - self.sizes
            start = int(self.starts[leaf])
            got = [self.text[start : start + int(self.sizes[leaf])]]
        return got

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character, and where it starts; the last with text, if there is none."""
        node, start = 1, 0
        place = min(place, int(self.chars[1]) - 1)
        while node < self.width:
            node *= 2
            left = int(self.chars[node])
            if place - start >= left:
                start += left
                node += 1
        return node - self.width, start

    def edit(self, start: int, end: int, text: str, split) -> None:
        """Replaces the characters from start to end; both are cut to the document."""
        whole = int(self.chars[1])
        start = min(max(start, 0), whole)
        end = min(max(end, start), whole)
        if not self.n:  # an empty text has one leaf, without a piece
            self.n = 1
        first, at = self.find(max(0, start - CONTEXT)) if whole else (0, 0)
        last, _ = self.find(end) if whole else (0, 0)
        reach = 2
        while True:
            stop = min(self.n, last + reach)
            old = [self.pieces(leaf) if self.chars[self.width + leaf] else [] for leaf in range(first, stop)]
            joined = "".join([p for x in old for p in x])
            new = joined[: start - at] + text + joined[end - at :]
            pieces = split(new)
            if stop == self.n:
                break
            # boundaries of leaves after the edit, moved by its change of length
            moved = len(text) - (end - start)
            ends, k = {}, at
            for i, x in enumerate(old, first):
                k += sum(map(len, x))
                if k >= end:
                    ends[k - at + moved] = i + 1
            k, cut = 0, None
            for n, p in enumerate(pieces):
                k += len(p)
                if k in ends and k <= len(new) - CONTEXT and k >= start - at + len(text):
                    cut = n + 1, ends[k]
                    break
            if cut:
                pieces, stop = pieces[: cut[0]], cut[1]
                break
            reach *= 2
        self.encoded += len(pieces)
        for i in range(first, stop):
            self.changed[i] = []
            self._put(self.chars, i, 0)
        self.changed[first] = pieces
        self._put(self.chars, first, sum(map(len, pieces)))

    def count(self, sizes) -> int:
        """Tokens of the document; only changed leaves are looked up."""
        for i, pieces in self.changed.items():
            self._put(self.tokens, i, sum(map(sizes, pieces)))
        return int(self.tokens[1])


class Counter:
    """Characters and tokens of pre-tokens, kept by the worker."""

    def __init__(self, content: bytes, pattern: str):
        self.ranks, self.split = Ranks(content), regex.compile(pattern).findall
        self.whole, self.pieces = Splitter(pattern, self._leaves), Cache(CACHE // 16)

    def _leaves(self, pieces: list[str]) -> list[bytes]:
        """(characters, tokens) of each pre-token as two 32-bit numbers."""
        sizes = [len(x) // 4 for x in self.ranks.merge([p.encode() for p in pieces])]
        flat = np.array([[len(p) for p in pieces], sizes], "<i4").T.tobytes()
        return [flat[k : k + 8] for k in range(0, len(flat), 8)]

    def trees(self, texts: list[str]) -> list[CountTree]:
        return [CountTree(t, np.frombuffer(raw, "<i4").reshape(-1, 2)) for t, raw in zip(texts, self.whole.ids(texts), strict=True)]

    def learn(self, pieces: set[str]) -> dict[str, int]:
        """Tokens of pieces that edits have made."""
        kept = self.pieces
        new = [p for p in pieces if p not in kept and p not in kept.old]
        found = {p: len(x) // 4 for p, x in zip(new, self.ranks.merge([p.encode() for p in new]), strict=True)}
        found.update((p, kept[p]) for p in pieces - found.keys())
        kept.update((p, found[p]) for p in new if len(p) <= 64)
        kept.turn()
        return found


_counters: dict = {}


def counter(content: bytes, pattern: str) -> Counter:
    key = (hashlib.md5(content).digest(), pattern)
    if key not in _counters:
        _counters[key] = Counter(content, pattern)
    return _counters[key]


def recount(own: Counter, texts: list[str], edits: list[list[tuple[int, int, str]]]) -> list[tuple[int, int, int, int, int]]:
    """(tokens, pre-tokens, tokens after, characters after, pre-tokens encoded for the edits) of each text."""
    trees = own.trees(texts)
    before = [(int(tree.tokens[1]), tree.n) for tree in trees]
    for tree, todo in zip(trees, edits, strict=True):
        for start, end, text in todo:
            tree.edit(start, end, text, own.split)
    sizes = own.learn({p for tree in trees for x in tree.changed.values() for p in x}).__getitem__
    return [(n, pieces, tree.count(sizes), int(tree.chars[1]), tree.encoded) for tree, (n, pieces) in zip(trees, before, strict=True)]


def edited_counts(docs: DataFrame, edits: Column, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_pretokens, n_tokens_after, n_chars_after, n_encoded) of every row, without a shuffle.

    ``edits`` is a column array<struct<start, end, text>> of ``docs``: edits in their order, each in characters
    of the text that the ones before left. Ends beyond the text are cut to it, an end before its start is
    its start, null bounds are 0, a null replacement is empty; null edits, and null texts, are none. Repeated
    rows are edited each for itself; other columns are not read; an empty table gives no rows.
    """
    with open(ranks_path, "rb") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary
    source = docs.select(F.col(id_col).alias("id"), empty_if_null(text_col).alias("t"), F.coalesce(edits, F.array()).alias("edits"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(blob.value, pattern)
        for batch in it:
            texts, todo = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            todo = [[(e["start"] or 0, e["end"] or 0, e["text"] or "") for e in x if e] for x in todo]
            out, k = [], 0
            while k < len(texts):
                n, chars = k, 0
                while n < len(texts) and (n == k or chars + len(texts[n]) <= CHARS // 2):
                    chars += len(texts[n])
                    n += 1
                out += recount(own, texts[k:n], todo[k:n])
                k = n
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), pa.int64()) for c in cols]], names=["id", "a", "b", "c", "d", "e"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, a bigint, b bigint, c bigint, d bigint, e bigint").toDF(id_col, "n_tokens", "n_pretokens", "n_tokens_after", "n_chars_after", "n_encoded")


def revision(text_col: str = "text") -> Column:
    """A revision of any text: a heading before it, a deletion after a quarter, a word doubled in the middle,
    a replacement near the end."""
    t = empty_if_null(text_col)
    n = F.length(t).cast("bigint")

    def edit(start: Column, end: Column, text: Column) -> Column:
        return F.struct(F.floor(start).cast("bigint").alias("start"), F.floor(end).cast("bigint").alias("end"), text.alias("text"))

    word = F.substring(t, (n / 2).cast("int"), F.lit(8))
    return F.array(edit(F.lit(0), F.lit(0), F.lit("Revised:\n")), edit(9 + n / 4, 9 + n / 4 + 20, F.lit("")), edit(n / 2, n / 2, word), edit(3 * n / 4, 3 * n / 4 + 5, F.lit(" 2nd edition's ")))


def op5_edited_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after a revision."""
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return edited_counts(docs, revision(), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
