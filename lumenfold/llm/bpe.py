"""Byte-level BPE by rank files: a segment tree over byte positions holds the leftmost least pair rank.

Every node of the tree keeps the minimum of ``rank * width + position`` over its positions, so the root is
the leftmost pair of least rank. A merge changes the pairs of the merged position and of its live left
neighbour and kills the right position: three leaves, each with one path to the root. Short pre-tokens are
merged many at a time, one tree a row of a matrix; long ones one at a time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import empty_if_null

NONE = 2**31 - 1
#: Pre-tokens of more bytes are merged one by one.
ROW_BYTES = 1024
#: Entries that a worker keeps of chunks and of pre-tokens; the older half goes when it is full.
CACHE = 600_000
#: The pattern that chunks and plain words are known for; texts go through any other one whole.
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Marks that end a word's chunk most often.
MARKS = tuple(",.;:!?")
#: Characters of text that a worker holds split at a time.
CHARS = 2_000_000


class Ranks:
    """The rank file as arrays: bytes of each id, and a hash table from a pair of ids to the id of both."""

    def __init__(self, content: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.byte_ids < 0).any():
            raise ValueError("the rank file lacks single bytes")
        pairs = {(a << 32) | b: rank for token, rank in self.ranks.items() for k in range(1, len(token)) if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None}
        self.pairs = pairs
        keys = np.fromiter(pairs, np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int64, len(pairs))
        self.bits = max(8, int(4 * len(pairs) + 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.found = np.full(1 << self.bits, -1, np.int64)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = keys[left[free]]
            won = self.slots[at] == keys[left]
            self.found[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that each pair merges into, or -1."""
        keys = (a.astype(np.int64) << 32) | b
        at = self._slot(keys)
        out = np.where(self.slots[at] == keys, self.found[at], -1)
        open_ = np.flatnonzero((self.slots[at] != keys) & (self.slots[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.slots[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.found[at[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out

    def merge_one(self, word: bytes) -> list[int]:
        """One tree; for long words, whose merges cost a path of nodes each."""
        n, width = len(word), 1
        while width < n:
            width *= 2
        ids = [int(self.byte_ids[b]) for b in word]
        right, left, pairs = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs
        none = 2**62
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = pairs.get((ids[i] << 32) | ids[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = width + i
            tree[node] = value
            while node > 1:
                node >>= 1
                best = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == best:
                    return
                tree[node] = best

        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            gone, before = right[i], left[i]
            after = right[gone]
            ids[i], ids[gone], right[i] = rank, -1, after
            put(gone, none)
            got = None
            if after < n:
                left[after] = i
                got = pairs.get((rank << 32) | ids[after])
            put(i, none if got is None else got * width + i)
            if before >= 0:
                got = pairs.get((ids[before] << 32) | rank)
                put(before, none if got is None else got * width + before)
        return [x for x in ids if x >= 0]

    def _merge_rows(self, words: list[bytes], width: int) -> list[bytes]:
        n, shift = len(words), width.bit_length() - 1
        lens = np.fromiter(map(len, words), np.int64, n)
        flat = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        col = np.arange(width)
        inside = col < lens[:, None]
        ids = np.full((n, width), -1, np.int32)
        ids[inside] = flat
        right = np.where(col + 1 < lens[:, None], col + 1, width).astype(np.int32)
        left = np.broadcast_to((col - 1).astype(np.int32), (n, width)).copy()
        tree = np.full((n, 2 * width), NONE, np.int32)
        rows, at = np.nonzero(col[:-1] + 1 < lens[:, None]) if width > 1 else (np.empty(0, int),) * 2
        rank = self.pair(ids[rows, at], ids[rows, at + 1])
        ok = rank >= 0
        tree[rows[ok], width + at[ok]] = (rank[ok] << shift) | at[ok]
        for level in range(shift - 1, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        act = np.arange(n)
        while len(act):
            root = tree[act, 1]
            live = root < NONE
            act, root = act[live], root[live]
            if not len(act):
                break
            pos, rank = root & (width - 1), root >> shift
            gone, before = right[act, pos], left[act, pos]
            after = right[act, gone]
            ids[act, pos] = rank
            ids[act, gone] = -1
            right[act, pos] = after
            tree[act, width + gone] = NONE
            key = np.full(len(act), NONE, np.int32)
            k = np.flatnonzero(after < width)
            left[act[k], after[k]] = pos[k]
            got = self.pair(rank[k], ids[act[k], after[k]])
            key[k] = np.where(got >= 0, (got << shift) | pos[k], NONE)
            tree[act, width + pos] = key
            k = np.flatnonzero(before >= 0)
            got = self.pair(ids[act[k], before[k]], rank[k])
            tree[act[k], width + before[k]] = np.where(got >= 0, (got << shift) | before[k], NONE)
            row = np.concatenate([act, act, act[k]])
            node = np.concatenate([pos, gone, before[k]]) + width
            for _ in range(shift):
                node >>= 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
        kept = ids >= 0
        flat = ids[kept].astype("<u4").tobytes()
        ends = (4 * np.cumsum(kept.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as little-endian 32-bit numbers."""
        out: list = [None] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if (whole := self.ranks.get(w)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif not w:
                out[i] = b""
            elif len(w) > ROW_BYTES:
                out[i] = np.array(self.merge_one(w), "<u4").tobytes()
            else:
                by_width.setdefault(max(4, 1 << (len(w) - 1).bit_length()), []).append(i)
        for width, which in by_width.items():
            step = max(1, (1 << 19) // width)
            for k in range(0, len(which), step):
                part = which[k : k + step]
                for i, ids in zip(part, self._merge_rows([words[i] for i in part], width), strict=True):
                    out[i] = ids
        return out


class Cache(dict):
    """Two generations: when the young one is full it becomes the old one; what is used again is kept."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most // 2, {}

    def __missing__(self, key):
        value = self.old[key]
        self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class Splitter:
    """Ids of texts as little-endian 32-bit bytes, by chunks between single spaces and line ends.

    A space or line end between two printable characters that are no white space always begins a new
    pre-token, so such chunks (with their space, or with their line end) can be encoded apart and kept; any
    other run of chunks goes through the pattern with the chunks beside it.
    """

    def __init__(self, pattern: str, encode, cache: int = CACHE):
        self.find, self.encode, self.known = regex.compile(pattern).findall, encode, pattern == KNOWN_PATTERN
        self.marks: dict[str, bytes] = {}
        self.words, self.first, self.later = Cache(CACHE // 6), Cache(CACHE // 16), Cache(cache)

    def cut(self, text: str) -> list[str]:
        """The pre-tokens. One word of letters, with or without a space or line end before and a mark after, is plain."""
        word = text[1:] if text[:1] == " " else text
        if word.isalpha():
            return [text]
        if word[-1:] in MARKS and word[:-1].isalpha():
            return [text[:-1], text[-1]]
        if word[:1] == "\n" and text[0] == "\n":
            if (line := text[1:]).isalpha():
                return ["\n", line]
            if line[-1:] in MARKS and line[:-1].isalpha():
                return ["\n", line[:-1], line[-1]]
        return self.find(text)

    def _whole(self, texts: list[str]) -> list[bytes]:
        split = list(map(self.cut if self.known else self.find, texts))
        new = [w for w in set(chain.from_iterable(split)) if w not in self.words and w not in self.words.old]
        extra = {}
        for w, ids in zip(new, self.encode(new) if new else (), strict=True):
            (self.words if len(w) <= 64 else extra)[w] = ids
        get = (lambda w: extra[w] if len(w) > 64 else self.words[w]) if extra else self.words.__getitem__
        return [b"".join(map(get, x)) for x in split]

    @staticmethod
    def _plain(chunk: str) -> bool:
        edges = (chunk[1:2] if chunk[:1] == "\n" else chunk[:1], chunk[-1:])
        return all(c.isprintable() and not c.isspace() for c in edges) and "" not in edges

    def _words(self, cores: set[str], marked: list[str]) -> None:
        """Keeps chunks that are a word of letters, and such with a mark after it."""
        later, old = self.later, self.later.old
        ends = [x[:-1] for x in marked]
        cores.update([x for x in ends if x not in later and x not in old])
        cores = list(cores)
        later.update(zip(cores, self.encode([" " + x for x in cores]) if cores else (), strict=True))
        if not self.marks:
            self.marks.update(zip(MARKS, self.encode(list(MARKS)), strict=True))
        for x, word in zip(marked, ends, strict=True):
            later[x] = later[word] + self.marks[x[-1]]

    def ids(self, texts: list[str]) -> list[bytes]:
        if not self.known:
            return self._whole(texts)
        keys, codes, at = chunks(texts)
        later, old, first = self.later, self.later.old, self.first
        heads = [keys[k] for k in codes[at[:-1]].tolist()]
        follows = np.ones(len(codes), bool)
        follows[at[:-1]] = False
        used = np.zeros(len(keys), bool)
        used[codes[follows]] = True
        found = list(map(later.get, keys))
        gaps = [k for k in np.flatnonzero(used).tolist() if found[k] is None]
        missed = list(map(keys.__getitem__, gaps))
        kept = list(map(old.get, missed)) if old else [None] * len(missed)
        later.update([(x, ids) for x, ids in zip(missed, kept, strict=True) if ids is not None])
        cores, marked, fresh = set(), [], []
        for x in [x for x, ids in zip(missed, kept, strict=True) if ids is None]:
            if x.isalpha():
                cores.add(x)
            elif x[-1:] in MARKS and x[:-1].isalpha():
                marked.append(x)
            elif self._plain(x):
                fresh.append(x)
        self._words(cores, marked)
        later.update(zip(fresh, self._whole([x if x[0] == "\n" else " " + x for x in fresh]), strict=True))
        starts = [x for x in set(heads) if x not in first and x not in first.old and self._plain(x) and x[0] != "\n"]
        first.update(zip(starts, self._whole(starts), strict=True))
        for k, ids in zip(gaps, map(later.get, missed), strict=True):
            found[k] = ids
        lead = [first.get(x) or first.old.get(x) for x in heads]
        unknown = np.zeros(len(keys), bool)
        unknown[[k for k in gaps if found[k] is None]] = True
        unknown = unknown[codes] & follows
        at = at.tolist()
        unknown[[k for k, ids in zip(at, lead, strict=False) if ids is None]] = True
        odd, segments, holes = np.flatnonzero(unknown), [], []
        # what is not plain goes through the pattern with its neighbours in the text; beyond them every boundary holds
        text = (np.searchsorted(at, odd, "right") - 1).tolist()
        odd, n = odd.tolist(), 0
        while n < len(odd):
            own = text[n]
            lo, hi, n = max(at[own], odd[n] - 1), odd[n] + 1, n + 1
            while n < len(odd) and text[n] == own and odd[n] - 1 <= hi:
                hi, n = odd[n] + 1, n + 1
            hi = min(hi, at[own + 1] - 1)
            part = [y if y[:1] == "\n" else " " + y for y in map(keys.__getitem__, codes[lo : hi + 1].tolist())]
            if lo == at[own]:
                part[0] = heads[own]
            segments.append("".join(part))
            holes.append((lo, len(part)))
        place = codes.astype(np.int64)
        place[at[:-1]] = np.arange(len(keys), len(keys) + len(heads))
        parts = [ids or b"" for ids in chain(found, lead)]
        for (lo, n), ids in zip(holes, self._whole(segments), strict=True):
            place[lo : lo + n] = -1
            place[lo] = len(parts)
            parts.append(ids)
        parts.append(b"")  # where -1 points
        out = [x.tobytes() for x in gathered(parts, place, at, "<u4")]
        for x in [x for x in chain(cores, marked, fresh) if len(x) > 64]:
            later.pop(x, None)
        for x in [x for x in starts if len(x) > 64]:
            first.pop(x, None)
        for cache in (self.words, first, later):
            cache.turn()
        return out


def chunks(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(different chunks, the chunk at each place, the first place of each text and the end) of texts cut before every
    line end and at every space, which is left out. Cut and numbered by Arrow: Python sees each different chunk once."""
    cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
    coded = cut.flatten().dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), cut.offsets.to_numpy()


def gathered(parts: list[bytes], place: np.ndarray, at: list[int], kind: str) -> list[np.ndarray]:
    """The numbers of the parts at the given places, joined between every two of ``at``."""
    size = np.fromiter(map(len, parts), np.int64, len(parts)) // np.dtype(kind).itemsize
    start, n = np.cumsum(size) - size, size[place]
    ends = np.concatenate([[0], np.cumsum(n)])
    numbers = np.frombuffer(b"".join(parts), kind)[np.repeat(start[place] - ends[:-1], n) + np.arange(ends[-1])]
    return [numbers[a:b] for a, b in pairwise(ends[at].tolist())]


def batches(texts: Iterable[str | None] | pa.Array, chars: int = CHARS) -> Iterator[list[str]]:
    """Groups of texts of about so many characters; a longer text is a group of its own. Of an Arrow array one group
    at a time becomes Python strings."""
    group, held = [], 0
    for t in texts:
        t = (t.as_py() if isinstance(t, pa.Scalar) else t) or ""
        if group and held + len(t) > chars:
            yield group
            group, held = [], 0
        group.append(t)
        held += len(t)
    if group:
        yield group


_codecs: dict = {}


def codec(content: bytes, pattern: str) -> tuple[Ranks, Splitter]:
    """The tables and caches of this worker, built once for a rank file."""
    key = (hashlib.md5(content).digest(), pattern)
    if key not in _codecs:
        ranks = Ranks(content)
        _codecs[key] = ranks, Splitter(pattern, lambda words: ranks.merge([w.encode() for w in words]))
    return _codecs[key]


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, ids: bool = False) -> DataFrame:
    """Encodes whole texts and decodes the ids again: one row a document, without a shuffle.

    Returns id_col and ``keep``, then n_tokens, ids_sha256 (of the decimal ids joined by one space),
    decoded_sha256 and, if asked for, token_ids array<int>. A null text counts as the empty text: no ids, and
    the digests of nothing. Repeated rows and ids are encoded each for itself; an empty table gives no rows;
    other columns of ``docs`` are not read. The rank file is read on the driver and broadcast: its size is
    that of a vocabulary.
    """
    with open(ranks_path, "rb") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())
    names = [id_col, *(keep or [])]
    source = docs.select(*names, empty_if_null(text_col).alias("__text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, split = codec(blob.value, pattern)
        decimal, token = [str(i) for i in range(len(ranks.tokens))], ranks.tokens
        sha = hashlib.sha256
        for batch in it:
            at = 0
            for group in batches(batch.column(len(names))):
                n, digest, back, raws = [], [], [], split.ids(group)
                for raw in raws:
                    row = np.frombuffer(raw, "<u4").tolist()
                    n.append(len(row))
                    digest.append(sha(" ".join(map(decimal.__getitem__, row)).encode()).hexdigest())
                    back.append(sha(b"".join(map(token.__getitem__, row))).hexdigest())
                own = batch.slice(at, len(group))  # rows leave as soon as they are encoded, ids as packed as they are
                columns = [*own.columns[: len(names)], pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.frombuffer(b"".join(raws), "<i4"))))
                at += len(group)
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_tokens", "ids_sha256", "decoded_sha256", *(["token_ids"] if ids else [])])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kinds}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if ids else ""))


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's text through the 50k byte vocabulary and back."""
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bpe_round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", F.col("n_tokens").alias("n_ids"))
