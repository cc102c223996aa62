"""Units of text that may repeat: paragraphs, and content-defined windows of words, found with arrays only.

A paragraph is a line of enough words. A window is a run of WINDOW words that begins at an anchor; an anchor
is a position whose three-word hash is the least of some GAP positions in a row, so where windows begin
depends on the words around alone. Any run of WINDOW + GAP - 1 words or more that two texts share holds an
anchor whose whole window is shared, wherever the run lies and whatever line ends it crosses.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .minhash import SHINGLE, multipliers

#: Words of a window, and positions of which one at least is an anchor: shared runs of 50 words are found.
WINDOW, GAP = 24, 27
#: Words that an anchor is chosen by.
ANCHOR = 3
#: Bytes of text that are taken at a time; a longer text is taken alone.
BYTES = 1 << 20

U = np.uint64
G, G_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += U(32)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> U(32))


def _numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U(G) + U(seed)) | U(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(1, n), np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * U(pow(base, done, 2**64))
        done += step
    return out


class Tables:
    """Multipliers of bytes and of words, made longer as texts need it."""

    def __init__(self):
        self.byte, self.power, self.inverse = _numbers(1 << 10, 7), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def bytes(self, n: int) -> np.ndarray:
        if n > len(self.byte):
            self.byte = _numbers(2 * n, 7)
        return self.byte

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.power):
            self.power, self.inverse = _powers(G, 2 * n), _powers(G_INVERSE, 2 * n)
        return self.power, self.inverse


_tables = Tables()


@dataclass
class Words:
    """All words of some texts: where they start and end (in bytes), their hashes, and whose they are."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    line: np.ndarray
    first: np.ndarray  # first word of each text, and one more


def _hashed(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of bytes in which texts begin at the places ``begins``."""
    space = SPACE[data]
    begin = ~space
    begin[1:] &= space[:-1]
    begins = begins[begins < len(data)]
    begin[begins] = ~space[begins]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return starts, starts, np.empty(0, np.uint64)
    solid = np.flatnonzero(~space)
    lead = np.searchsorted(solid, starts)
    sizes = np.diff(np.append(lead, len(solid)))
    values = (LOWER[data[solid]] + U(1)) * _tables.bytes(int(sizes.max()))[solid - np.repeat(starts, sizes)]
    return starts, starts + sizes, mix(np.add.reduceat(values, lead))


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the texts data[offsets[k]:offsets[k + 1]], with A-Z lower-cased in the hashes."""
    parts, at = [], 0
    while at < len(data):  # a long text goes in pieces that end where a word does
        stop = min(at + 4 * BYTES, len(data))
        while stop < len(data):
            gap = np.flatnonzero(SPACE[data[stop : stop + BYTES]])
            stop += int(gap[0]) if len(gap) else min(BYTES, len(data) - stop)
            if len(gap):
                break
        inside = offsets[(offsets >= at) & (offsets < stop)] - at
        starts, ends, hashes = _hashed(data[at:stop], inside)
        parts.append((starts + at, ends + at, hashes))
        at = stop
    start, end, hashes = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    line = np.searchsorted(np.flatnonzero(data == 10), start) + doc
    return Words(start, end, hashes, doc, line, first)


def anchors(words: Words, window: int = WINDOW, gap: int = GAP) -> np.ndarray:
    """Words at which a window begins; the window lies inside the text."""
    h = words.hash
    room = np.maximum(0, np.diff(words.first) - window + 1)  # places at which a window fits
    if not room.any():
        return np.empty(0, np.int64)
    n, value = len(h), np.full(len(h), 2**64 - 1, np.uint64)
    m = n - ANCHOR + 1
    value[:m] = mix(h[:m] + h[1 : m + 1] * U(G) + h[2 : m + 2] * U(G_INVERSE))
    value = (value & ~U((1 << 20) - 1)) | (np.arange(n, dtype=np.uint64) & U((1 << 20) - 1))
    least, width = value, 1
    while 2 * width <= gap:
        least, width = np.minimum(least[: len(least) - width], least[width:]) if len(least) > width else least[:0], 2 * width
    if width < gap and len(least):
        more = gap - width
        least = np.minimum(least[: max(0, len(least) - more)], least[more:])
    runs = np.maximum(0, room - gap + 1)  # full windows of positions in each text
    at = np.repeat(words.first[:-1], runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    low = (1 << 20) - 1
    got = [at + (((least[at] & U(low)).astype(np.int64) - at) & low)]
    few = np.flatnonzero((room > 0) & (room < gap))
    got.append(np.array([words.first[k] + int(value[words.first[k] : words.first[k] + room[k]].argmin()) for k in few], np.int64))
    return np.unique(np.concatenate(got))


@dataclass
class Units:
    doc: np.ndarray
    start: np.ndarray  # in characters of the text
    end: np.ndarray
    words: np.ndarray
    node: np.ndarray  # hash of the words
    window: np.ndarray  # whether it is a window
    n_keys: np.ndarray  # bands of each, without those that a window just before has which it overlaps
    keys: np.ndarray  # all of them, in the order of the units


def _banded(minima: np.ndarray, bands: int, rows: int, salt: int) -> np.ndarray:
    """minima (functions, units) -> keys (units, bands)."""
    out = np.empty((minima.shape[1], bands), np.int64)
    for b in range(bands):
        key = np.full(minima.shape[1], (b + 1) * 1000 + salt, np.uint64)
        for r in range(rows):
            key = mix(key * U(G) + minima[b * rows + r])
        out[:, b] = key.astype(np.int64)
    return out


def units(data: np.ndarray, offsets: np.ndarray, min_words: int, line_bands: tuple[int, int], window_bands: tuple[int, int]) -> Units:
    """Paragraphs and windows of the texts, with their MinHash bands over runs of SHINGLE words. Equal windows of a
    text that overlap are one, the first."""
    w = words_of(data, offsets)
    n = len(w.hash)
    power, inverse = _tables.powers(n + 1)
    sums = np.concatenate([[U(0)], np.cumsum(w.hash * power[:n], dtype=np.uint64)])
    content = lambda a, b: mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
    ahead = max(0, n - SHINGLE + 1)
    shingles = mix((sums[SHINGLE:] - sums[: n + 1 - SHINGLE]) * inverse[: n + 1 - SHINGLE]) if ahead else np.empty(0, np.uint64)

    edge = np.flatnonzero(np.concatenate([[True], w.line[1:] != w.line[:-1]])) if n else np.empty(0, np.int64)
    a, b = edge, np.append(edge[1:], n)
    keep = b - a >= max(min_words, SHINGLE)
    a, b = a[keep], b[keep]
    mult, add = multipliers(max(line_bands[0] * line_bands[1], window_bands[0] * window_bands[1]))
    line_keys = np.empty((len(a), line_bands[0]), np.int64)
    if len(a):
        cuts = np.stack([a, b - SHINGLE + 1], 1).ravel()
        tail = cuts[-1] == len(shingles)
        cuts = cuts[:-1] if tail else cuts
        minima = np.stack([np.minimum.reduceat(shingles * mult[f] + add[f], cuts)[::2] for f in range(line_bands[0] * line_bands[1])])
        line_keys = _banded(minima, *line_bands, 1)

    at = anchors(w)
    node = content(at, at + WINDOW)
    if len(at):
        order = np.lexsort((at, node, w.doc[at]))
        x, y = order[1:], order[:-1]
        again = (node[x] == node[y]) & (w.doc[at[x]] == w.doc[at[y]]) & (at[x] - at[y] < WINDOW)
        keep = np.ones(len(at), bool)
        keep[x[again]] = False
        at, node = at[keep], node[keep]
    window_keys, sent = np.empty((len(at), window_bands[0]), np.int64), np.ones((len(at), window_bands[0]), bool)
    if len(at):
        own = shingles[at[:, None] + np.arange(WINDOW - SHINGLE + 1)]
        minima = np.stack([(own * mult[f] + add[f]).min(1) for f in range(window_bands[0] * window_bands[1])])
        window_keys = _banded(minima, *window_bands, 2)
        for step in range(1, min(4, len(at))):
            over = (w.doc[at[step:]] == w.doc[at[:-step]]) & (at[step:] - at[:-step] < WINDOW)
            sent[step:] &= ~(over[:, None] & (window_keys[step:] == window_keys[:-step]))

    lo, hi = np.concatenate([a, at]), np.concatenate([b, at + WINDOW])
    doc = w.doc[lo] if len(lo) else np.empty(0, np.int64)
    from_byte, to_byte = (w.start[lo], w.end[hi - 1]) if len(lo) else (lo, hi)
    begins = offsets[doc]
    more = (data & 0xC0) == 0x80
    if more.any():
        before = np.concatenate([[0], np.cumsum(~more)])
        from_byte, to_byte, begins = before[from_byte], before[to_byte], before[begins]
    is_window = np.repeat([False, True], [len(a), len(at)])
    nodes = mix(np.concatenate([content(a, b), node]) + is_window.astype(np.uint64)).astype(np.int64)
    n_keys = np.concatenate([np.full(len(a), line_bands[0]), sent.sum(1)])
    return Units(doc, from_byte - begins, to_byte - begins, hi - lo, nodes, is_window, n_keys, np.concatenate([line_keys.ravel(), window_keys[sent]]))


def groups(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of a string column (no nulls) of about BYTES bytes."""
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    k = 0
    while k < len(column):
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + BYTES, "right")) - 1)
        stop = min(stop, len(column))
        yield k, data[offsets[k] : offsets[stop]], offsets[k : stop + 1] - offsets[k]
        k = stop
