"""SimHash near-duplicates by the generalised pigeonhole principle.

If two fingerprints differ in at most t bits and the bits are dealt into parts with thresholds t_i such that
sum(t_i + 1) = t + 1, then in some part they differ in at most t_i bits. Bits that move together share a
part; the thresholds come from a dynamic program over the candidates that each part would bring. A part of
threshold 0 is probed by its value, one of threshold 1 by its value against all values a bit away, one of
threshold 2 by values a bit away on both sides. Every candidate is verified on all 64 bits.

Rows that meet at a key are compared in place, and each task keeps only a minimum spanning forest of the
links it has found: the links' components are whole, and a group of copies never becomes a list of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, empty_if_null, materialize, small
from .components import connected_components
from .minhash import SEED, SHINGLE, SIMILARITY, SKETCH_BITS, SKETCH_RADIUS, multipliers, signature, tuned_bands

BITS = 64
#: Bits in which linked fingerprints may differ.
RADIUS = 4
#: Rows of one key that a task compares; larger keys are dealt out by pairs of chunks of this many rows.
KEY_ROWS = 4096
#: Links that a task holds before it reduces them to a forest.
HELD_LINKS = 400_000
#: Rows, and shingles of them, of a group that a task verifies; larger groups are dealt out by pairs of chunks.
GROUP_ROWS, GROUP_SHINGLES = 1024, 500_000
#: Groups of so few rows are verified many at a time, until they hold so many shingles.
FEW, FEW_SHINGLES = 12, 300_000


def word_hashes(text: str, words: int, distinct: bool) -> np.ndarray:
    """XXH64 of every run of so many lower-cased words joined by a space; of all words, if there are fewer."""
    w = text.encode().lower().split()  # bytes: A-Z only, and white space is the space and \t to \r
    if not w:
        return np.empty(0, np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(w)
    if len(w) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[: len(w) - words])]
    spans = [joined[a:b] for a, b in zip(starts, ends[words - 1 :], strict=True)]
    if distinct:
        spans = set(spans)
    return np.fromiter((digest(x, SEED) for x in spans), np.uint64, len(spans))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is 1 if it is set in over half of the hashes; signed, as Spark's bigint holds it."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = hashes[k : k + (1 << 15)]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distinct: bool = False) -> DataFrame:
    """(id, fp bigint) of every row, without a shuffle. Null and empty texts have fingerprint 0."""
    source = docs.select(F.col(id_col).alias("id"), empty_if_null(text_col).alias("t"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = [fingerprint(word_hashes(t, words, distinct)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp bigint")


def forest(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The minimum spanning forest of links by (distance, a, b), whatever their order (Kruskal, in slices
    filtered by the labels so far)."""
    if not len(a):
        return a, b, d
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a, d))
    a, b, d = a[order], b[order], d[order]
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent, label, kept, k = list(range(len(nodes))), np.arange(len(nodes)), [], 0
    while k < len(x):
        open_ = np.flatnonzero(label[x[k : k + 50_000]] != label[y[k : k + 50_000]]) + k
        k += 50_000
        for lo in range(0, len(open_), 5_000):
            part = open_[lo : lo + 5_000]
            part = part[label[x[part]] != label[y[part]]]
            for i, p, q in zip(part.tolist(), x[part].tolist(), y[part].tolist(), strict=True):
                while parent[p] != p:
                    parent[p] = parent[parent[p]]
                    p = parent[p]
                while parent[q] != q:
                    parent[q] = parent[parent[q]]
                    q = parent[q]
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    kept.append(i)
            label = np.array(parent)
            while (label[label] != label).any():
                label = label[label]
    return a[kept], b[kept], d[kept]


class Links:
    """The links of a task, reduced to a forest whenever many are held."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, a, b, d) -> None:
        if len(a):
            self.parts.append((a, b, d))
            self.held += len(a)
            if self.held > HELD_LINKS:
                self.reduce()

    def reduce(self):
        got = forest(*(np.concatenate(x) for x in zip(*self.parts, strict=True))) if self.parts else (np.empty(0, np.int64),) * 3
        self.parts, self.held = [got], 0
        return got


def _compare(key: np.ndarray, node: np.ndarray, fp: np.ndarray, role: np.ndarray, radius: int, links: Links) -> None:
    """Links among rows with equal keys (sorted); two rows of role 1 need not be compared."""
    fp = fp.astype(np.int64).view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    large = sizes > 48
    for s, n in zip(starts[large].tolist(), sizes[large].tolist(), strict=True):
        for lo in range(s, s + n, 512):
            rows = slice(lo, min(lo + 512, s + n))
            cols = slice(lo, s + n)
            dist = np.bitwise_count(fp[rows, None] ^ fp[None, cols])
            ok = (dist <= radius) & ((role[rows, None] == 0) | (role[None, cols] == 0))
            i, j = np.nonzero(ok)
            up = (j > i) & (node[lo + i] != node[lo + j])
            i, j = i[up], j[up]
            links.add(node[lo + i], node[lo + j], dist[i, j].astype(np.int64))
    i = np.flatnonzero(np.repeat(~large, sizes))
    for step in range(1, 48):
        i = i[i + step < len(key)]
        i = i[key[i] == key[i + step]]
        if not len(i):
            break
        dist = np.bitwise_count(fp[i] ^ fp[i + step])
        ok = (dist <= radius) & ((role[i] == 0) | (role[i + step] == 0)) & (node[i] != node[i + step])
        links.add(node[i[ok]], node[i[ok] + step], dist[ok].astype(np.int64))


def bit_parts(nodes: DataFrame, parts: int) -> list[list[int]]:
    """Deals the 64 bits into parts of nearly equal width, bits of high absolute correlation together."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS), np.int64)
        for batch in it:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in range(0, len(fp), 1 << 14):
                bits = np.unpackbits(fp[k : k + (1 << 14)].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
                total[:BITS] += (bits.T @ bits).astype(np.int64)
                total[BITS] += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["cell", "n"])

    cells = np.zeros((BITS + 1) * BITS)
    for r in nodes.select("fp").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        cells[r.cell] = r.n  # 65 x 64 cells, whatever the input
    both, n = cells.reshape(BITS + 1, BITS)[:BITS], max(1.0, cells[-1])
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, -1)
    widths = [BITS // parts + (k < BITS % parts) for k in range(parts)]
    left, dealt = set(range(BITS)), []
    for width in widths:
        rest = sorted(left)
        sub = tie[np.ix_(rest, rest)]
        own = [rest[int(sub.max(1).argmax())]]
        while len(own) < width:
            rest = sorted(left - set(own))
            own.append(rest[int(tie[np.ix_(rest, own)].sum(1).argmax())])
        dealt.append(sorted(own))
        left -= set(own)
    return dealt


def _value(bits: list[int]) -> Column:
    """The part's bits of fp, packed. Bit 0 is the highest, as in the printed fingerprint."""
    return sum((F.shiftrightunsigned("fp", BITS - 1 - b).bitwiseAND(F.lit(1).cast("bigint")) * F.lit(1 << k).cast("bigint") for k, b in enumerate(bits)), F.lit(0).cast("bigint"))


def allocate(costs: list[list[float]], radius: int) -> list[int]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = radius + 1 of least total cost; costs[i][t + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        now: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for step, more in enumerate(part):
                if used + step <= radius + 1 and cost + more < now.get(used + step, (np.inf,))[0]:
                    now[used + step] = cost + more, [*chosen, step - 1]
        best = now
    if radius + 1 not in best:
        raise ValueError(f"{len(costs)} parts cannot cover a radius of {radius}")
    return best[radius + 1][1]


def part_count(n: int, radius: int) -> int:
    """Parts of about log2(n) bits: wider parts bring fewer chance candidates, and more probes a row."""
    width = min(32, max(16, int(np.log2(max(n, 2)))))
    return max(BITS // width, -(-(radius + 1) // 3))


def links_within(nodes: DataFrame, radius: int) -> DataFrame:
    """nodes (node bigint, fp bigint; materialized) -> links (a, b, distance) that span all components of
    the graph of fingerprints at most ``radius`` bits apart, the closest links first."""
    n = nodes.count()
    dealt = bit_parts(nodes, part_count(n, radius))
    own = nodes.select("node", "fp", F.posexplode(F.array(*[_value(x) for x in dealt])).alias("part", "v"))
    width = F.element_at(F.array(*[F.lit(len(x)) for x in dealt]), F.col("part") + 1)
    ball = F.concat(F.array(F.col("v")), F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.col("v").bitwiseXOR(F.expr("bigint(1)") * F.pow(F.lit(2.0), k).cast("bigint"))))
    # a number of partitions that is not coalesced: each row becomes as many as its part has bits
    counts = own.groupBy("part", "v").agg(F.count("*").alias("c")).repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part", "v")
    met = materialize(counts.select("part", "v", "c", F.explode(ball).alias("z")).groupBy("part", "z").agg(F.sum("c").alias("near"), F.sum(F.when(F.col("z") == F.col("v"), F.col("c")).otherwise(0)).alias("c")), "balls")
    sums = {r.part: r for r in met.groupBy("part").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("c0"), F.sum(F.col("c").cast("double") * F.col("near")).alias("c1"), F.sum(F.col("near").cast("double") * F.col("near")).alias("c2")).collect()}
    row = 40.0  # a row dealt costs about so many comparisons
    costs = [[0.0, sums[i].c0 + row * n, sums[i].c1 + row * n * (len(x) + 1), sums[i].c2 + row * n * (len(x) + 1)] if i in sums else [0.0] * 4 for i, x in enumerate(dealt)]
    chosen = allocate(costs, radius)
    threshold = F.element_at(F.array(*[F.lit(t) for t in chosen]), F.col("part") + 1)
    rows = own.where(threshold >= 0).select("node", "fp", "part", "v", threshold.alias("t"), F.explode(F.when(threshold >= 1, ball).otherwise(F.array("v"))).alias("z"))
    rows = rows.select((F.col("part").cast("bigint") * F.lit(1 << 40).cast("bigint") + F.col("z")).alias("key"), "node", "fp", F.when((F.col("t") == 1) & (F.col("z") != F.col("v")), 1).otherwise(0).alias("role"))
    near = met.where(threshold >= 0).select((F.col("part").cast("bigint") * F.lit(1 << 40).cast("bigint") + F.col("z")).alias("key"), "near")
    return compared(rows, near, radius)


def compared(rows: DataFrame, sizes: DataFrame, radius: int) -> DataFrame:
    """rows (key, node, fp, role) and sizes (key, near: about how many rows it has) -> a spanning forest of
    links (a, b, distance) between rows of a key. Rows of a large key are dealt to all pairs of its chunks."""
    hot = materialize(sizes.where(F.col("near") > KEY_ROWS).select("key", F.ceil(F.col("near") / KEY_ROWS).cast("int").alias("chunks")), "hot")
    if hot.limit(1).count():
        own_chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
        dealt = rows.join(small(hot), "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", own_chunk)
        dealt = dealt.select("key", "node", "fp", "role", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "fp", "role")
        rows = dealt.select(F.when(F.col("hi") == 0, F.col("key")).otherwise(F.xxhash64("key", "lo", "hi")).alias("key"), "node", "fp", "role")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, rest = Links(), None
        for batch in it:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            rest = [x[cut:].copy() for x in now]
            if cut:
                _compare(*(x[:cut] for x in now), radius, links)
        if rest is not None and len(rest[0]):
            _compare(*rest, radius, links)
        a, b, d = links.reduce()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.int64())], names=["a", "b", "distance"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint, distance bigint")


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = RADIUS, distinct: bool = False) -> DataFrame:
    """(id_col, fingerprint, component_id) of every row: fingerprints at most ``radius`` bits apart are linked,
    and component_id is the smallest id reachable. Whole texts; null and empty ones have fingerprint zero,
    which is linked like any other. Exact copies and repeated rows meet at their fingerprint; null ids are
    never the smallest (a component of null ids only has a null id). Other columns are not read; an empty
    table gives no rows."""
    fps = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, words=words, distinct=distinct), "fps")
    least = materialize(fps.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    comps = connected_components(links_within(least.select(F.col("fp").alias("node"), "fp"), radius))
    named = least.join(comps, least.fp == comps.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    heads = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(heads, "component").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """texts (node, t) -> (node, s array<bigint>): hashes of distinct runs of so many words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sets = [np.unique(word_hashes(t, words, True)).astype(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])

    return texts.mapInArrow(run, "node bigint, s array<bigint>")


def _shared(held: np.ndarray, mark: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Marked members of each of the sets that start there."""
    ends = np.cumsum(sizes)
    at = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])
    return np.add.reduceat(mark[held[at]].astype(np.int64), ends - sizes)


def similar_pairs(node: np.ndarray, fp: np.ndarray, side: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of one group whose fingerprints are within the radius and whose sets have
    the similarity. A pair is left out only if links that passed join its ends already. With two sides, only
    pairs across them are compared."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.lexsort((node, sizes))
    node, fp, side, sizes = node[order], fp[order].astype(np.int64).view(np.uint64), side[order], sizes[order]
    _, held = np.unique(np.concatenate([sets[k] for k in order.tolist()]), return_inverse=True)
    held, starts = held.astype(np.int32), np.cumsum(sizes) - sizes
    across, mark, label, found = side.min() != side.max(), np.zeros(len(held), bool), np.arange(len(node)), []
    tops = np.searchsorted(sizes, sizes / similarity + 1, "right")  # larger sets cannot have the similarity
    for i in range(len(node) - 1):
        j = np.arange(i + 1, tops[i])
        ok = (np.bitwise_count(fp[j] ^ fp[i]) <= radius) & (label[j] != label[i])
        j = j[ok & (side[j] != side[i])] if across else j[ok]
        if not len(j):
            continue
        own = held[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        both = np.concatenate([_shared(held, mark, starts[j[k : k + 256]], sizes[j[k : k + 256]]) for k in range(0, len(j), 256)])
        mark[own] = False
        for k in j[both >= similarity * (sizes[i] + sizes[j] - both)].tolist():
            if label[k] != label[i]:
                found.append((int(node[i]), int(node[k])))
                label[label == label[k]] = label[i]
    return found


def few_pairs(groups: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]], radius: int, similarity: float) -> list[tuple[int, int]]:
    """All such pairs of small groups (node, fp, sets), compared many at a time."""
    if not groups:
        return []
    own = np.repeat(np.arange(len(groups)), [len(g[0]) for g in groups])
    node, fp = np.concatenate([g[0] for g in groups]), np.concatenate([g[1] for g in groups]).view(np.uint64)
    sets = [x for g in groups for x in g[2]]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, starts, found = np.concatenate(sets), np.cumsum(sizes) - sizes, []
    for step in range(1, max(len(g[0]) for g in groups)):
        i = np.flatnonzero(own[step:] == own[:-step])
        j = i + step
        ok = (np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j])) & (np.bitwise_count(fp[i] ^ fp[j]) <= radius)
        i, j = i[ok], j[ok]
        ends = np.cumsum(sizes[i] + sizes[j])
        lo = 0
        while lo < len(i):  # pairs of about 2,000,000 shingles at a time
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 2_000_000)))
            both = np.stack([i[lo:hi], j[lo:hi]], 1).ravel()
            n = sizes[both]
            cuts = np.cumsum(n)
            pair = np.repeat(np.arange(hi - lo), n.reshape(-1, 2).sum(1))
            value = flat[np.repeat(starts[both] - (cuts - n), n) + np.arange(cuts[-1])]
            order = np.lexsort((value, pair))
            value, pair = value[order], pair[order]
            shared = np.bincount(pair[1:][(value[1:] == value[:-1]) & (pair[1:] == pair[:-1])], minlength=hi - lo)
            pass_ = shared >= similarity * (n.reshape(-1, 2).sum(1) - shared)
            found += zip(node[i[lo:hi][pass_]].tolist(), node[j[lo:hi][pass_]].tolist(), strict=True)
            lo = hi
    return found


def verified_groups(sets: DataFrame, radius: int, similarity: float) -> DataFrame:
    """sets (grp, node, fp, s; materialized, no empty set) -> links (a, b) that span the components of the pairs of a group
    with fingerprints within the radius and at least the Jaccard similarity. Every such pair is verified
    before any is dropped. Large groups are dealt to all pairs of their chunks."""
    chunks = F.ceil(F.greatest(F.col("load") / GROUP_SHINGLES, F.col("n") / GROUP_ROWS)).cast("int")
    hot = sets.groupBy("grp").agg(F.sum(F.size("s")).alias("load"), F.count("*").alias("n")).select("grp", chunks.alias("chunks")).where("chunks > 1")
    hot = materialize(hot, "hot-groups")
    rows = sets.select("grp", "node", "fp", F.lit(0).alias("own"), F.lit(False).alias("across"), "s")
    if hot.limit(1).count():
        dealt = sets.join(small(hot), "grp", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        key = F.when(F.col("chunks") == 1, F.col("grp")).otherwise(F.xxhash64("grp", F.least("own", "other"), F.greatest("own", "other")))
        rows = dealt.select(key.alias("grp"), "node", "fp", "own", (F.col("own") != F.col("other")).alias("across"), "s")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, few, load = None, [], [], 0

        def links():
            nonlocal few, load
            if len(held) < 2 or (held[0][3] and len({x[2] for x in held}) < 2):
                return []
            node, fp, side = (np.array([x[k] for x in held], np.int64) for k in range(3))
            sets = [x[4] for x in held]
            if len(held) > FEW or side.min() != side.max():
                return similar_pairs(node, fp, side, sets, radius, similarity)
            few.append((node, fp, sets))
            load += sum(map(len, sets))
            if load < FEW_SHINGLES:
                return []
            got, few, load = few_pairs(few, radius, similarity), [], 0
            return got

        for batch in it:
            out, lists = [], batch.column(5)
            values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for k, (g, *head) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True)):
                if g != key:
                    out += links()
                    key, held = g, []
                held.append((*head, values[at[k] : at[k + 1]].copy()))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(2)], names=["a", "b"])
        out = links() + few_pairs(few, radius, similarity)
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(2)], names=["a", "b"])

    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "a bigint, b bigint")


def fingerprint_links(nodes: DataFrame, radius: int) -> DataFrame:
    """nodes (node, sim; materialized) -> links (a, b, distance) that span the components of fingerprints at most
    ``radius`` bits apart. Nodes of one fingerprint are linked to the least of them, which stands for all."""
    heads = materialize(nodes.groupBy("sim").agg(F.min("node").alias("head")), "fingerprints")
    equal = nodes.join(heads, "sim").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"), F.lit(0).cast("bigint").alias("distance"))
    return links_within(heads.select(F.col("head").alias("node"), F.col("sim").alias("fp")), radius).unionByName(equal)


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one of the smallest id (a null id is the
    last), and of equal ids the one of the smallest text hash.

    Equal texts are one node. Candidates are texts whose SimHash fingerprints of their five-word shingles are within
    RADIUS bits, by the same parts and probes as in simhash_components. Pairs at SIMILARITY are some ten bits apart, so
    texts that share a MinHash band of those shingles are candidates too: bands find 0.999 of them. Groups are the components of candidates with close sketches, and all close pairs of a group are
    verified before any is dropped: a link needs a Jaccard similarity of SIMILARITY of the shingles. Texts without a word are equal to each other. A null text counts as
    empty. Columns stay as they are; an empty table gives no rows.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(id_col).alias("__id"), empty_if_null(text_col).alias("__t"))
    packed = packed.withColumn("__h", F.xxhash64("__t"))
    source = packed.select("__id", "__h", "__t")
    id_kind = source.schema["__id"].dataType.simpleString()

    bands, per_band = tuned_bands()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = multipliers(max(SKETCH_BITS, bands * per_band))
        for batch in it:
            hashes = [word_hashes(t, SHINGLE, True) for t in batch.column(2).to_pylist()]
            keys, sketches = zip(*[signature(h, bands, per_band, a, b) if len(h) else ([], 0) for h in hashes], strict=True) if hashes else ([], [])
            sims = pa.array(map(fingerprint, hashes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.int64()), sims, pa.array([len(h) == 0 for h in hashes], pa.bool_())], names=["id", "node", "bands", "fp", "sim", "empty"])

    rows = source.mapInArrow(run, f"id {id_kind}, node bigint, bands array<bigint>, fp bigint, sim bigint, empty boolean")
    rows = materialize(rows.withColumn("node", F.when(F.col("empty"), F.lit(0).cast("bigint")).otherwise(F.col("node"))), "rows")
    nodes = materialize(rows.groupBy("node").agg(F.first(F.struct("bands", "fp", "sim")).alias("x"), F.min("id").alias("least")).select("node", "x.*", "least"), "nodes")
    keyed = nodes.select(F.explode("bands").alias("key"), "node", "fp", F.lit(0).alias("role"))
    near = fingerprint_links(nodes.where(F.size("bands") > 0).select("node", "sim"), RADIUS)
    links = materialize(near.unionByName(compared(keyed, keyed.groupBy("key").agg(F.count("*").alias("near")), SKETCH_RADIUS)), "links")
    # the forest keeps the components of all candidates whole, so every candidate pair is inside one group
    ends = materialize(connected_components(links).withColumnRenamed("component", "grp").join(nodes.select("node", "fp"), "node"), "ends")
    # one copy of each text, the one of the least id; on both columns, so that copies do not meet in one task
    wanted = ends.join(nodes.select("node", "least"), "node").select("node", "least")
    texts = packed.join(wanted.hint("merge"), (F.col("__h") == F.col("node")) & F.col("__id").eqNullSafe(F.col("least"))).groupBy("node").agg(F.first("__t").alias("t"))
    sets = materialize(shingle_sets(texts, SHINGLE).join(ends, "node").select("grp", "node", "fp", "s"), "sets")
    comps = connected_components(verified_groups(sets, SKETCH_RADIUS, SIMILARITY))
    named = nodes.join(comps, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    # one row stays of each component: the smallest id, then the smallest text hash
    head = named.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node")).alias("x")).select(F.col("x.least").alias("keep_id"), F.col("x.node").alias("keep"))
    head = materialize(head, "heads")
    own = F.when(~F.col("__t").rlike(WORD), F.lit(0).cast("bigint")).otherwise(F.col("__h"))
    kept = packed.withColumn("__node", own).join(head.hint("merge"), (F.col("__node") == F.col("keep")) & F.col("__id").eqNullSafe(F.col("keep_id")), "left_semi")
    # repeated rows: equal in id and text; looked for in the narrow table, and met only where there are any
    twice = rows.groupBy("id", "node").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("twice_id"), F.col("node").alias("twice"))
    twice = materialize(twice.join(head, (F.col("twice") == F.col("keep")) & F.col("twice_id").eqNullSafe(F.col("keep_id")), "left_semi"), "twice")
    if twice.limit(1).count():
        on = (F.col("__node") == F.col("twice")) & F.col("__id").eqNullSafe(F.col("twice_id"))
        once = kept.join(small(twice), on, "left_semi").dropDuplicates(["__id", "__node"])
        kept = kept.join(small(twice), on, "left_anti").unionByName(once)
    return kept.select("__row.*")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of four-word shingles of every document, linked within four bits."""
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
