"""Phrase collocations by Apriori levels over minimal perfect hash slots.

A phrase of k words can be frequent only if its first and its last k - 1 words are. Every level's mappers count the
phrases that pass this (a bitmap of the level below, of fixed size) with numpy over local word ids, and send
counts by hash block. A block makes a minimal perfect hash of its candidates and sums the mappers'
counts by slot; stored keys and the phrases themselves are compared. Cuts are then read by slot.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import batches
from .common import empty_if_null, materialize
from .slots import SlotTable, mix

#: Separators of pieces and of words, and ASCII capitals to small letters by bytes.lower().
TABLE = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")

#: Words that a mapper counts before it sends what it has.
FLUSH = 1_000_000
CHARS = 2 << 20
#: Hash blocks for so many words each, at most BLOCKS of them unless a block had over MOST_BLOCK words then. A mapper
#: sends a row a block, and never more rows than it has distinct phrases.
BLOCK, BLOCKS, MOST_BLOCK = 1 << 12, 256, 1 << 20
#: The bitmap of frequent phrases of the level below. It fills up as the vocabulary grows, and only lets more pass then.
BITS = 1 << 24
#: Parts are broadcast with their counts if there are at most so many; beyond it they are joined.
PARTS = 1 << 20
#: First ranks are taken within so many parts of a language.
SALTS = 64


def _hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def phrase_hashes(langs: list[str], phrases: list[bytes]) -> np.ndarray:
    """The chained hash of each phrase of words between single spaces."""
    words, out = [p.split(b" ") for p in phrases], np.zeros(len(phrases), np.uint64)
    by: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        by.setdefault(lang, []).append(i)
    for lang, own in by.items():
        for m in range(max(len(words[i]) for i in own)):
            at = [i for i in own if len(words[i]) > m]
            word = _hashes([words[i][m] for i in at], lang)
            out[at] = word if not m else _chain(out[at], word)
    return out


def _chain(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from those of the words before its last and of its last word."""
    return mix(h, 7) ^ mix(word, 11) * np.uint64(3)


def _passes(bitmap: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    if bitmap is None:
        return np.ones(len(h), bool)
    at = h & np.uint64(BITS - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


class Counter:
    """Word ids of one language in a mapper, until they are sent."""

    def __init__(self):
        self.ids = defaultdict(itertools.count().__next__)
        self.ids[b"\n"]  # the end of a piece is word 0
        self.rows: list[np.ndarray] = []
        self.held = 0

    def add(self, texts: list[str]) -> None:
        raw = b"\n".join([*[t.encode() for t in texts], b""]).lower().translate(TABLE).replace(b"\n", b" \n ")
        words = list(filter(None, raw.split(b" ")))
        self.rows.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.held += len(words)

    def phrases(self, lang: str, level: int, bitmap: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(hashes, counts, phrases) of the distinct phrases of ``level`` words whose parts pass the bitmap."""
        ids = np.concatenate(self.rows).astype(np.int64)
        words = list(self.ids)
        own, v = _hashes(words, lang), len(words)
        if level == 1:
            counts = np.bincount(ids, minlength=v)
            counts[0] = 0
            at = np.flatnonzero(counts)
            return own[at], counts[at], pa.array(words, pa.binary()).take(pa.array(at))
        # positions where a part of level - 1 words begins that may be frequent
        n = max(len(ids) - level + 2, 0)
        parts = np.ones(n, bool)
        h = own[ids[:n]]
        for m in range(level - 1):
            parts &= ids[m : m + n] > 0
            if m:
                h = _chain(h, own[ids[m : m + n]])
        parts &= _passes(bitmap, h)
        at = np.flatnonzero(parts[:-1] & parts[1:])
        code = ids[at]
        for m in range(1, level):
            code = code * v + ids[at + m]
            if m < level - 1:
                code = np.unique(code, return_inverse=True)[1]
        _, first, counts = np.unique(code, return_index=True, return_counts=True)
        at = at[first]
        h, names = own[ids[at]], pa.array(words, pa.binary())
        for m in range(1, level):
            h = _chain(h, own[ids[at + m]])
        said = pc.binary_join_element_wise(*[names.take(pa.array(ids[at + m])) for m in range(level)], pa.scalar(b" ", pa.binary()))
        return h, counts, said


def level_counts(texts: DataFrame, level: int, bitmap: np.ndarray | None, blocks: int) -> DataFrame:
    """(lang, block, n, phrases, total): each mapper's counts, packed by hash block; texts: (lang, text)."""
    held = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counter in counters.items():
                h, n, said = counter.phrases(lang, level, held.value)
                block = (mix(h, 3) % np.uint64(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                own, starts = np.unique(block[order], return_index=True)
                n, ends = n[order], np.append(starts, len(h)).astype(np.int32)
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), said.take(pa.array(order))), pa.scalar(b"\n", pa.binary()))
                totals = np.add.reduceat(n, starts) if len(n) else n
                packed = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends * np.int32(4)), pa.py_buffer(n.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own), packed, joined, pa.array(totals)], names=["lang", "block", "n", "phrases", "total"])
            counters.clear()

        for batch in it:
            for k in range(0, batch.num_rows, 500):
                rows, by = batch.slice(k, 500), {}
                for lang, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    by.setdefault(lang, []).append(text)
                for lang, own in by.items():
                    for group in batches(own, CHARS):
                        counters.setdefault(lang, Counter()).add(group)
                        if sum(c.held for c in counters.values()) > FLUSH:
                            yield from flush()
        yield from flush()

    return texts.mapInArrow(run, "lang string, block bigint, n binary, phrases binary, total bigint")


def block_sums(packed: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, f, h) with f >= least: mappers' counts of a block summed by the slots of its candidates."""

    def run(table: pa.Table) -> pa.Table:
        langs, names = table.column("lang").to_pylist(), sorted(set(table.column("lang").to_pylist()))
        parts = [x.split(b"\n") for x in table.column("phrases").to_pylist()]
        n = np.frombuffer(b"".join(table.column("n").to_pylist()), "<u4").astype(np.int64)
        lang = np.repeat([names.index(x) for x in langs], [len(x) for x in parts])
        h = np.concatenate([_hashes(x, of) for of, x in zip(langs, parts, strict=True)])
        said = pa.array(itertools.chain.from_iterable(parts), pa.binary())
        keys, first = np.unique(h, return_index=True)
        slots = SlotTable(keys)
        own = slots.slots(h)
        first = first[np.argsort(slots.slots(keys))]
        stored = said.take(pa.array(first))
        same = pc.equal(said, stored.take(pa.array(own))).to_numpy(zero_copy_only=False) & (lang == lang[first][own])
        f = np.bincount(own[same], n[same], slots.n).astype(np.int64)  # exact below 2^53
        keep = np.flatnonzero(f >= least)
        out = list(zip(lang[first][keep].tolist(), stored.take(pa.array(keep)).to_pylist(), f[keep].tolist(), strict=True))
        # another phrase of a stored one's 64-bit hash is counted by itself
        odd: dict[tuple, int] = defaultdict(int)
        for k in np.flatnonzero(~same).tolist():
            odd[int(lang[k]), said[k].as_py()] += int(n[k])
        out += [(x, phrase, count) for (x, phrase), count in odd.items() if count >= least]
        own_langs, phrases = [names[r[0]] for r in out], [r[1] for r in out]
        columns = [own_langs, [p.decode() for p in phrases], [r[2] for r in out], phrase_hashes(own_langs, phrases).view(np.int64)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["lang", "phrase", "f", "h"])

    return packed.groupBy("block").applyInArrow(run, "lang string, phrase string, f bigint, h bigint")


def bitmap_of(counted: DataFrame) -> np.ndarray:
    """One bit for each hash that may be looked up: BITS / 64 words at most come to the driver."""
    at = F.col("h").bitwiseAND(F.lit(BITS - 1))
    words = counted.groupBy(F.shiftright(at, 6).alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast((h & {BITS - 1}L) & 63L as int)))").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _cut_rows(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, k, first, rest) of every cut."""
    w = F.split("phrase", " ")
    cut = lambda k: F.struct(k.alias("k"), F.array_join(F.slice(w, F.lit(1), k), " ").alias("first"), F.array_join(F.slice(w, k + 1, F.size(w)), " ").alias("rest"))
    return phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.size(w) - 1), cut)).alias("c")).select("lang", "phrase", "a", "c.*")


def cuts(phrases: DataFrame, parts: DataFrame, *, most_parts: int = PARTS) -> DataFrame:
    """(lang, phrase, a, k, l, r) of every cut of the phrases; parts: (lang, phrase, f, h) of all that a cut leaves.

    Counts are read by slot from a broadcast table of at most ``most_parts`` parts, which is counted first;
    with more of them the cuts are joined to the parts.
    """
    rows = _cut_rows(phrases)
    if parts.limit(most_parts + 1).count() > most_parts:
        look = parts.select("lang", F.col("phrase").alias("part"), "f")
        for side, name in (("first", "l"), ("rest", "r")):
            rows = rows.join(look.select("lang", F.col("part").alias(side), F.col("f").alias(name)).hint("merge"), ["lang", side])
        return rows.select("lang", "phrase", "a", "k", "l", "r")
    local = parts.select(F.concat_ws("\n", "lang", "phrase").alias("key"), "f", "h").toArrow().combine_chunks()
    table, names = rows.sparkSession.sparkContext.broadcast(local), ["lang", "phrase", "a", "k", "l", "r"]
    state: list = []

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            h, f, key = table.value.column("h").to_numpy().view(np.uint64), table.value.column("f").to_numpy(), table.value.column("key").combine_chunks()
            keys, first = np.unique(h, return_index=True)
            slots = SlotTable(keys)
            order = first[np.argsort(slots.slots(keys))]
            odd = np.setdiff1d(np.arange(len(h)), first)
            state.extend([slots, f[order], key.take(pa.array(order)), {key[int(i)].as_py(): int(f[i]) for i in odd}])
        slots, f, key, odd = state

        def read(langs: list[str], parts_of: list[str]) -> np.ndarray:
            at = slots.slots(phrase_hashes(langs, [p.encode() for p in parts_of]))
            wanted = pa.array([f"{x}\n{p}" for x, p in zip(langs, parts_of, strict=True)], pa.string())
            found = (at >= 0) & pc.equal(key.take(pa.array(np.maximum(at, 0))), wanted).to_numpy(zero_copy_only=False)
            out = f[np.maximum(at, 0)].copy()
            for i in np.flatnonzero(~found):
                out[i] = odd[wanted[int(i)].as_py()]
            return out

        for batch in it:
            if batch.num_rows:
                langs, l, r = (batch.column(k).to_pylist() for k in (0, 4, 5))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(read(langs, l), pa.int64()), pa.array(read(langs, r), pa.int64())], names=names)

    return rows.mapInArrow(run, "lang string, phrase string, a bigint, k int, l bigint, r bigint")


def scored(rows: DataFrame) -> DataFrame:
    """Cuts with score floor(1000000 a a / (l r)), in integers of any size."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            a, l, r = (batch.column(k).to_pylist() for k in (2, 4, 5))
            score = [1_000_000 * x * x // (y * z) for x, y, z in zip(a, l, r, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.int64())], names=[*batch.schema.names, "score"])

    return rows.mapInArrow(run, "lang string, phrase string, a bigint, k int, l bigint, r bigint, score bigint")


def frequent_phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 10, max_words: int = 3) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f, h) of all words and phrases with f >= least, (lang, n) of all words)."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), empty_if_null(text_col).alias("text"))
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    spread = lambda words: max(1, min(-(-words // BLOCK), BLOCKS), -(-words // MOST_BLOCK))
    packed = materialize(level_counts(texts, 1, None, spread(chars // 6)), "word-counts")
    sizes = materialize(packed.groupBy("lang").agg(F.sum("total").alias("n")), "lang-sizes")
    words = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    levels = [materialize(block_sums(packed, least), "words")]
    for k in range(2, max_words + 1):
        levels.append(materialize(block_sums(level_counts(texts, k, bitmap_of(levels[-1]), spread(words)), least), f"phrases-{k}"))
    every = levels[0].withColumn("words", F.lit(1))
    for k, level in enumerate(levels[1:], 2):
        every = every.unionByName(level.withColumn("words", F.lit(k)))
    return every, sizes


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 10, max_words: int = 3, share: int = 50, top: int = 2000, most_parts: int = PARTS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to max_words words by the lowest score
    of their cuts, ties by a, then by the phrase's bytes.

    Phrases whose words lie inside a longer candidate of at least ``share`` percent of their occurrences are
    left out. A null text is empty, a null language 'und'; repeated rows count each; other columns are not read;
    an empty table gives no rows.
    """
    every, sizes = frequent_phrases(docs, text_col=text_col, lang_col=lang_col, least=least, max_words=max_words)
    phrases, parts = every.where("words > 1"), every.where(f"words < {max_words}")
    best = scored(cuts(phrases, parts, most_parts=most_parts)).groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("score", "l", "r"), F.struct("score", "k")).alias("c")).select("lang", "phrase", "a", "c.*")
    w = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size(w) - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size(w) - m + 1), lambda s: F.array_join(F.slice(w, s, m), " "))))
    longer = phrases.where("words > 2").select("lang", "f", F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    left = best.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a"))).drop("most")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    """Each language's collocations in all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


OP12_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
rows_of AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
placed AS (SELECT lang, unnest(w) AS w1, unnest(list_concat(w[2:], [NULL])) AS w2, unnest(list_concat(w[3:], [NULL, NULL])) AS w3 FROM rows_of),
one AS (SELECT lang, w1 AS phrase, count(*) AS f FROM placed WHERE w1 IS NOT NULL GROUP BY ALL),
two AS (SELECT lang, w1, w2, count(*) AS f FROM placed WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, w1, w2, w3, count(*) AS f FROM placed WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang),
cut AS (
    SELECT two.lang, w1 || ' ' || w2 AS phrase, 1 AS k, two.f AS a, x.f AS l, y.f AS r FROM two JOIN one x ON x.lang = two.lang AND x.phrase = w1 JOIN one y ON y.lang = two.lang AND y.phrase = w2
    UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 1, t.f, x.f, y.f FROM three t JOIN one x ON x.lang = t.lang AND x.phrase = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
    UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 2, t.f, y.f, x.f FROM three t JOIN one x ON x.lang = t.lang AND x.phrase = t.w3 JOIN two y ON y.lang = t.lang AND y.w1 = t.w1 AND y.w2 = t.w2),
scores AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cut),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_of AS (SELECT lang, w1 || ' ' || w2 AS phrase, f FROM three UNION ALL SELECT lang, w2 || ' ' || w3, f FROM three),
most AS (SELECT lang, phrase, max(f) AS most FROM inner_of GROUP BY ALL),
left_over AS (SELECT lowest.* FROM lowest LEFT JOIN most USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM left_over) JOIN sizes USING (lang) WHERE rank <= 2000"""
