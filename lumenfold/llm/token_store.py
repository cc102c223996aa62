"""Token ids as directly addressable codes.

An id is split into chunks of CHUNK_BITS, the lowest first. Level k holds the k-th chunk of every id that
has one, a bitmap that says which of them go on at level k + 1, and a directory with the number of set bits
before every block of RANK_BLOCK. The place of an id at the next level is the number of set bits before it,
so any token is read by one probe a level, without decoding its neighbours.

The store is a Parquet table with one row a segment: whole documents in ascending order of their id, cut
when a segment has SEGMENT_TOKENS. Column ``part`` and ``seq`` give the order of the segments.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import Splitter, batches
from .common import empty_if_null, new_path

CHUNK_BITS = 8
RANK_BLOCK = 512
SEGMENT_TOKENS = 1 << 18
END_ID = 0
#: Chunks that a worker keeps with their ids: more than elsewhere, as this operator holds little else.
CHUNKS = 1_200_000


def pack(ids: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """(chunks, continuation bitmap, rank directory) of each level."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest):
        chunk, rest = (rest & np.uint32(255)).astype(np.uint8), rest >> np.uint32(CHUNK_BITS)
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(more) // RANK_BLOCK) * RANK_BLOCK, np.uint8)
        padded[: len(more)] = more
        ranks = np.concatenate([[0], np.cumsum(padded.reshape(-1, RANK_BLOCK).sum(1, dtype=np.int64))[:-1]])
        levels.append((chunk.tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes()))
        rest = rest[more]
    return levels


def unpack(levels: list) -> np.ndarray:
    """All ids of a segment, from the last level to the first."""
    rest = np.empty(0, np.uint32)
    for chunk, bits, _ in reversed(levels):
        own = np.frombuffer(chunk, np.uint8).astype(np.uint32)
        more = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own), bitorder="little").astype(bool)
        own[more] |= rest << np.uint32(CHUNK_BITS)
        rest = own
    return rest


def token_at(levels: list, place: int) -> int:
    """One id by its place in the segment: a probe of each level that the id has."""
    value, shift = 0, 0
    for chunk, bits, ranks in levels:
        value |= chunk[place] << shift
        byte, bit = divmod(place, 8)
        if not bits[byte] >> bit & 1:
            break
        block = place // RANK_BLOCK
        start = block * RANK_BLOCK // 8
        before = int.from_bytes(bits[start:byte], "little").bit_count() + (bits[byte] & ((1 << bit) - 1)).bit_count()
        place = int.from_bytes(ranks[4 * block : 4 * block + 4], "little") + before
        shift += CHUNK_BITS
    return value


#: The letters that byte-level vocabularies write bytes as: printable ones themselves, the rest from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in PRINTABLE)}

_tokenizers: dict = {}


def _splitter(content: bytes, pattern: str) -> Splitter:
    """The tokenizers library over pre-tokens, whose ids this worker keeps. A text with a special token of the
    file goes to the library whole."""
    from tokenizers import Tokenizer

    key = (hashlib.md5(content).digest(), pattern)
    if key not in _tokenizers:
        library = Tokenizer.from_buffer(content)

        tokenize, table = library.model.tokenize, BYTE_LETTERS
        number = [i.to_bytes(4, "little") for i in range(library.get_vocab_size())]

        def encode(words: list[str]) -> list[bytes]:
            """Pre-tokens through the library's merges."""
            plain = [("\u0120" + w[1:] if w[0] == " " else w) if w.isascii() and w[1:].isalpha() and w[0] > "\x1f" else w.encode().decode("latin-1").translate(table) for w in words]
            return [b"".join([number[x.id] for x in tokenize(w)]) for w in plain]

        def whole(texts: list[str]) -> list[bytes]:
            return [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch_fast(texts, add_special_tokens=False)]

        split = Splitter(pattern, encode, CHUNKS)
        split.special, split.library = [t.content for t in library.get_added_tokens_decoder().values()], whole
        _tokenizers[key] = split
    return _tokenizers[key]


def _encode(split: Splitter, texts: list[str]) -> list[bytes]:
    odd = [i for i, t in enumerate(texts) if any(s in t for s in split.special)]
    if not odd:
        return split.ids(texts)
    out = split.ids(["" if i in set(odd) else t for i, t in enumerate(texts)])
    for i, raw in zip(odd, split.library([texts[i] for i in odd]), strict=True):
        out[i] = raw
    return out


LEVEL = "struct<chunks: binary, more: binary, ranks: binary>"


def write_token_store(docs: DataFrame, tokenizer_path: str, pattern: str, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Writes the ids of all documents, each followed by ``end_id``, in ascending order of id_col (nulls first;
    equal ids by their text). Texts are dealt by ranges of the id, sorted, and encoded in place; a null text
    is empty: the end id only. Repeated rows are all written. An empty table leaves an empty store."""
    with open(tokenizer_path, "rb") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary
    source = docs.select(F.col(id_col).alias("id"), empty_if_null(text_col).alias("t")).repartitionByRange("id").sortWithinPartitions("id", "t")
    id_type = source.schema["id"].dataType
    arrow_id = to_arrow_type(id_type)
    end = int(end_id).to_bytes(4, "little")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, part, seq = _splitter(blob.value, pattern), TaskContext.get().partitionId(), 0
        ids, sizes, held, tokens = [], [], [], 0
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("ids", pa.list_(arrow_id)), ("sizes", pa.list_(pa.int64())), ("levels", pa.list_(pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])))])

        def segment() -> pa.RecordBatch:
            levels = [dict(zip(("chunks", "more", "ranks"), x, strict=True)) for x in pack(np.frombuffer(b"".join(held), "<u4"))]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([part], [seq], [tokens], [ids], [sizes], [levels]), schema, strict=True)], schema=schema)

        for batch in it:
            own, at = batch.column(0).to_pylist(), 0
            for group in batches(batch.column(1)):
                for raw in _encode(split, group):
                    ids.append(own[at])
                    at += 1
                    held += [raw, end]
                    sizes.append(len(raw) // 4 + 1)
                    tokens += sizes[-1]
                    if tokens >= SEGMENT_TOKENS:
                        yield segment()
                        ids, sizes, held, tokens, seq = [], [], [], 0, seq + 1
        if ids:
            yield segment()

    source.mapInArrow(run, f"part int, seq int, n_tokens bigint, ids array<{id_type.simpleString()}>, sizes array<bigint>, levels array<{LEVEL}>").write.parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The store's segments with ``start``, the number of ids before each. Only a total of each part, of which
    there are as many as write tasks, comes to the driver; within a part the sum runs over its segments."""
    store = spark.read.parquet(path)
    before, place = 0, []
    for r in store.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        place.append((r.part, before))
        before += r.n
    starts = spark.createDataFrame(place, "part int, part_start bigint")
    own = store.select("part", "seq", "n_tokens").withColumn("own", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens"))
    own = own.join(F.broadcast(starts), "part").select("part", "seq", (F.col("own") + F.col("part_start")).alias("start"))
    return store, own


def read_token_store(spark: SparkSession, path: str, *, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of every document, from the files: where its ids start among all
    ids of the store, how many there are, and the crc32 of their little-endian 32-bit form."""
    store, starts = segments(spark, path)
    source = store.drop("n_tokens").join(F.broadcast(starts) if starts.limit(50_001).count() <= 50_000 else starts, ["part", "seq"]).select("start", "ids", "sizes", "levels")
    kind = source.schema["ids"].dataType.elementType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                levels = [tuple(x.values()) for x in row.column(3).to_pylist()[0]]
                raw, sizes = memoryview(unpack(levels).astype("<u4").tobytes()), np.array(row.column(2).to_pylist()[0], np.int64)
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                start = ends - sizes + row.column(0)[0].as_py()
                yield pa.RecordBatch.from_arrays([row.column(1).flatten(), pa.array(start), pa.array(sizes), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    return source.mapInArrow(run, f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)


def tokens_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """places (place bigint) -> (place, token): random access by the place among all ids of the store. A
    place outside the store has no row. Each segment's codes are probed, never decoded."""
    store, starts = segments(spark, path)
    bounds = store.select("part", "seq", "n_tokens").join(starts, ["part", "seq"])
    wanted = places.select("place").where("place is not null").distinct().join(F.broadcast(bounds) if bounds.limit(50_001).count() <= 50_000 else bounds, F.expr("place >= start and place < start + n_tokens"))
    wanted = wanted.groupBy("part", "seq", "start").agg(F.collect_list("place").alias("places"))  # no more than a segment has tokens
    source = wanted.join(store.select("part", "seq", "levels"), ["part", "seq"]).select("start", "places", "levels")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for start, own, row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                levels = [tuple(x.values()) for x in row]
                got = [token_at(levels, x - start) for x in own]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(got, pa.int64())], names=["place", "token"])

    return source.mapInArrow(run, "place bigint, token bigint")


def op4_token_store(spark, sf_dir: str) -> DataFrame:
    """Writes the ids of every document as directly addressable codes and reads them back."""
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = new_path(spark, "tokens")
    write_token_store(docs, P.path("byte_bpe_50k.json"), P.PATTERN, path)
    return read_token_store(spark, path)
