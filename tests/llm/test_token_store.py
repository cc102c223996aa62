import zlib

import numpy as np
import public_tokenizers as P
from lumenfold.llm.common import new_path
from lumenfold.llm.token_store import op4_token_store, pack, read_token_store, token_at, tokens_at, unpack, write_token_store
from tokenizers import Tokenizer

PATH = P.path("byte_bpe_50k.json")


def test_codes_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    for ids in (np.array([], np.uint32), np.array([0], np.uint32), rng.integers(0, 50257, 5000), rng.integers(0, 2**32, 3000, np.uint64), np.full(1024, 255), np.full(1025, 256)):
        ids = ids.astype(np.uint32)
        levels = pack(ids)
        assert (unpack(levels) == ids).all()
        assert [token_at(levels, k) for k in range(0, len(ids), 7)] == ids[::7].tolist()


def brute_force(rows):
    library, start, out = Tokenizer.from_file(PATH), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_nulls_repeats_special_tokens_and_access(spark):
    rows = [(5, "five words are  written here\n"), (2, None), (None, "no id"), (2, "twice"), (2, "twice"), (9, "<|endoftext|> special"), (7, "long " * 40000), (1, "")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, start long, n_tokens long")
    path = new_path(spark, "test")
    write_token_store(docs, PATH, P.PATTERN, path)
    got = sorted((tuple(r) for r in read_token_store(spark, path).collect()), key=lambda r: r[1])
    assert got == brute_force(rows)
    flat = np.concatenate([[*Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids, 0] for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))])
    places = spark.createDataFrame([(k,) for k in (0, 3, 17, 40001, len(flat) - 1, len(flat), None)], "place long")
    assert {r.place: r.token for r in tokens_at(spark, path, places).collect()} == {k: flat[k] for k in (0, 3, 17, 40001, len(flat) - 1)}
    empty = new_path(spark, "test")
    write_token_store(docs.limit(0), PATH, P.PATTERN, empty)
    assert read_token_store(spark, empty).count() == 0


def test_whole_table_equals_the_library(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op4_token_store(spark, sf).collect()), key=lambda r: r[1]) == brute_force(rows)
