"""Substring dedup: repeated passages by MinHash banding of paragraphs and of windows of words.

Units are paragraphs (lines of MIN_WORDS words or more) and content-defined windows that ignore line ends, so
a passage of 50 words is found inside a longer line and across lines alike. Equal units are one node. Nodes
that share a band are verified by the exact Jaccard similarity of their five-word shingles, every pair
before any is dropped; the components of the links that pass are the clusters of which only the first
place stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import empty_if_null, materialize
from .components import connected_components
from .minhash import SHINGLE, SIMILARITY, tuned_bands
from .simhash import shingle_sets, verified_groups
from .spans import groups, units

MIN_WORDS = 25
#: Recall of the bands at a similarity of 0.8, and the minima that it may take. Windows need less: a shared passage
#: has several, and most of them are equal.
LINE_RECALL, LINE_MINIMA = 0.999, 30
WINDOW_RECALL, WINDOW_MINIMA = 0.95, 6
#: Nodes that a task remembers, to send the bands of each once; it forgets them all when there are more.
SEEN = 300_000


def places_of(docs: DataFrame, min_words: int) -> DataFrame:
    """docs (u, id, t) -> (u, id, start, end, n_words, window, node, keys): all units, without a shuffle. Only the
    first of equal units that a task meets has keys; whether others have some is of no account."""
    id_kind = docs.schema["id"].dataType
    lines, windows = tuned_bands(recall=LINE_RECALL, most=LINE_MINIMA), tuned_bands(recall=WINDOW_RECALL, most=WINDOW_MINIMA)
    arrow = [pa.int64(), to_arrow_type(id_kind), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.int64())]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in it:
            for row, data, offsets in groups(batch.column(2)):
                got = units(data, offsets, min_words, lines, windows)
                sums = np.concatenate([[0], np.cumsum(got.keys)])[np.concatenate([[0], np.cumsum(got.n_keys)])]
                new = np.zeros(len(got.node), bool)
                for k, x in enumerate((got.node ^ np.diff(sums)).tolist()):  # equal units with the same keys
                    if x not in seen:
                        seen.add(x)
                        new[k] = True
                if len(seen) > SEEN:
                    seen.clear()
                flat = got.keys[np.repeat(new, got.n_keys)]
                ends = np.concatenate([[0], np.cumsum(got.n_keys * new)]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~new, False)), pa.array(flat, pa.int64()))
                at = pa.array(got.doc + row)
                columns = [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x) for x in (got.start, got.end, got.words, got.window, got.node)), keys]
                yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, arrow, strict=True)], names=["u", "id", "start", "end", "n_words", "window", "node", "keys"])

    return docs.mapInArrow(run, f"u bigint, id {id_kind.simpleString()}, start bigint, end bigint, n_words int, window boolean, node bigint, keys array<bigint>")


def meetings(found: DataFrame) -> DataFrame:
    """(grp, node): the nodes of every key that different nodes have, under the least of them. Nodes that share a
    key share a group, and nodes that share many keys meet once. Both sides read one shuffle."""
    keyed = found.where("keys is not null").select(F.explode("keys").alias("key"), "node").repartition("key")
    shared = keyed.groupBy("key").agg(F.min("node").alias("grp"), F.max("node").alias("hi")).where("grp <> hi").select("key", "grp")
    return keyed.join(shared.hint("shuffle_hash"), "key").select("grp", "node").distinct()


def texts_of(docs: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(node, t): the text of each of the nodes at one of its places. Texts are merged with the places that are
    wanted of them at any size, so that the shuffle grows with the documents and not by a change of plan."""
    place = found.where("keys is not null").join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("u", "start", "end")).alias("x"))
    wanted = place.select("x.u", F.struct("x.start", "x.end", "node").alias("want")).groupBy("u").agg(F.collect_list("want").alias("want"))

    def pick(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            nodes, texts = [], []
            for t, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                nodes += [w["node"] for w in want]
                texts += [t[w["start"] : w["end"]] for w in want]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(texts, pa.string())], names=["node", "t"])

    return docs.join(wanted.hint("merge"), "u").select("t", "want").mapInArrow(pick, "node bigint, t string")


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id_col, start, end, n_words, unit, first_<id_col>, first_start, removed): every place, in characters of the
    text, of a paragraph or window whose cluster has places that do not overlap; the first of a cluster (by
    id, nulls first, then by place) stays, the others are removed. What one document loses is the union of its
    removed places. Runs of WINDOW + GAP - 1 words that two texts share are found wherever they lie, but for
    up to GAP - 1 words at either end; shorter ones if they are a line or hold an anchor.

    Null and empty texts have no places. Repeated rows (equal in id and text) repeat their places and count as one
    document; rows of an equal id and different texts are two. Other columns are not read; an empty table gives
    no rows. Letters are compared without the case of A-Z, words without their spacing.
    """
    source = docs.select(F.col(id_col).alias("id"), empty_if_null(text_col).alias("t")).select(F.xxhash64("id", "t").alias("u"), "id", "t")
    found = materialize(places_of(source, min_words), "places")
    meets = materialize(meetings(found), "meets")
    sets = shingle_sets(texts_of(source, meets.select("node").distinct(), found), SHINGLE).groupBy("node").agg(F.first("s").alias("s"))
    sets = meets.join(sets, "node").select("grp", "node", F.lit(0).cast("bigint").alias("fp"), "s")
    comps = connected_components(verified_groups(materialize(sets, "sets"), 0, SIMILARITY))
    often = found.groupBy("node").agg(F.count("*").alias("n")).join(comps, "node", "left").where("n > 1 or component is not null")
    often = materialize(often.select("node", F.coalesce("component", "node").alias("cluster")), "often")
    place = F.struct("id", "u", "start", "end")
    placed = found.drop("keys").join(often.hint("merge"), "node").select("cluster", "n_words", "window", place.alias("at"))
    placed = materialize(placed, "placed")
    ends = placed.groupBy("cluster").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    apart = lambda x: ~(F.col(f"{x}.id").eqNullSafe(F.col("first.id")) & (F.col(f"{x}.u") == F.col("first.u")) & (F.col(f"{x}.start") < F.col("first.end")))
    ends = materialize(ends.where(apart("last")).select("cluster", "first"), "firsts")  # apart, so that a large cluster's rows can be split
    unit = F.when(F.col("window"), "window").otherwise("paragraph")
    return placed.join(ends.hint("merge"), "cluster").select(F.col("at.id").alias(id_col), "at.start", "at.end", F.col("n_words").cast("bigint").alias("n_words"), unit.alias("unit"), F.col("first.id").alias(f"first_{id_col}"), F.col("first.start").alias("first_start"), apart("at").alias("removed"))


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents, and which of them go."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
