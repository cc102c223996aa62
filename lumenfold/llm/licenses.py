"""License notices by an exact set-similarity join of text blocks with templates.

Template words are ordered by how often the whole table holds them. A block that holds the threshold's share of a
template holds one of its rarest words (prefix filter), has enough words at all (length filter), and enough of
them stand after the first shared word in that order (positional filter). What passes is counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import batches
from .common import empty_if_null

#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.9

#: Bytes that belong to no word become spaces; capitals of ASCII are lowered before.
WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
TABLE = bytes(b if b in WORD_BYTES else 0x20 for b in range(256))

#: Phrases whose places are counted, by label.
BASE_PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Notices of public licences, (label, words of the notice).
TEMPLATES = [
    ("agpl-3.0", "GNU Affero General Public License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def words_of(text: str) -> list[bytes]:
    """Runs of digits, small letters (ASCII capitals lowered) and anything beyond ASCII."""
    return text.encode().lower().translate(TABLE).split()


def needed(n: int, containment: float) -> int:
    """The fewest of n distinct words that are at least the share ``containment``, at least one."""
    return max(1, next(k for k in range(n + 1) if k / n >= containment))


class Index:
    """Templates with their distinct words in the order of the table's counts, rarest first."""

    def __init__(self, templates: list[tuple[str, str]], phrases: Mapping[str, str], containment: float, counts: Mapping[bytes, int]):
        self.phrases = [(label, words_of(p)) for label, p in phrases.items()]
        cut = [(label, words_of(t)) for label, t in templates]
        if any(not w for _, w in [*self.phrases, *cut]):
            raise ValueError("every template and phrase needs a word")
        vocabulary = sorted({w for _, own in [*self.phrases, *cut] for w in own}, key=lambda w: (counts.get(w, 0), w))
        #: A word's number is its place in the global order.
        self.number = {w: k for k, w in enumerate(vocabulary)}
        self.phrases = [(label, [self.number[w] for w in own]) for label, own in self.phrases]
        self.templates, self.prefixes = [], {}
        for k, (label, own) in enumerate(cut):
            order = sorted({self.number[w] for w in own})
            least = needed(len(order), containment)
            self.templates.append((label, len(own), order, least))
            for word in order[: len(order) - least + 1]:
                self.prefixes.setdefault(word, []).append(k)
        self.rare = np.zeros(len(vocabulary) + 2, bool)  # the last two: any other word, the end of a text
        self.rare[list(self.prefixes)] = True

    def blocks(self, ids: np.ndarray, places: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(label, start, n_words, containment) of each block of one text that meets the threshold. A template of m
        words is held against blocks of 2 m words at every multiple of m; places: where rare words stand."""
        wanted = sorted({(k, block) for i in places.tolist() for k in self.prefixes[int(ids[i])] for block in (i // self.templates[k][1] - 1, i // self.templates[k][1]) if block >= 0})
        out = []
        for k, block in wanted:
            label, m, order, least = self.templates[k]
            own = ids[block * m : (block + 2) * m]
            have = np.unique(own[own < len(self.number)])  # in the global order
            if len(have) < least:
                continue
            shared = np.intersect1d(have, order, assume_unique=True)
            first = shared[0] if len(shared) else -1
            if 1 + min(len(order) - order.index(first) - 1, len(have) - int(np.searchsorted(have, first)) - 1) < least if len(shared) else True:
                continue
            if len(shared) >= least:
                out.append((label, block * m, len(own), len(shared) / len(order)))
        return out


def _ids(number: dict[bytes, int], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words, each text followed by an end mark; where each text begins)."""
    rows, other, end = [], len(number), len(number) + 1
    get = number.get
    for t in texts:
        rows.append([get(w, other) for w in words_of(t)])
    starts = np.concatenate([[0], np.cumsum([len(r) + 1 for r in rows])])
    ids = np.full(starts[-1], end, np.int64)
    for row, at in zip(rows, starts.tolist(), strict=False):
        ids[at : at + len(row)] = row
    return ids, starts


def word_counts(docs: DataFrame, words: list[bytes], *, text_col: str = "text") -> dict[bytes, int]:
    """How often the table holds each of the words: a row of counts from every task, one from all of them."""
    number = {w: k for k, w in enumerate(words)}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(number) + 2, np.int64)
        for batch in it:
            for texts in batches(batch.column(0).to_pylist()):
                total += np.bincount(_ids(number, texts)[0], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(number)), pa.int32()), pa.array(total[:-2], pa.int64())], names=["k", "n"])

    found = docs.select(empty_if_null(text_col)).mapInArrow(run, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()
    return {words[r.k]: r.n for r in found}


BLOCK = "struct<label: string, start: bigint, n_words: bigint, containment: double>"


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, phrases: Mapping[str, str] = BASE_PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """One row a document: id_col, n_words, n_base (places of the phrases), first_word and last_word (the least and the
    greatest start of one, in words from 0; else null), base_labels, labels (with those of templates; both distinct,
    sorted, joined by commas), score (the greatest containment of a template in a block that meets the
    threshold, else 0) and ``blocks``, every block that meets it.

    A null text is empty: no words, no labels, score 0. Repeated rows are rows of their own, other columns are not
    read, an empty table gives no rows. Templates are a parameter of the driver and are broadcast.
    """
    vocabulary = sorted({w for t in [*phrases.values(), *[t for _, t in templates]] for w in words_of(t)})
    index = docs.sparkSession.sparkContext.broadcast(Index(templates, phrases, containment, word_counts(docs, vocabulary, text_col=text_col)))
    source = docs.select(id_col, empty_if_null(text_col).alias("__text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64())]))]
        for batch in it:
            at = 0
            for texts in batches(batch.column(1).to_pylist()):
                ids, starts = _ids(own.number, texts)
                base: list[list[tuple[int, str]]] = [[] for _ in texts]
                for label, phrase in own.phrases:
                    n = max(len(ids) - len(phrase) + 1, 0)
                    hit = np.flatnonzero(np.logical_and.reduce([ids[m : m + n] == w for m, w in enumerate(phrase)]))
                    for i, d in zip(hit.tolist(), (np.searchsorted(starts, hit, "right") - 1).tolist(), strict=True):
                        base[d].append((i - int(starts[d]), label))
                rare = np.flatnonzero(own.rare[ids])
                bounds = np.searchsorted(rare, starts)
                rows = []
                for d in range(len(texts)):
                    words = ids[starts[d] : starts[d + 1] - 1]
                    found = own.blocks(words, rare[bounds[d] : bounds[d + 1]] - starts[d]) if bounds[d] < bounds[d + 1] else []
                    places, labels = [i for i, _ in base[d]], {x for _, x in base[d]}
                    rows.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {b[0] for b in found})), max((b[3] for b in found), default=0.0), [dict(zip(("label", "start", "n_words", "containment"), b, strict=True)) for b in found]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])
                at += len(texts)

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, blocks array<{BLOCK}>")


def op11_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("blocks")


def licenses_sql(templates: list[tuple[str, str]] = TEMPLATES, phrases: Mapping[str, str] = BASE_PHRASES, containment: float = CONTAINMENT) -> str:
    """The scan in DuckDB's SQL: every block against every template, without filters."""
    said = lambda t: "[" + ", ".join(f"'{w.decode()}'" for w in words_of(t)) + "]"
    rows = ", ".join(f"('{label}', {said(t)})" for label, t in templates)
    bases = ", ".join(f"('{label}', {said(t)})" for label, t in phrases.items())
    return rf"""
    WITH cut AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    phrase(label, p) AS (VALUES {bases}),
    place AS (SELECT rid, label, unnest(list_filter(range(0, len(w) - len(p) + 1), lambda i: w[i + 1:i + len(p)] = p)) AS spot FROM cut, phrase WHERE len(w) >= len(p)),
    base AS (SELECT rid, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list_distinct(list(label)) AS l FROM place GROUP BY rid),
    template(label, t) AS (VALUES {rows}),
    block AS (SELECT rid, label, t, w, unnest(range(0, len(w), len(t))) AS s FROM cut, template),
    held AS (SELECT rid, label, len(list_intersect(list_distinct(w[s + 1:s + 2 * len(t)]), list_distinct(t))) / len(list_distinct(t)) AS share FROM block),
    found AS (SELECT rid, max(share) AS score, list_distinct(list(label)) AS l FROM held WHERE share >= {containment} GROUP BY rid)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
        coalesce(array_to_string(list_sort(base.l), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(base.l, found.l))), ','), '') AS labels, coalesce(score, 0)::DOUBLE AS score
    FROM cut LEFT JOIN base USING (rid) LEFT JOIN found USING (rid)"""


OP11_SQL = licenses_sql()
