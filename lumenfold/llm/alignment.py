"""Alignment of two tokenizers' ids of the same text by a dangling-suffix transducer.

Both token sequences spell the same bytes. The transducer knows which side leads and the bytes that the other
side has not matched yet; a step takes the next token of the side behind and leaves a new residual. Steps are
memoised by (state, next token). A group closes when nothing is left over. What leads is always a suffix of
one token, so every step but the first of a group links the token taken with the one that leads.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Cache, batches, chunks, gathered
from .common import materialize
from .token_store import BYTE_LETTERS

#: Aligned segments that a worker keeps, the longest text of one, and states of the transducer.
SEGMENTS = 500_000
LONG = 64
STATES = 1 << 17
#: New segments that are encoded and aligned at a time.
TOGETHER = 20_000
#: Links are joined to the counts of at most so many id pairs by broadcast: those that hold at least this share of all
#: (document, pair) rows each. Any other pair has fewer rows than that.
HOT_PAIRS = 50_000

SPACE = "▁"

#: Marks at which a word of letters ends for both sides, if no piece holds a letter beside one.
MARKS = ".,;:!?"


class Transducer:
    """States are residuals with the side that leads; state 0 is the empty residual."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.tokens = (a_bytes, b_bytes)
        self.ids: dict[tuple[int, bytes], int] = {(0, b""): 0}
        self.states: list[tuple[int, bytes]] = [(0, b"")]
        self.memo: list[dict[int, int]] = [{}]
        #: Ids with what follows them: A's within and at the end of its side of a group, then B's.
        self._said = [f"{i}{x}" for side, marks in ((a_bytes, ",|"), (b_bytes, ",;")) for x in marks for i in range(len(side))]

    def _state(self, lead: int, rest: bytes) -> int:
        key = (lead, rest) if rest else (0, b"")
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.memo.append({})
        return self.ids[key]

    def _step(self, state: int, token: int) -> int:
        """The state after the next token: of side 0 in the empty state, else of the side behind."""
        lead, rest = self.states[state]
        own = self.tokens[0][token] if not state else self.tokens[1 - lead][token]
        if not state:
            after = self._state(0, own)
        elif rest.startswith(own):
            after = self._state(lead, rest[len(own) :])
        elif own.startswith(rest):
            after = self._state(1 - lead, own[len(rest) :])
        else:
            raise ValueError("the two sequences spell different bytes")
        self.memo[state][token] = after
        return after

    def align(self, a: list[int], b: list[int]) -> tuple[list[tuple[list[int], list[int]]], list[int]]:
        """(groups, links as A's id << 32 | B's) of two id sequences that spell the same bytes, tokens without bytes excluded."""
        groups, links, i, j, memo, states = [], [], 0, 0, self.memo, self.states
        while i < len(a):
            i0, j0 = i, j
            token = a[i]
            state = memo[0].get(token)
            if state is None:
                state = self._step(0, token)
            i += 1
            while state:
                if states[state][0]:
                    token, i = a[i], i + 1
                else:
                    token, j = b[j], j + 1
                after = memo[state].get(token)
                state = self._step(state, token) if after is None else after
                links.append(a[i - 1] << 32 | b[j - 1])
            groups.append((a[i0:i], b[j0:j]))
        return groups, links

    def align_all(self, a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> tuple[list[str], list[bytes], np.ndarray]:
        """(groups as `a1,a2|b1;a3|b2`, links as bytes, number of groups) of many sequences, of which the k-th is
        a[a_at[k] : a_at[k + 1]] and b[b_at[k] : b_at[k + 1]]. All take a step at a time together; each different
        (state, token) of a step is looked up once."""
        steps = len(a) + len(b)
        link, linked, closed, own = np.zeros(steps, np.int64), np.zeros(steps, bool), np.zeros(steps, bool), np.zeros(steps, bool)
        i, j, end, state = a_at[:-1].copy(), b_at[:-1].copy(), a_at[1:], np.zeros(len(a_at) - 1, np.int64)
        act = np.flatnonzero(i < end)
        while len(act):
            now, x, y = state[act], i[act], j[act]
            keys, which = np.unique(now, return_inverse=True)
            takes_a = np.array([not k or self.states[k][0] == 1 for k in keys.tolist()], bool)[which]
            token = np.empty(len(act), np.int64)
            token[takes_a], token[~takes_a] = a[x[takes_a]], b[y[~takes_a]]
            keys, which = np.unique(now << 32 | token, return_inverse=True)
            after = []
            for k in keys.tolist():
                s, t = k >> 32, k & 0xFFFFFFFF
                found = self.memo[s].get(t)
                after.append(self._step(s, t) if found is None else found)
            after, at = np.array(after, np.int64)[which], x + y
            x, y = x + takes_a, y + ~takes_a
            k = now > 0
            link[at[k]], linked[at] = a[x[k] - 1] << 32 | b[y[k] - 1], k
            closed[at], own[at] = after == 0, takes_a
            i[act], j[act], state[act] = x, y, after
            act = act[(after > 0) | (x < end[act])]
        # of each group A's ids come first; what follows an id depends on whether its side goes on
        group = np.cumsum(closed) - closed
        side = 2 * group + ~own
        order = np.argsort(side, kind="stable")
        side = side[order]
        last = np.append(side[1:] != side[:-1], True)[:steps]
        ids = np.empty(steps, np.int64)
        ids[own], ids[~own] = a, b
        ids, n = ids[order], len(self.tokens[0])
        said = list(map(self._said.__getitem__, (ids + np.where(side & 1, 2 * n + last * len(self.tokens[1]), last * n)).tolist()))
        at = (a_at + b_at).tolist()
        before = np.concatenate([[0], np.cumsum(linked)])[at].tolist()
        raw = link[linked].tobytes()
        return ["".join(said[x:y])[:-1] for x, y in pairwise(at)], [raw[8 * x : 8 * y] for x, y in pairwise(before)], np.diff(np.concatenate([[0], np.cumsum(closed)])[at])

    def trim(self, most: int) -> None:
        """Forgets all states if they became too many; they are made again when met."""
        if len(self.states) > most:
            self.ids, self.states, self.memo = {(0, b""): 0}, [(0, b"")], [{}]


def _plain(x: str) -> bool:
    edges = (x[1:2] if x[:1] == "\n" else x[:1], x[-1:])
    return all(c.isprintable() and not c.isspace() for c in edges) and "" not in edges


#: Marks the key of a segment that isn't a space and its key.
ODD = "\x01"
#: What no text has that is cut at all its spaces and line ends.
UNEVEN = ("  ", " \n", "\n ", "\n\n")


def even(text: str) -> bool:
    """Whether every space and line end of the text stands between two printable characters that are no white space."""
    return text[0] not in " \n" and text[-1] not in " \n" and not any(map(text.__contains__, UNEVEN)) and text.replace("\n", "").isprintable()


def segments(text: str) -> list[str]:
    """Cuts space + text before every space or line end between two printable characters that are no white space.

    There both tokenizers end a token: the byte-level pattern begins a pre-token, no piece holds a space after
    another character, and none holds a line end beside others. Anything else stays with its neighbours.
    Returns keys: see spelled(). The text is not empty.
    """
    cut = text.replace("\n", " \n").split(" ")
    if even(text):
        return cut
    out, held, before = [], [], True
    for k, x in enumerate(cut):
        plain = _plain(x) and (k > 0 or x[0] != "\n")
        if plain and before and held:
            out.append(held)
            held = []
        held.append(k)
        before = plain
    out.append(held)
    own = lambda k: cut[k] if k and cut[k][:1] == "\n" else " " + cut[k]
    return [cut[x[0]] if len(x) == 1 and _plain(cut[x[0]]) and (x[0] or cut[0][0] != "\n") and cut[x[0]][0] != ODD else ODD + "".join(map(own, x)) for x in out]


def spelled(key: str) -> str:
    """The text of a segment's key."""
    return key[1:] if key[0] == ODD else key if key[0] == "\n" else " " + key


class Aligner:
    """Both tokenizers and the segments that this worker has aligned."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        letters = {ord(c): i for i, c in BYTE_LETTERS.items()}
        names = self.a.get_vocab(with_added_tokens=True)
        a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            try:
                a_bytes[i] = bytes(letters[ord(c)] for c in name)
            except KeyError:
                a_bytes[i] = name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.transducer = Transducer(a_bytes, b_bytes)
        self.mark = pieces.index(SPACE) if SPACE in pieces else -1
        # segments may be encoded apart only if these files keep to the rules that segments() relies on
        rules = json.loads(a_file)
        before = rules.get("pre_tokenizer") or {}
        self.apart = (
            rules.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            and self.mark >= 0 and not any(re.search(rf"[^{SPACE}]{SPACE}|.\n|\n.", p, re.S) for p in pieces) and self.b.normalize("a  b éﬁ") == f"{SPACE}a{SPACE}{SPACE}b{SPACE}éﬁ"
        )
        #: Aligned marks that may follow a word, one token on either side.
        self.marks: dict[str, tuple] = {}
        for mark in MARKS if self.apart and not any(x.isalpha() and y in MARKS for p in pieces for x, y in zip(p, p[1:], strict=False)) else "":
            a = self.a.encode(mark, add_special_tokens=False).ids
            if mark in pieces and len(a) == 1:
                self.marks[mark] = (1, 1, 1, f"{a[0]}|{pieces.index(mark)}", (a[0] << 32 | pieces.index(mark)).to_bytes(8, "little"))
        self.known = Cache(SEGMENTS)

    def _a_ids(self, segs: list[str]) -> list[list[int]]:
        """A word of Latin letters is one pre-token, which the library merges without its surroundings."""
        words = [k for k, x in enumerate(segs) if self.apart and x[0] == " " and x[1:].isalpha() and (x.isascii() or max(x) < "\u0250")]
        own, out = set(words), [[]] * len(segs)
        for k in words:
            x = segs[k][1:]
            raw = "\u0120" + (x if x.isascii() else "".join([BYTE_LETTERS[b] for b in x.encode()]))
            out[k] = [t.id for t in self.a.model.tokenize(raw)]
        rest = [k for k in range(len(segs)) if k not in own]
        for k, found in zip(rest, self.a.encode_batch_fast([segs[k] for k in rest], add_special_tokens=False) if rest else (), strict=True):
            out[k] = found.ids
        return out

    @staticmethod
    def _flat(ids: list[list[int]], tokens: list[bytes]) -> tuple:
        """All ids in a row, where each sequence starts and the end, and (the ends in bytes, the bytes) or None if an id is none."""
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        own = list(chain.from_iterable(ids))
        flat = np.array(own, np.int64)
        if -1 in own:
            return flat, at, None
        raw = list(map(tokens.__getitem__, own))
        return flat, at, (np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])[at[1:]], b"".join(raw))

    def _encode(self, keys: list[str]) -> list[tuple | None]:
        """(n_a, n_b, n_groups, groups, links as bytes) of each segment; None in place of one that the ids do not spell."""
        a_bytes, b_bytes = self.transducer.tokens
        segs = list(map(spelled, keys))
        # the pieces get their space from the library; a segment that begins with a line end must lose it again
        b_ids = self.b.encode([x[1:] if x[0] == " " else x for x in segs], num_threads=1)
        a_ids, raws = self._a_ids(segs), [x.encode() for x in segs]
        b_ids = [b if x[0] != "\n" else b[1:] if b[:1] == [self.mark] else [-1] for x, b in zip(segs, b_ids, strict=True)]
        flat, at, spelt = zip(*map(self._flat, (a_ids, b_ids), (a_bytes, b_bytes)), strict=True)
        ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)))
        if not all(x is not None and np.array_equal(x[0], ends) and x[1] == b"".join(raws) for x in spelt):
            # some segment is not spelt by its ids: each is judged alone
            good = [b[:1] != [-1] and b"".join([a_bytes[x] for x in a]) == raw == b"".join([b_bytes[x] for x in b]) for a, b, raw in zip(a_ids, b_ids, raws, strict=True)]
            a_ids, b_ids = ([x if ok else [] for x, ok in zip(ids, good, strict=True)] for ids in (a_ids, b_ids))
            flat, at, _ = zip(*map(self._flat, (a_ids, b_ids), (a_bytes, b_bytes)), strict=True)
        else:
            good = [True] * len(keys)
        said, links, n_groups = self.transducer.align_all(flat[0], at[0], flat[1], at[1])
        out = [(len(a), len(b), n, said_, raw) if ok else None for ok, a, b, n, said_, raw in zip(good, a_ids, b_ids, n_groups.tolist(), said, links, strict=True)]
        self.transducer.trim(STATES)
        return out

    def _add(self, new: set[str], extra: dict) -> None:
        """Aligns new segments; a word of letters and one mark is the word, then the mark."""
        known, old = self.known, self.known.old
        marked = [x for x in new if x[-1] in self.marks and x[:-1].isalpha()]
        for x in marked:
            new.discard(x)
        if marked:
            new.update([y for x in marked if (y := x[:-1]) not in known and y not in old])
        fresh = list(new)
        for k in range(0, len(fresh), TOGETHER):
            part = fresh[k : k + TOGETHER]
            for x, found in zip(part, self._encode(part), strict=True):
                (known if len(x) <= LONG else extra)[x] = found
        for x in marked:
            word, mark = extra[x[:-1]] if x[:-1] in extra else known[x[:-1]], self.marks[x[-1]]
            both = word and (word[0] + 1, word[1] + 1, word[2] + 1, f"{word[3]};{mark[3]}", word[4] + mark[4])
            (known if len(x) <= LONG else extra)[x] = both

    def coded(self, texts: list[str]) -> tuple[list[tuple | None], np.ndarray, np.ndarray]:
        """(aligned segments, the segment at each place, the first place of each text and the end). A segment that the
        ids do not spell is None, an empty text has no place. Segments of even texts are cut and numbered by Arrow, so
        that Python looks each different one up once."""
        texts_of = [k for k, t in enumerate(texts) if t and self.apart and t[0] != ODD and SPACE not in t and even(t)]
        keys, codes, places = chunks([texts[k] for k in texts_of])
        rows = [codes[:0]] * len(texts)
        for k, a, b in zip(texts_of, places.tolist(), places[1:].tolist(), strict=False):
            rows[k] = codes[a:b]
        own = set(texts_of)
        for k, t in enumerate(texts):
            if t and k not in own:
                row = segments(t) if self.apart and SPACE not in t else [f"{ODD} {t}"]
                rows[k] = np.arange(len(keys), len(keys) + len(row))
                keys += row
        known, old, extra = self.known, self.known.old, {}
        found = list(map(known.get, keys))
        gaps = [k for k, x in enumerate(found) if x is None]
        self._add({x for k in gaps if (x := keys[k]) not in known and x not in old}, extra)
        for k in gaps:
            found[k] = extra[keys[k]] if keys[k] in extra else known[keys[k]]
        known.turn()
        return found, np.concatenate([*rows, codes[:0]]).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in rows], dtype=np.int64)])

    def of(self, texts: list[str]) -> list[list[tuple] | None]:
        """The aligned segments of each text, or None if it has no tokens."""
        found, codes, at = self.coded(texts)
        parts = [[found[k] for k in codes[a:b].tolist()] for a, b in pairwise(at.tolist())]
        return [x if x and None not in x else None for x in parts]


_aligners: dict = {}


def aligner(a_file: bytes, b_file: bytes) -> Aligner:
    key = hashlib.md5(a_file).digest() + hashlib.md5(b_file).digest()
    if key not in _aligners:
        _aligners[key] = Aligner(a_file, b_file)
    return _aligners[key]


def rows_of(own: Aligner, texts: list[str]) -> tuple[list[tuple], list[str], list[np.ndarray], list[np.ndarray]]:
    """Of each text (n_a, n_b, n_groups, n_links, groups_sha256), the groups, the distinct linked pairs and the links of each."""
    found, codes, at = own.coded(texts)
    none = np.zeros(len(found) + 1, bool)
    none[[k for k, x in enumerate(found) if x is None]] = True
    n_a, n_b, n_groups, groups_of, raw = zip(*[x or (0, 0, 0, "", b"") for x in found], (0, 0, 0, "", b""), strict=True)
    count = lambda x: np.diff(np.concatenate([[0], np.cumsum(np.array(x, np.int64)[codes])])[at]).tolist()
    rows, said, pairs, times, codes_of, ends = [], [], [], [], codes.tolist(), at.tolist()
    for (a, b), bad, links, *n in zip(pairwise(ends), count(none), gathered(list(raw), codes, ends, "<i8"), *map(count, (n_a, n_b, n_groups)), strict=True):
        if a == b or bad:
            rows.append((0, 0, 0, 0, ""))
            said.append("")
            links = links[:0]
        else:
            said.append(";".join(map(groups_of.__getitem__, codes_of[a:b])))
            rows.append((*n, len(links), hashlib.sha256(said[-1].encode()).hexdigest()))
        u, c = np.unique(links, return_counts=True)
        pairs.append(u)
        times.append(c)
    return rows, said, pairs, times


def aligned(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", groups: bool = True) -> DataFrame:
    """One row a document: id_col, n_a, n_b, n_groups, n_links, groups_sha256, ``pairs`` array<bigint> (the distinct linked
    id pairs, A's id << 32 | B's) and ``times`` array<bigint> (links of each), and, with ``groups``, the groups as a string
    `a1,a2|b1;a3|b2,b3`.

    A is a byte-level tokenizers file, B a sentencepiece model that puts a space before; both get the whole text,
    special tokens as plain text. A null or empty text, or one that either side's bytes do not spell, has no
    tokens: zeros, empty arrays, ''. Repeated rows and ids are rows of their own, other columns are not read, an empty
    table gives no rows. The files are read on the driver and broadcast: their size is that of a vocabulary.
    """
    with open(a_path, "rb") as f, open(b_path, "rb") as g:
        files = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    source = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*files.value)
        names = [id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", *(["groups"] if groups else [])]
        for batch in it:
            at = 0
            for texts in batches(batch.column(1)):
                rows, said, pairs, times = rows_of(own, texts)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in pairs])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int64())) for x in (pairs, times)]
                counts = [pa.array(x, pa.int64()) for x in list(zip(*rows, strict=True))[:4]]
                columns = [batch.column(0).slice(at, len(texts)), *counts, pa.array([r[4] for r in rows], pa.string()), *lists, *([pa.array(said, pa.string())] if groups else [])]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>" + (", groups string" if groups else ""))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold each linked id pair, and whether none of its A id's pairs has more."""
    counts = materialize(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", F.shiftright("pair", 32)).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_totals(rows: DataFrame, *, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(__row, n_best, count_sum) of each row that has links; ``rows``: materialized, with __row, pairs, times.

    Pairs that hold at least 1 / hot_pairs of all (document, pair) rows, at most hot_pairs of them by that, meet
    their counts by broadcast before any shuffle; each of the others is too rare to be a hot key.
    """
    counts = materialize(pair_counts(rows), "pair-best")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") * hot_pairs >= F.lit(total)
    links = rows.select("__row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("__row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    near = links.join(F.broadcast(counts.where(hot)), "pair")
    far = links.join(F.broadcast(counts.where(hot).select("pair")), "pair", "left_anti").join(counts.where(~hot).hint("merge"), "pair")
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    both = near.groupBy("__row").agg(*sums).unionByName(far.groupBy("__row").agg(*sums))
    return both.groupBy("__row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def token_alignment(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """aligned() without its lists, with n_best (links whose pair no other of its A id exceeds in documents) and
    count_sum (documents that hold the pair, over all links). Nulls, repeats and empty tables as there."""
    rows = materialize(aligned(docs, a_path, b_path, id_col=id_col, text_col=text_col, groups=False).withColumn("__row", F.monotonically_increasing_id()), "aligned")
    totals = link_totals(rows.select("__row", "pairs", "times"), hot_pairs=hot_pairs)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return rows.drop("pairs", "times").join(totals, "__row", "left").select(id_col, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    """Every document's byte-level ids against its piece ids."""
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_alignment(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
