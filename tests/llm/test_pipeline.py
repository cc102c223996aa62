import random
from collections import Counter

import corpus_pipeline
import pytest
from lumenfold.llm import simhash as S

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def say(rng, n):
    return " ".join("".join(rng.choice("aeioklmnprst") for _ in range(rng.randint(2, 9))) for _ in range(n))


def brute_force_kept(rows):
    """Greatest possible and least necessary rows by all pairs of exact five-word shingles."""
    sets = [set(S.word_hashes(t or "", 5, True).tolist()) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if (x or y) and len(x & y) < 0.8 * len(x | y):
                continue
            old, new = group[a], group[b]
            group = [new if g == old else g for g in group]
    best = {}
    for (i, t), g in zip(rows, group, strict=True):
        best[g] = min(best.get(g, (True, 0)), (i is None, i or 0))
    return Counter(i if not none else None for none, i in best.values())


def test_one_of_each_group_stays(spark):
    rng = random.Random(11)
    base = say(rng, 300)
    near = []
    for k in range(6):
        w = base.split()
        w[20 + 40 * k] = "edited"
        near.append(" ".join(w))
    far = base.split()
    for k in range(0, 300, 8):
        far[k] = "far"
    rows = [(i, say(rng, 120)) for i in range(60)] + [(100 + i, t) for i, t in enumerate([base, *near])] + [(99, " ".join(far))]
    rows += [(200, base), (201, None), (202, ""), (203, " \n"), (None, rows[3][1]), (None, "no id at all"), (5, rows[5][1]), (6, rows[7][1]), (300, "tiny"), (301, "TINY")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __node string")
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == [*COLUMNS, "__node"]
    got = Counter(r.doc_id for r in kept.collect())
    assert got == brute_force_kept(rows) and got[100] == 1 and got[99] == 1
    assert S.drop_near_duplicates(docs.limit(0)).count() == 0


def test_appended_and_cut_blocks_are_found(spark):
    """Copies at a similarity of 0.8 to 0.9 by a block at either end, and by scattered edits."""
    rng, rows = random.Random(21), []
    for k in range(120):
        w = say(rng, rng.randint(100, 400)).split()
        share = (0.81, 0.85, 0.89)[k % 3]
        more = say(rng, int((len(w) - 4) * (1 / share - 1))).split()
        near = list(w)
        for p in range(0, len(w), 60):
            near[p] = "edited"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join((w + more, w[-int(len(w) * share) - 2 :], near)[k // 3 % 3]))]
    got = Counter(r.doc_id for r in S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    wanted = brute_force_kept(rows)
    assert len(wanted) == 120 and got == wanted


def test_true_copies_in_a_family_of_a_template(spark, monkeypatch):
    """Documents at a similarity of 0.7 or so, each with one near copy: closer false candidates cost no true link."""
    rng, base, rows = random.Random(7), [f"w{k}" for k in range(100)], []
    for f in range(60):
        w = list(base)
        at = rng.randrange(86)
        w[at : at + 14] = [f"own{f}x{k}" for k in range(14)]
        near = list(w)
        near[(at + 50) % 90], near[(at + 30) % 90] = f"near{f}", f"also{f}"
        rows += [(f, " ".join(w)), (1000 + f, " ".join(near))]
    docs, wanted = spark.createDataFrame(rows, "doc_id long, text string"), brute_force_kept(rows)
    assert 20 < len(wanted) < 100
    assert Counter(r.doc_id for r in S.drop_near_duplicates(docs).collect()) == wanted
    monkeypatch.setattr(S, "GROUP_ROWS", 4)
    assert Counter(r.doc_id for r in S.drop_near_duplicates(docs).collect()) == wanted


def test_components_equal_brute_force(spark, sf):
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in S.op8_simhash(spark, sf).collect()}
    ids = sorted(got)
    group = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if b < a and (got[a][0] ^ got[b][0]).bit_count() <= 4 and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    assert {i: c for i, (_, c) in got.items()} == group


def test_fingerprints_by_definition(spark):
    import xxhash

    texts = ["One two three four five", "a b", "", None, "x " * 70_000, "É z\x0by é"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "a b")], "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash_components(docs).collect()}
    for i, t in enumerate(texts):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        grams = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        bits = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
        assert got[i][0] == f"{bits:016x}"
    assert got[2] == got[3] == ("0" * 16, 2) and got[None][1] == 1


def test_allocation_is_least():
    import itertools

    rng = random.Random(2)
    costs = [[0.0, *sorted(rng.random() * 100 for _ in range(3))] for _ in range(4)]
    for radius in (3, 4, 8):
        chosen = S.allocate(costs, radius)
        assert sum(t + 1 for t in chosen) == radius + 1
        least = min(sum(costs[i][t + 1] for i, t in enumerate(x)) for x in itertools.product((-1, 0, 1, 2), repeat=4) if sum(t + 1 for t in x) == radius + 1)
        assert sum(costs[i][t + 1] for i, t in enumerate(chosen)) == pytest.approx(least)


def test_large_keys_are_dealt_whole(spark, monkeypatch):
    monkeypatch.setattr(S, "KEY_ROWS", 20)
    rng = random.Random(4)
    centre = rng.getrandbits(63)
    fps = sorted({centre ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for _ in range(150)} | {rng.getrandbits(63) for _ in range(50)})
    nodes = spark.createDataFrame([(f, f) for f in fps], "node long, fp long")
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in S.links_within(nodes, 4).collect()}
    assert all((a ^ b).bit_count() <= 4 for a, b in got)

    def parts(links):
        group = {f: f for f in fps}
        for a, b in links:
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = {f: new if g == old else g for f, g in group.items()}
        return group

    assert parts(got) == parts([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])


def test_stages_keep_columns_and_take_effect(spark, tmp_path, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), [60]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == COLUMNS or k == 4, name
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] <= sizes[2] and sizes[5] == sizes[4]
    assert all(r.n_tokens >= 0 for r in docs.collect())


def test_thin_pages_lose_long_boilerplate(spark):
    """Boilerplate of over half of a document goes as long as a line of its own stays; whole copies stay."""
    wide = "this site uses cookies and a licence that is far longer than what the page has to say for itself"
    rows = [(i, f"own {i}\n{wide}", "en", f"s{i}", 1) for i in range(12)] + [(100, wide, "en", "s1", 1), (101, f"{wide}\n \n{wide}", "en", "s2", 1), (102, None, "en", "s3", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines_stage(spark, docs, "").collect()}
    assert got == {i: f"own {i}" if i < 12 else t for i, t, *_ in rows}


def test_run_against_brute_force(spark, sf):
    """Rows of run(): what SQL's quality rules and line dedup leave, one of each group by all pairs, as the mix takes
    them, with the ids of tiktoken."""
    import base64

    import duckdb
    import public_tokenizers as P
    import tiktoken
    from lumenfold.llm.line_dedup import lines_sql
    from lumenfold.llm.quality import OP7_SQL

    got = corpus_pipeline.run(spark, sf).collect()
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    con.sql(f"CREATE TABLE good AS SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM ({OP7_SQL}) WHERE kept)")
    texts = dict(con.sql(f"WITH {lines_sql('good')} SELECT doc_id, text FROM cleaned").fetchall())
    kept = brute_force_kept(sorted(texts.items()))
    taken = Counter(r.doc_id for r in got)
    assert set(taken) <= set(kept) and max(taken.values()) <= 2 and len(taken) >= 0.8 * len(kept)
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines()) if a}
    encode = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    for r in got:
        assert r.token_ids == encode(texts[r.doc_id] or "") and r.n_tokens == len(r.token_ids)


def test_fingerprints_alone_find_close_copies(spark, monkeypatch):
    """Close copies are candidates by their SimHash links, also where no MinHash band is shared."""
    rng, rows = random.Random(31), [(900, None), (901, " "), (902, "tiny"), (903, "TINY")]
    for k in range(80):
        w = say(rng, 400).split()
        near = list(w)
        near[rng.randrange(400)] = "edited"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(near).upper())]
    hashes = [S.word_hashes(t or "", 5, True) for _, t in rows]
    close = sum(((S.fingerprint(a) ^ S.fingerprint(b)) & (2**64 - 1)).bit_count() <= S.RADIUS for a, b in zip(hashes[4::2], hashes[5::2], strict=True))
    assert close > 50
    monkeypatch.setattr(S, "signature", lambda h, bands, rows, a, b: ([hash(h.tobytes())], 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert S.drop_near_duplicates(docs).count() == 2 + 160 - close


def test_fingerprint_links_equal_brute_force(spark):
    rng, sims = random.Random(5), []
    for _ in range(30):
        centre = rng.getrandbits(63)
        sims += [centre, centre, centre ^ (1 << rng.randrange(63)), centre ^ (1 << rng.randrange(63)) ^ 7]
    nodes = spark.createDataFrame([(1000 + k, x) for k, x in enumerate(sims)], "node long, sim long")
    group = list(range(len(sims)))

    def join(a, b):
        old, new = group[a], group[b]
        group[:] = [new if g == old else g for g in group]

    for r in S.fingerprint_links(nodes, 4).collect():
        assert (sims[r.a - 1000] ^ sims[r.b - 1000]).bit_count() <= 4
        join(r.a - 1000, r.b - 1000)
    assert all(group[a] == group[b] for a in range(len(sims)) for b in range(a) if (sims[a] ^ sims[b]).bit_count() <= 4)
