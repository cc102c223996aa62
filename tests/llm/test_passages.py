import random

import numpy as np
import pyarrow as pa
from lumenfold.llm import passages as S
from lumenfold.llm import simhash, spans
from lumenfold.llm.minhash import tuned_bands
from lumenfold.llm.simhash import word_hashes

WORDS = [f"{a}{b}" for a in "ka le mi no pu ra se ti".split() for b in "bo da fe gi hu ja".split()]


def windows_of(text):
    """(start, end) of the windows of one text, in characters."""
    found = []
    for _, data, offsets in spans.groups(pa.array([text])):
        got = spans.units(data, offsets, 10**9, (1, 1), (1, 1))
        found += zip(got.start.tolist(), got.end.tolist(), strict=True)
    return found


def paragraphs_of(text, min_words=S.MIN_WORDS):
    at, found = 0, []
    for line in text.split("\n"):
        words = line.encode().split()
        if len(words) >= min_words:
            inner = line.strip(" \t\x0b\x0c\r")
            start = at + line.index(inner)
            found.append((start, start + len(inner)))
        at += len(line) + 1
    return found


def brute_force(rows):
    """Clusters of units by all pairs; units of repeated rows (equal id and text) are at the same place."""
    out = []
    for unit, cut in (("paragraph", paragraphs_of), ("window", windows_of)):
        found = [(i, t, a, b, set(word_hashes(t[a:b], 5, True).tolist())) for i, t in rows for a, b in cut(t or "")]
        group = list(range(len(found)))

        def root(x, group=group):
            while group[x] != x:
                x = group[x]
            return x

        for a in range(len(found)):
            for b in range(a):
                x, y = found[a][4], found[b][4]
                if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and root(a) != root(b) and len(x & y) >= 0.8 * len(x | y):
                    group[root(a)] = root(b)
        clusters = {}
        for k, (i, t, a, b, _) in enumerate(found):
            clusters.setdefault(root(k), []).append((i, t, a, b))
        for own in clusters.values():
            first = min(own, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
            apart = lambda r, first=first: r[:2] != first[:2] or r[2] >= first[3]
            if any(map(apart, own)):
                out += [(i, a, b, len(t[a:b].encode().split()), unit, first[0], first[2], apart((i, t, a, b))) for i, t, a, b in own]
    return sorted(out, key=str)


def less(found):
    """Rows without the first place: windows of one text that overlap need not meet, so it may be a few words off."""
    return sorted((r[:6] + r[7:] for r in found), key=str)


def say(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_bands_reach_the_recall():
    for recall, most in ((S.LINE_RECALL, S.LINE_MINIMA), (S.WINDOW_RECALL, S.WINDOW_MINIMA)):
        bands, rows = tuned_bands(recall=recall, most=most)
        assert 1 - (1 - 0.8**rows) ** bands >= recall and bands * rows <= most


def test_every_shared_run_of_fifty_words_holds_a_shared_window():
    rng = random.Random(5)
    need = spans.WINDOW + spans.GAP - 1
    assert need == 50
    for _ in range(150):
        run = say(rng, need).split()
        texts = []
        for _ in range(2):
            words = say(rng, rng.randint(0, 90)).split() + run + say(rng, rng.randint(0, 90)).split()
            texts.append("".join(w + rng.choice([" ", "\n", "  \t", " "]) for w in words))
        a, b = ({" ".join(t[x:y].split()) for x, y in windows_of(t)} for t in texts)
        assert any(w in " ".join(run) for w in a & b)


def test_words_and_places_of_hostile_texts():
    texts = ["", " \n\t ", "one", "É è mot mot 漢字\x85x", "a" * 5_000_000 + " tail " + "b c " * 700_000, "x\ny", "no space at the end", "begins"]
    got = list(spans.groups(pa.array(texts)))
    assert sum(len(o) - 1 for _, _, o in got) == len(texts)
    for row, data, offsets in got:
        w = spans.words_of(data, offsets)
        own = [x for t in texts[row : row + len(offsets) - 1] for x in t.encode().lower().split()]
        assert len(own) == len(w.hash) and len(set(own)) == len(np.unique(w.hash))
        assert [bytes(data[a:b]).lower() for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)] == own


def test_planted_passages(spark):
    rng = random.Random(1)
    passage = say(rng, 60)
    w = passage.split()
    w[30] = "changed"
    near = " ".join(w)
    rows = [(i, say(rng, 40) + "\n" + say(rng, 30)) for i in range(30)]
    rows += [(100 + i, say(rng, 30) + "\n" + passage + "\n" + say(rng, 28)) for i in range(4)] + [(110, near.upper()), (111, "\t" + passage.replace(" ", "  "))]
    inside, across = say(rng, 30) + " " + passage + " " + say(rng, 200), say(rng, 9) + "\n" + passage.replace(" ", "\n") + "\n" + say(rng, 3)
    rows += [(200, None), (201, ""), (None, passage), (202, "short line\nshort line"), (100, say(rng, 5)), (203, rows[0][1]), (203, rows[0][1]), (300, inside), (301, "é " + across), (302, "word " * 500)]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, node int, u int")
    got = sorted((tuple(r) for r in S.repeated_passages(docs).collect()), key=str)
    assert less(got) == less(brute_force(rows))
    assert {r[0] for r in got} == {0, 100, 101, 102, 103, 110, 111, 203, 300, 301, None}
    texts = dict(rows[30:])
    for i, a, b, n, *_ in got:
        if i in (300, 301):
            assert " ".join(texts[i][a:b].split()) in passage and n == spans.WINDOW
    assert S.repeated_passages(docs.limit(0)).count() == 0


def test_whole_table_close_to_brute_force_and_whatever_the_partitions(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got, wanted = {tuple(r) for r in S.op3_substring_dedup(spark, sf).collect()}, set(brute_force(rows))
    assert len(set(less(got)) & set(less(wanted))) >= 0.99 * len(wanted) and len(got) <= 1.01 * len(wanted)
    dealt = S.repeated_passages(spark.read.parquet(f"{sf}/documents.parquet").repartition(13))
    assert {tuple(r) for r in dealt.collect()} == got


def test_true_copies_in_a_family_of_a_template(spark):
    """Paragraphs at a similarity of 0.65 or so, each with one near copy: closer false candidates cost no true link."""
    rng = random.Random(7)
    base, rows = [f"w{k}" for k in range(100)], []
    for f in range(60):
        w = list(base)
        at = rng.randrange(86)
        w[at : at + 14] = [f"own{f}x{k}" for k in range(14)]
        near = list(w)
        near[(at + 50) % 90] = f"near{f}"
        near[(at + 30) % 90] = f"also{f}"
        rows += [(f, " ".join(w)), (1000 + f, " ".join(near))]
    wanted = [r for r in brute_force(rows) if r[4] == "paragraph"]
    assert len({r[5] for r in wanted}) > 20
    got = S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.where("unit = 'paragraph'").collect()), key=str) == wanted


def test_large_groups_are_dealt_whole(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_ROWS", 4)
    test_true_copies_in_a_family_of_a_template(spark)
    test_planted_passages(spark)
