import random
import re

import numpy as np
import pytest

from ridgeline.llm import jaccard, shingles
from ridgeline.llm.shingles import overlap, shingle_sets


def by_hand(rows, k=4, percent=85):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j]:
                c = len(a & sets[j])
                if 100 * c >= percent * (len(a) + len(sets[j]) - c):
                    parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(str((key, len(sets[i]), least.get(find(i)))) for i, (key, _) in enumerate(rows))


def corpus():
    rng = random.Random(7)
    voc = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(1500)]
    txt = lambda n: [rng.choice(voc) for _ in range(n)]

    def edit(t, n):
        t = list(t)
        for _ in range(n):
            t[rng.randrange(len(t))] = rng.choice(voc)
        return t

    passage, rows = txt(30), []
    for i in range(250):
        t = txt(rng.choice([0, 1, 2, 3, 4, 5, 9, 20, 50, 120]))
        rows.append((i, " ".join(t + passage + txt(rng.randint(0, 40)) if i % 3 == 0 else t)))
    for i in range(150):
        t = rng.choice(rows[:250])[1].split()
        if t:
            rows.append((1000 + i, " ".join(edit(t, rng.randint(0, 4))).upper()))
    long, short = txt(150), txt(12)
    rows += [(2000 + i, " ".join(edit(long, rng.choice([0, 1, 2, 3, 4, 5, 8])))) for i in range(90)]
    rows += [(3000 + i, " ".join(edit(short, rng.choice([0, 0, 1])) + txt(rng.choice([0, 1, 2])))) for i in range(50)]
    return rows + [(4000, None), (4000, rows[0][1]), (4001, rows[1][1]), (4001, "other text for the same id altogether"), (None, rows[9][1]), (None, "alone and of no one else at all"), (4002, "\t\n "), (4003, "Solo"), (4004, "solo"), (4005, "SOLO x")]


@pytest.mark.parametrize("few,cell", [(16, 4096), (8, 10)])
def test_classes_against_brute_force(spark, monkeypatch, few, cell):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "CELL", cell)
    rows = corpus()
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n int, digest string").repartition(5)
    assert sorted(str(tuple(r)) for r in jaccard.jaccard_classes(df).collect()) == by_hand(rows)


def test_many_hot_elements_are_joined(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_KEYS", 0)
    monkeypatch.setattr(jaccard, "FEW_KEYS", 0)
    monkeypatch.setattr(jaccard, "FEW", 4)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(tuple(r)) for r in jaccard.jaccard_classes(df).collect()) == by_hand(rows)


def near_copies(n, spread, seed):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    out = []
    for i in range(n):
        t = list(base)
        for _ in range(rng.randint(0, spread)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        out.append((i, " ".join(t)))
    return out


@pytest.mark.parametrize("few,cell,members", [(16, 4096, 4096), (8, 20, 5)])
def test_links_across_regions(spark, monkeypatch, few, cell, members):
    """Copies that lie around the threshold from each other, in one crowded region."""
    for name, value in {"FEW": few, "CELL": cell, "MEMBERS": members}.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = near_copies(200, 9, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(str(tuple(r)) for r in jaccard.jaccard_classes(df).collect()) == by_hand(rows)


def test_a_large_cell_takes_no_rounds(spark, monkeypatch):
    """Near copies, most of them unlinked, in cells of more members than one task joins: chunks meet two by two, at once."""
    rows, tables, kept = near_copies(300, 12, 8), [], jaccard.written
    monkeypatch.setattr(jaccard, "FEW", 4)
    monkeypatch.setattr(jaccard, "CELL", 60)
    monkeypatch.setattr(jaccard, "written", lambda df, name: tables.append(name) or kept(df, name))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(str(tuple(r)) for r in jaccard.jaccard_classes(df).collect()) == by_hand(rows)
    assert "regions-of-several" in tables and "to-pivots" not in tables and len(tables) < 60


def test_hot_elements_beyond_the_old_bound_are_shipped(spark):
    assert jaccard.HOT_KEYS >= 1_000_000
    hot = spark.range(1000).selectExpr("1000 - id * 2 AS k")
    assert jaccard._shipped(hot).value.tolist() == list(range(-998, 1001, 2))
    assert jaccard._shipped(hot.where("k > 5000")).value.tolist() == []


@pytest.mark.parametrize("percent", [30, 95])
def test_other_thresholds(spark, percent):
    rows = near_copies(60, 12, 5) + corpus()[:200:4]
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent)
    assert sorted(str(tuple(r)) for r in got.collect()) == by_hand(rows, 4, percent)


def test_regular_words_are_not_equal(spark):
    """Complementary Thue-Morse words, which collide under polynomial hashes modulo powers of two."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    rows = [(1, one), (2, one.translate({97: "b", 98: "a"})), (3, one + " " + one), (4, "x")]
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(str(tuple(r)) for r in got.collect()) == by_hand(rows)


def test_other_shingles_and_threshold(spark):
    rows = corpus()[:400:2]
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, percent=80)
    assert sorted(str(tuple(r)) for r in got.collect()) == by_hand(rows, 5, 80)


def test_a_very_long_text(spark):
    long = [f"w{i}" for i in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-1000])), (3, " ".join(long[30_000:])), (4, " ".join(long[:1000]))]
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(str(tuple(r)) for r in got.collect()) == by_hand(rows)


def test_linked_sets_share_a_part_key():
    rng = np.random.default_rng(4)
    for _ in range(400):
        n = int(rng.integers(2, 300))
        x = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
        drop = int(rng.integers(0, max(1, n // 6)))
        y = np.concatenate([x[drop:], rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 12))), dtype=np.uint64)])
        x, y = np.unique(x), np.unique(y)
        c = overlap(x, y)
        if 100 * c >= 85 * (len(x) + len(y) - c) and not np.array_equal(x, y):
            assert set(jaccard.part_keys(x, 85).tolist()) & set(jaccard.part_keys(y, 85).tolist())


def test_sets_of_words():
    a, b, c, d = shingle_sets([b"One two  three", b"one TWO\tthree\n", b"", b"\xc3\x89 x y z w"], 4)
    assert np.array_equal(a, b) and len(a) == 1 and len(c) == 0 and len(d) == 2


def test_sets_of_many_texts_are_made_together(monkeypatch):
    """Against sets of tuples, across pieces; words of up to 64 bytes are hashed in arrays, and no worker keeps any."""
    rng = random.Random(11)
    word = lambda: bytes(rng.choice(b"abAB\x00\xff") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 64])))
    texts = [b" ".join(word() for _ in range(rng.randint(0, 12))) for _ in range(500)] + [b"", b" \t", b"a a\x00 a", b"x\x1cy \xc2\xa0 z"]
    monkeypatch.setattr(shingles, "PIECE", 2000)
    monkeypatch.setattr(shingles, "xxhash", None)
    for k in (1, 4):
        hashed, plain = {}, {}
        for t, s in zip(texts, shingle_sets(texts, k), strict=True):
            w = t.lower().split()
            own = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset({tuple(w)} if w else ())
            assert len(own) == len(s) and (s[1:] > s[:-1]).all()
            assert hashed.setdefault(own, s.tobytes()) == s.tobytes() and plain.setdefault(s.tobytes(), own) == own


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {r["label"] for r in jaccard.components(spark, links).where("v <= 60").collect()} == {0}


def test_no_rows(spark):
    assert jaccard.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
