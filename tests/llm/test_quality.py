import random
import re
from collections import Counter

import numpy as np
import pytest

from ridgeline.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    w = WORD.findall(text or "")
    seen, dup = [], 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.append(line)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            hit.update(range(i, i + 8))
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>") if w else 0, dup, len(hit)


def texts():
    rng = random.Random(0)
    voc = ["a", "bb", "é", "🙂x", "#", "<|", "c", "dd"]
    out = [None, "", " \n\t", "  x", "\x1c\x1dy z", "one"]
    for _ in range(300):
        t = [rng.choice(voc[: rng.randint(2, 8)]) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.4:
            t = t * 2
        out.append("".join(x + rng.choice([" ", " ", "\n", "\t", "  "]) for x in t))
    return out


@pytest.mark.parametrize("text", texts()[:6])
def test_statistics_of_odd_texts(text):
    assert quality.statistics((text or "").encode())[:5] == by_hand(text)


def test_statistics():
    for t in texts():
        assert quality.statistics((t or "").encode())[:5] == by_hand(t), t


def test_verdicts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    clean = [" ".join(word() for _ in range(rng.randint(30, 200))) for _ in range(500)]
    junk = [" ".join(word() + "###" for _ in range(50)) for _ in range(40)]
    rows = [(i, t, "x", True) for i, t in enumerate(clean + junk)] + [(None, "few words", "x", True), (9000, None, "x", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, kept boolean")
    labels = spark.createDataFrame([(i, int(i < 500), 0) for i in range(0, 540, 2)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge_quality(df, labels).toPandas().set_index("doc_id")
    assert got.loc[range(500), "kept"].mean() > 0.97 and got.loc[range(500, 540), "kept"].mean() < 0.2
    assert not got.loc[9000, "kept"] and got.loc[9000, "base_failed"] and len(got) == len(rows)
    plain = quality.judge_quality(df, labels.limit(0)).toPandas()
    assert (plain["kept"] == ~plain["base_failed"]).all()
    assert quality.judge_quality(df.limit(0), labels).count() == 0


def test_forest_isolates_outliers():
    x = np.random.default_rng(1).normal(size=(500, 3))
    forest = quality.IsolationForest.grow(x, np.array([[-9.0] * 3, [9.0] * 3]))
    far, near = forest.score(np.array([[8.0, 8, 8], [0, 0, 0]]))
    assert far > near + 0.2
    assert quality.calibrate(np.array([0.1, 0.2, 0.9]), np.array([1, 1, 0])) == 0.2
    assert quality.calibrate(np.zeros(0), np.zeros(0)) == float("inf")


def test_kinds_that_no_sample_has_are_dropped(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 1)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    clean = [" ".join(word() for _ in range(rng.randint(30, 200))) for _ in range(400)]
    junk = [" ".join(word()[:-1] + "#" for _ in range(rng.randint(30, 200))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(clean + junk)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i < 400)) for i in range(420)], "doc_id long, quality int")
    got = quality.judge_quality(df, labels).toPandas().set_index("doc_id")
    assert got.loc[range(400), "kept"].mean() > 0.97 and not got.loc[range(400, 440), "kept"].any()
    stats = quality.with_statistics(df, [df["doc_id"]])
    x = quality.features(stats.toPandas()[list(quality.STATS)].to_numpy())
    assert np.array_equal(quality.feature_box(stats), np.stack([x.min(0), x.max(0)])) and len(quality.feature_box(stats.limit(0))) == 0


def test_scores_against_walking_the_trees():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    forest = quality.IsolationForest.grow(x, np.array([[-9.0, -9, -9], [9, 9, 9]]), trees=20, per_tree=64)

    def path(tree, row):
        feature, cut, child, depth = tree
        at, steps = 0, 0
        while feature[at] >= 0:
            at, steps = child[at][int(row[feature[at]] > cut[at])], steps + 1
        assert depth[at] >= steps  # the leaf's depth, and what its rows would take further
        return depth[at]

    probes = np.concatenate([x[:50], [[8.0, 8, 8], [-8, 8, 0]]])
    want = [2 ** (-np.mean([path(t, r) for t in forest.trees]) / forest.expected) for r in probes]
    got = forest.score(probes)
    assert np.allclose(got, want) and got[-2:].min() > got[:50].max()


def test_forest_and_threshold_come_from_all_labelled_rows(spark, monkeypatch):
    """However rows are dealt, the forest is that of all rows at hand, the threshold that of all scores, and no bound on labelled rows matters."""
    rng = np.random.default_rng(6)
    score, good = rng.integers(0, 400, 3000) / 400.0, (rng.random(3000) < 0.7).astype(int)
    scored = spark.createDataFrame([(float(s + 0.2 * (1 - g)), int(g)) for s, g in zip(score, good)], "score double, good int").repartition(5)
    pdf = scored.toPandas()
    for keep in (0.9, 0.985, 0.0):
        assert quality.calibrate_over(scored, keep, 1.0) == quality.calibrate(pdf["score"].to_numpy(), pdf["good"].to_numpy(), keep, 1.0)
    words = lambda junk: " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) + "#" * junk for _ in range(40))
    df = spark.createDataFrame([(i, words(i % 10 == 0)) for i in range(400)], "doc_id long, text string").repartition(6)
    stats = quality.with_statistics(df, [df["doc_id"]])
    x, box = quality.features(stats.toPandas()[list(quality.STATS)].to_numpy()), quality.feature_box(stats)
    for a, b in zip(quality.grow_over(stats, box).trees, quality.IsolationForest.grow(x, box).trees):
        assert all(np.array_equal(p, q) for p, q in zip(a, b))
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(400)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "LABELLED", 3, raising=False)
    got = quality.judge_quality(df, labels).toPandas()
    assert (got["kept"] == (got["doc_id"] % 10 > 0)).mean() > 0.97
