import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridgeline.llm import spelling


def one_error(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(rows, least=7, times=2, factor=10, noise=31):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if noise and h % noise == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= least
    n = {w: c for w, c in n.items() if c >= times}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_error(v, w)] for w in n}
    form = {}
    for w, those in near.items():
        best = min(those, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= factor * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append(str((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)))
    return sorted(out)


def corpus():
    rng = random.Random(2)
    letters = "abcdeé"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 13))) for _ in range(60)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(base[: 1 + rng.randrange(60)])
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                p = rng.randrange(len(w))
                w = w[:p] + rng.choice(["", rng.choice(letters), w[p] + rng.choice(letters)]) + w[p + 1 :]
            words.append(w.title() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", ", ", "1", "\n"]).join(words)))
    rows += [(3, rows[3][1])] * 20 + [(None, rows[5][1]), (None, None), (400, None), (401, ""), (402, "123 --"), (403, "ÀÉÎõü×÷ ÀÉÎõü×÷ ÀÉÎõü×y straße-straßes ELEVENTHS eleventhş"), (404, "aaaaaaaab" * 40_000), (405, " ".join(["letterbox", "letterbax"] * 9))]
    return rows


@pytest.mark.parametrize("shard", [spelling.SHARD, 2])
def test_brute_force(spark, monkeypatch, shard):
    """Also with shards cut again and again, until there is nothing left to halve."""
    monkeypatch.setattr(spelling, "SHARD", shard)
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(5).select("*", F.lit("x").alias("word"), F.lit(1).alias("N"), F.lit(2).alias("id"))
    got = spelling.variants(docs, noise=31)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = got.collect()
    assert sorted(str(tuple(r)) for r in rows) == by_hand(corpus())
    assert any(r["form"] and r["root"] != r["form"] for r in rows) or any(r["form"] for r in rows)


def test_other_bounds_and_chains(spark):
    rows = [(1, "abcd " * 400 + "abce " * 40 + "abfe " * 4 + "agfe " + "x y z xy " * 3)]
    for least in (1, 4):
        got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), least=least, times=1)
        assert sorted(str(tuple(r)) for r in got.collect()) == by_hand(rows, least, 1, 10, 0)
    found = {r["word"]: r["root"] for r in got.collect()}
    assert found["abfe"] == found["abce"] == "abcd"


def test_no_rows(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=7), min_size=1, max_size=40))
def test_automaton(words):
    words = sorted(words)
    a = spelling.Automaton(words)
    assert [a.number(a.root, w, 0) for w in words] == list(range(len(words)))
    assert a.number(a.root, "zz", 0) == -1
    for w in words:
        for exact in (0, len(w) // 2):
            want = {k for k, v in enumerate(words) if v[:exact] == w[:exact] and len(v) >= len(w) and one_error(v, w)}
            assert a.near(w, exact) >= want and all(one_error(words[k], w) for k in a.near(w, exact))
    states = {(f, tuple(sorted((c, t) for c, (t, _) in arcs.items()))) for f, arcs in zip(a.final, a.arcs)}
    assert len(states) == len(a.arcs)  # no two states alike
