import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ridgeline.llm import simhash


def print_of(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes(prints, t):
    names = sorted(prints)
    x = np.array(names, np.uint64)
    parent = {p: p for p in names}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, j in zip(*np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= t, 1))):
        parent[find(names[i])] = find(names[j])
    return {p: find(p) for p in names}


def by_hand(rows, t=3):
    prints = [print_of(text) for _, text in rows]
    label = classes(set(prints), t)
    least = {}
    for (key, _), p in zip(rows, prints):
        if key is not None:
            least[label[p]] = min(key, least.get(label[p], key))
    return sorted(str((key, f"{p:016x}", least.get(label[p]))) for (key, _), p in zip(rows, prints))


def corpus():
    rng = random.Random(3)
    voc = ["".join(rng.choice("abcdéfgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    base = [[rng.choice(voc) for _ in range(rng.choice([1, 2, 3, 4, 40, 200, 600]))] for _ in range(80)]
    rows = [(i, " ".join(t)) for i, t in enumerate(base)]
    for i in range(150):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2])):
            t[rng.randrange(len(t))] = rng.choice(voc)
        rows.append((200 + i, "  ".join(t).upper() if i % 2 else "\n".join(t)))
    rows += [(-5, rows[3][1])] * 60 + [(900, None), (901, ""), (902, " \t\x0b"), (None, rows[7][1]), (None, "nobody else says so"), (7, "an id again"), (903, "word " * 70_000), (904, "a b")]
    return rows


def test_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(0).alias("FP"), F.lit("r").alias("raw"), F.lit(1).alias("id"))
    got = simhash.simhash_classes(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(str(tuple(r)) for r in got.collect()) == by_hand(rows)
    assert simhash.simhash_classes(docs.where("false")).count() == 0


@pytest.mark.parametrize("blocks", [simhash.COARSE, simhash.FINE, (63, 1), (9,) * 7 + (1,)])
def test_whoever_is_near_meets_at_home(blocks):
    """Every word has one home, within the code's radius, and whoever is within t bits of it is dealt to that home."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 400, dtype=np.uint64)
    for t in (1, 3):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(64, rng.integers(0, t + 1), replace=False):
                y[i] ^= np.uint64(1) << np.uint64(b)
        owner, anchor, over = simhash.anchors(x, blocks, t)
        assert np.bincount(owner[over == 0], minlength=len(x)).tolist() == [1] * len(x)
        home = dict(zip(owner[over == 0].tolist(), anchor[over == 0].tolist()))
        owner, anchor, _ = simhash.anchors(y, blocks, t)
        met = set(zip(owner.tolist(), anchor.tolist()))
        assert all((i, home[i]) in met for i in range(len(x)))


@pytest.mark.parametrize(("blocks", "homes", "guests"), [(simhash.COARSE, 1 << 14, 1 << 19), (simhash.FINE, 5, 1 << 19), (simhash.COARSE, 7, 11)])
def test_clusters_and_cut_regions(spark, monkeypatch, blocks, homes, guests):
    """A cluster of hundreds of near fingerprints, chains, and words far from all, with regions cut both ways."""
    monkeypatch.setattr(simhash, "HOMES", homes)
    monkeypatch.setattr(simhash, "GUESTS", guests)
    rng = random.Random(5)
    heart, prints = rng.getrandbits(64), {0, 2**64 - 1}
    for _ in range(250):
        prints.add(heart ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    chain = rng.getrandbits(64)
    for _ in range(60):
        chain ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        prints.add(chain)
    prints |= {rng.getrandbits(64) for _ in range(60)}
    table = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long").repartition(3)
    found = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(table, 3, blocks).collect()]
    assert all((a ^ b).bit_count() <= 3 and a != b for a, b in found)
    assert len(found) < 12 * len(prints) if homes > 100 else True  # no link for every pair of the cluster
    want, parent = classes(prints, 3), {p: p for p in prints}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in found:
        parent[find(a)] = find(b)
    groups = lambda of: sorted(sorted(p for p in prints if of(p) == g) for g in {of(p) for p in prints})
    assert groups(find) == groups(want.get)


def test_unfit_blocks(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3, (32, 32))
