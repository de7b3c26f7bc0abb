import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from ridgeline.llm import substrings, suffixes


def test_suffix_arrays_against_sorting(monkeypatch):
    rng = np.random.default_rng(0)
    for trial in range(300):
        monkeypatch.setattr(suffixes, "SPARSE", (1, 200, 10**9)[trial % 3])
        t = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(0, 60))).astype(np.uint8)
        if trial % 4 == 0:
            t = np.tile(t[:7], 9)
        s = t.tolist()
        order = suffixes.suffix_array(t)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        shared = suffixes.permuted_common_prefixes(t, order)
        for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
            k = 0
            while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
                k += 1
            assert shared[b] == k


def test_reduced_strings_recurse(monkeypatch):
    """A long text's reduced string, over many names, is sorted by recursion down to distinct names."""
    depth, whole = [], suffixes._reduced
    monkeypatch.setattr(suffixes, "_reduced", lambda r, sigma: depth.append(len(r)) or whole(r, sigma))
    rng = np.random.default_rng(8)
    t = np.concatenate([rng.integers(97, 101, 4000), np.tile(rng.integers(97, 123, 300), 9)]).astype(np.uint8)
    t = np.concatenate([t, t[100:3000]])
    s = t.tobytes()
    assert suffixes.suffix_array(t).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    assert len(depth) >= 2 and depth == sorted(depth, reverse=True)


def test_wide_alphabet():
    t = np.random.default_rng(1).integers(0, 100_000, 500)
    assert suffixes.suffix_array(t).tolist() == sorted(range(500), key=lambda i: t[i:].tolist())


def by_hand(rows, w=200):
    at = defaultdict(int)
    for _, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - w + 1):
            at[b[i : i + w]] += 1
    out = []
    for k, t in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for i in range(len(b) - w + 1):
            if at[b[i : i + w]] > 1:
                m[i : i + w] = b"\1" * w
        spans = sum(1 for i in range(len(b)) if m[i] and (not i or not m[i - 1]))
        out.append((k, len(b), sum(m), spans, hashlib.sha256(bytes(c for c, x in zip(b, m) if not x)).hexdigest()))
    return sorted(map(str, out))


def corpus():
    rng = random.Random(5)
    voc = ["".join(rng.choice("abcdefghijkmé") for _ in range(rng.randint(1, 8))) for _ in range(2000)]
    txt = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    passages, hot, rows = [txt(rng.randint(30, 120)) for _ in range(6)], txt(60), []
    for i in range(200):
        t = txt(rng.randint(0, 120))
        if i % 3 == 0:
            t = t[: rng.randint(0, len(t))] + hot + t[rng.randint(0, len(t)) :]
        if i % 7 == 0:
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            t += p[a : a + rng.randint(150, 400)] + txt(20)
        rows.append((i, t))
    for i in range(40):
        t = rng.choice(rows[:200])[1]
        if t:
            j = rng.randrange(len(t))
            rows.append((1000 + i, t[:j] + rng.choice("xyz") + t[j + rng.randint(0, 2) :]))
    return rows + [(2000, "a" * 500), (2001, "ab" * 150), (2002, "ab" * 130), (2003, None), (2004, ""), (None, rows[0][1]), (None, rows[5][1]), (2005, rows[3][1]), (2005, rows[3][1]), (2006, "q" * 199), (2007, "q" * 199), (2008, txt(300) + "z" * 199)]


@pytest.mark.parametrize("together", [16, 1024])
def test_removal_against_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(substrings, "TOGETHER", together)
    rows = corpus()
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, raw string, h int").repartition(5)
    got = substrings.digest(substrings.remove_repeats(df)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(str(tuple(r)) for r in got) == by_hand(rows)


def test_long_text_in_parts(monkeypatch):
    rng = random.Random(2)
    t = "".join(rng.choice("abcdef ") for _ in range(40_000)).encode()
    whole = sorted(zip(*(x.tolist() for x in next(iter(substrings._document_anchors([t], 200, 64)))[1:])))
    monkeypatch.setattr(substrings, "PIECE", 4096)
    parts = sorted(x for p in substrings._document_anchors([t], 200, 64) for x in zip(*(c.tolist() for c in p[1:])))
    assert parts == whole


def test_a_gram_whose_hash_is_least_of_all_is_an_anchor(spark, monkeypatch):
    """Hashes with an empty upper half once meant that a window had no anchor."""
    monkeypatch.setattr(substrings, "_mix", lambda x: x & np.uint64(0xFFFFFFFF))
    rows = corpus()[:60] + [(9000, "z" + corpus()[0][1]), (9001, "y" + corpus()[3][1] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.digest(substrings.remove_repeats(df)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(str(tuple(r)) for r in got) == by_hand(rows)


def test_no_rows(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_each_window_has_one_anchor():
    """Contexts reach no further than the windows whose least-hashed gram an anchor is, and so each window is looked at once."""
    texts = [np.random.default_rng(i).integers(0, 256, n, dtype=np.uint8) for i, n in enumerate((199, 200, 5000, 1234))]
    ends = np.cumsum([len(t) for t in texts])
    at, _, _, around = substrings.anchors(np.concatenate(texts), ends, 200, 96)
    first, last = at - (around >> 16), at - (around & 0xFFFF)
    assert sorted(w for a, b in zip(first.tolist(), last.tolist()) for w in range(a, b + 1)) == [w for t, e in zip(texts, ends.tolist()) for w in range(e - len(t), e - 199)]
