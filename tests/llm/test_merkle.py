import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from ridgeline.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def up(nodes, k):
    return [sha("".join(nodes[i : i + k])) for i in range(0, len(nodes), k)]


def path(nodes, at, k):
    """The runs on the way from a node to the root: what stands before it, what after."""
    out = []
    while len(nodes) > 1:
        lo = at // k * k
        out.append((nodes[lo:at], nodes[at + 1 : lo + k]))
        nodes, at = up(nodes, k), at // k
    return out, nodes[0]


def by_hand(rows, k, later):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    for t in order:
        trees[t].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    subs = [path([leaf(r) for r in trees[t]], 0, k)[1] for t in order]
    out = []
    for i, t in enumerate(order):
        leaves = [leaf(r) for r in trees[t]]
        high, root = path(subs, i, k)
        for at, r in enumerate(trees[t]):
            low, _ = path(leaves, at, k)
            now = leaf(later(r))
            for before, after in low + high:
                now = sha("".join([*before, now, *after]))
            proof = sha("".join(x for b, a in low + high for x in b + a))
            out.append((r[0], leaves[at], subs[i], root, proof, now, now == root))
    return sorted(map(str, out))


def corpus(n=150):
    rows = [(i * 7 % n, f"s{i % 4}", ["en", "fr", "é", "z"][min(i % 7, 3)], i, f"text {i}" * (i % 5)) for i in range(n)]
    rows += [(None, None, None, None, None), (None, None, None, None, ""), (3, "s", None, 1, "x"), (9, "", "", 0, "")]
    rows += [(50, "hot", "en", 5, "the same")] * 40 + [(50, "hot", "en", 6, "not quite")] + [(1000, "lone", "lone", 1, "w" * 300_000)]
    return rows


def tampered(r):
    hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
    return (*r[:3], r[3] + 1, r[4]) if hit and r[3] is not None else r


@pytest.mark.parametrize(("k", "band"), [(2, 5), (2, 1), (3, 2), (5, 3)])
def test_brute_force(spark, monkeypatch, k, band):
    monkeypatch.setattr(merkle, "BAND", band)
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(7).select("*", F.lit(1).alias("leaf"), F.lit("x").alias("tree"), F.lit(2).alias("PID"))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = merkle.manifest(docs, group=k, changed={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    rows = got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(str(tuple(r)) for r in rows) == by_hand(corpus(), k, tampered)
    assert {r["verified"] for r in rows} == {True, False}


def test_proofs_say_where_siblings_stand(spark):
    docs = spark.createDataFrame([r for r in corpus() if r[2] == "z"][:11], SCHEMA)
    got = merkle.manifest(docs).orderBy("doc_id").first()
    assert [(s["level"], s["slot"]) for s in got["proof"]] == [(0, 1), (1, 1), (2, 1), (3, 1)]
    assert got["verified"]


def test_one_row_and_none(spark):
    one = [(5, "s", "en", 4, "four")]
    got = merkle.manifest(spark.createDataFrame(one, SCHEMA)).first()
    assert got["leaf"] == got["subroot"] == got["root"] == leaf(one[0])
    assert got["proof_sha256"] == sha("") and got["verified"]
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(spark.createDataFrame(one, SCHEMA), group=1)
