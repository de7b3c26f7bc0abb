import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, rank int, score double"


def by_hand(rows, k=5):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % 50 == 0:
            near = sorted(((-float((q * v).sum() / (math.sqrt((v * v).sum()) * math.sqrt((q * q).sum()))), j) for j, v in ok if j != i), key=lambda x: (round(x[0], 12), x[1]))
            out[i] = [j for _, j in near[:k]]
    return out


def run(spark, rows, **kw):
    got = neighbours.search(spark.createDataFrame(rows, SCHEMA).repartition(5), F.col("vec_id") % 50 == 0, **kw).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["rank"] == len(out[r["query_id"]])
    return out, got


def test_recall_over_clusters(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 32))
    rows = [(i, (centres[rng.integers(30)] + 0.4 * rng.normal(size=32)).tolist(), 0, 0.0) for i in range(4000)]
    got, raw = run(spark, rows)
    want = by_hand(rows)
    assert set(got) == set(want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values())) >= 0.95
    v = {i: np.array(x, np.float32).astype(float) for i, x, *_ in rows}
    for r in raw[:50]:
        a, b = v[r["query_id"]], v[r["vec_id"]]
        assert r["score"] == pytest.approx(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), abs=1e-14)


def test_ties_and_unusable_vectors(spark):
    one = [1.0, 0.0, 0.0, 0.0]
    rows = [(i, one, 0, 0.0) for i in range(300)] + [(1000, None, 0, 0.0), (1050, [0.0] * 4, 0, 0.0), (1100, [1.0, None, 0.0, 0.0], 0, 0.0), (1150, [float("nan"), 1.0, 1.0, 1.0], 0, 0.0), (1200, [float("inf"), 1.0, 1.0, 1.0], 0, 0.0), (None, one, 0, 0.0), (1250, [1.0, 1.0], 0, 0.0)]
    got, _ = run(spark, rows)
    assert set(got) == {0, 50, 100, 150, 200, 250}
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == [0, 1, 2, 3, 4]


def test_hot_list_is_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 64)
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0, 4.0], 0, 0.0) for i in range(400)] + [(1000 + i, rng.normal(size=4).tolist(), 0, 0.0) for i in range(60)]
    got, _ = run(spark, rows)
    assert got[100] == [0, 1, 2, 3, 4]


def test_few_and_no_rows(spark):
    got, _ = run(spark, [(0, [1.0, 0.0], 0, 0.0), (1, [0.5, 0.5], 0, 0.0), (2, [0.0, 1.0], 0, 0.0)])
    assert got == {0: [1, 2]}
    assert run(spark, [(0, [1.0, 0.0], 0, 0.0)])[0] == {}
    assert neighbours.search(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


@pytest.mark.parametrize("kind", ["queries apart", "tight groups"])
def test_recall_where_queries_or_groups_are_unlike_the_rest(spark, kind):
    """Queries away from all clusters need more lists than rows within them; in tight groups codes can't tell neighbours apart."""
    rng, n, dim = np.random.default_rng(2), 6000, 64
    if kind == "queries apart":
        x = rng.normal(size=(30, dim))[rng.integers(30, size=n)] + 0.2 * rng.normal(size=(n, dim))
        x[::50] = rng.normal(size=(len(x[::50]), dim))
    else:
        centres, at = rng.normal(size=(2000, dim)), np.minimum(rng.zipf(1.3, n), 2000) - 1
        x = centres[at] + 0.01 * rng.normal(size=(n, dim))
    x = x.astype(np.float32).astype(float)
    got, _ = run(spark, [(i, v.tolist(), 0, 0.0) for i, v in enumerate(x)])
    u, hits = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    for q in range(0, n, 50):
        near = u @ u[q]
        near[q] = -2
        hits += sum(near[v] >= np.sort(near)[-5] - 1e-12 for v in got[q])
    assert hits >= 0.97 * 5 * len(got)
