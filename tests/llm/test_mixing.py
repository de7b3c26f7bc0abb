import random

import pytest
from pyspark.sql import functions as F

from ridgeline.llm import mixing
from ridgeline.llm.common import n_words

SCHEMA = "doc_id long, text string, source string, size long, h long, s string"


def targets_by_hand(sizes, weights=(5, 2, 1), most=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > most * sizes[s] + 1e-9]
        if not over:
            out.update({s: level * w[s] for s in open_})
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def rows(n=3000, seed=2):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * rng.choice([0, 1, 3, 10, 40])) if i % 50 else None, rng.choice(["a", "a", "a", "a", "b", "c", "d", "é", None]), 1, 1, "x") for i in range(n)]


def test_targets_and_closeness(spark):
    data = rows()
    got = mixing.mix(spark.createDataFrame(data, SCHEMA).repartition(5), n_words("text"), ["doc_id"]).select("row.doc_id", "row.source", "size", "source_size", "target", "taken", "copies").collect()
    assert len(got) == len(data)
    sizes = {}
    for r in got:
        assert r["size"] == len((data[r["doc_id"]][1] or "").split())
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = targets_by_hand(sizes)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert own[0]["source_size"] == sizes[s] and own[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 40
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in got)


def test_same_for_any_partitions_and_nested_in_budget(spark):
    df = spark.createDataFrame(rows(800), SCHEMA)
    take = lambda d, share=1.0: {r["doc_id"]: r["copies"] for r in mixing.mix(d, n_words("text"), ["doc_id"], share=share).select("row.doc_id", "copies").collect()}
    whole = take(df.repartition(3))
    assert whole == take(df.repartition(7, "source"))
    less = take(df, 0.5)
    assert all(less[k] <= whole[k] for k in whole)


def test_a_broken_number_of_copies(spark):
    got = mixing.mix(spark.createDataFrame(rows(2000), SCHEMA), n_words("text"), ["doc_id"], most=2.5).select("row.source", "size", "target", "source_size", "taken", "copies").collect()
    want = targets_by_hand({r["source"]: r["source_size"] for r in got}, most=2.5)
    for s in want:
        own = [r for r in got if r["source"] == s]
        assert own[0]["target"] == pytest.approx(want[s]) and abs(sum(r["taken"] for r in own) - want[s]) <= 40
    assert max(r["copies"] for r in got) == 3


def test_a_very_long_text(spark):
    data = [(1, "w " * 300_000, "a", 0, 0, ""), (2, "w", "a", 0, 0, ""), (3, "w " * 1000, "b", 0, 0, "")]
    got = {r["doc_id"]: r["size"] for r in mixing.mix(spark.createDataFrame(data, SCHEMA), n_words("text"), ["doc_id"]).select("row.doc_id", "size").collect()}
    assert got == {1: 300_000, 2: 1, 3: 1000}


def test_edges(spark):
    none = mixing.mix(spark.createDataFrame([], SCHEMA), n_words("text"), ["doc_id"])
    assert none.count() == 0
    empty = mixing.mix(spark.createDataFrame([(1, None, "a", 0, 0, ""), (2, "", None, 0, 0, "")], SCHEMA), n_words("text"), ["doc_id"])
    assert [r["taken"] for r in empty.collect()] == [0, 0]
    same = mixing.mix(spark.createDataFrame([(None, "a b", "a", 0, 0, "")] * 9 + [(5, "x", "b", 0, 0, "")], SCHEMA), n_words("text"), ["doc_id"])
    assert len({r["copies"] for r in same.where(F.col("row.doc_id").isNull()).collect()}) == 1


@pytest.mark.parametrize("key", [7, None])
def test_a_key_with_most_rows_is_split(spark, key):
    data = [(key, f"w{i} x y z", "a", 0, 0, "") for i in range(600)] + [(1000 + i, "u v", "b", 0, 0, "") for i in range(60)]
    got = mixing.mix(spark.createDataFrame(data, SCHEMA).repartition(4), n_words("text"), ["doc_id"]).select("row.source", "target", "taken").collect()
    for s in "ab":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 4
