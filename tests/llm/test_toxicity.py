import math
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ridgeline.llm import registry, toxicity

BAD = ["idiot", "scum", "vequte"]


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    out = []
    for i in range(n):
        t = [word() for _ in range(rng.randint(5, 80))]
        if i % 9 == 0:
            for _ in range(rng.randint(1, 3)):
                t.insert(rng.randrange(len(t)), rng.choice(BAD))
        elif i % 90 == 1:
            t += ["scum", "bucket"]  # an innocent phrase
        out.append((i, " ".join(t), int(i % 9 == 0)))
    return out


@pytest.fixture(scope="module")
def learned(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (2, None, 1)], "doc_id long, toxic int, quality int")
    return toxicity.fit(docs, labels), docs, labels, rows


def test_held_out_accuracy(spark, learned):
    lexicon, docs, _, rows = learned
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, lexicon, [F.col("doc_id")]).withColumn("out", toxicity.held_out(F.col("doc_id"))).collect()}
    out = [(got[i]["score"] >= 0.5, y) for i, _, y in rows if got[i]["out"]]
    assert sum(bool(a) == bool(b) for a, b in out) / len(out) > 0.97
    assert all(got[i]["out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows) and all(0 <= r["score"] <= 1 for r in got.values())


def match_by_hand(lexicon, text):
    """Every entry tried at every place."""
    low = toxicity.folded(text)
    starts = [i for i in range(len(low)) if i == 0 or not low[i - 1].isalnum()]
    whole = lambda i, w: low.startswith(w, i) and not low[i + len(w) : i + len(w) + 1].isalnum()
    spared = [(i, i + len(w)) for i in starts for w in lexicon.exceptions if whole(i, w)]
    heaviest = {}
    for i in starts:
        for w, x in lexicon.weights.items():
            end = i + len(w.rstrip("*"))
            if (low.startswith(w[:-1], i) if w.endswith("*") else whole(i, w)) and not any(a <= i and end <= b for a, b in spared):
                heaviest[i] = max(x, heaviest.get(i, 0.0))
    return sum(heaviest.values()), len(heaviest)


def test_matches_against_trying_all(learned):
    rng = random.Random(3)
    for lexicon in (learned[0], toxicity.Lexicon({"ab": 1.0, "abc": 2.0, "abc*": 3.0, "abcd": 0.5, "b": 4.0, "cab*": 1.5}, frozenset({"ab b", "b abc", "abc abc"}))):
        match, parts = lexicon.matcher().match, [*lexicon.weights, *lexicon.exceptions, "ab", "abc", "abcd", "b", "c", "x", "4bc", "а", "!", "'"]
        for _ in range(300):
            text = "".join(rng.choice(parts).rstrip("*") + rng.choice([" ", " ", "", "-", "\n", "\u00ad"]) for _ in range(rng.randint(0, 8)))
            total, hits = match(text)
            assert (pytest.approx(total), hits) == match_by_hand(lexicon, text), text


def test_weights_against_counting(learned):
    lexicon, _, _, rows = learned
    told = [(y, toxicity.terms(toxicity.tokens(t))) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    toxic, clean = ([w for y, w in told if y == k] for k in (1, 0))
    want = {}
    for w in set().union(*toxic):
        a, b = sum(w in t for t in toxic), sum(w in t for t in clean)
        odds = math.log((a + 0.1) / (len(toxic) + 0.2)) - math.log((b + 0.1) / (len(clean) + 0.2))
        if a >= toxicity.LEAST and odds >= toxicity.WEIGHT:
            want[w] = odds
    assert lexicon.weights == pytest.approx(want)


def test_disguises_and_exceptions(learned):
    score = learned[0].matcher()
    filler = "abc defg hij " * 3
    for bad in ("idiot", "IDIOT", "1d10t", "іdіоt", "ｉｄｉｏｔ", "id​iot", "$cum", "ŝcum!"):
        assert score(filler + bad + " abc")[0] >= 0.5, (bad, score(filler + bad), learned[0])
    for fine in ("", filler, "scum bucket", "idiotxyz" if "idio*" not in learned[0].weights else "abc", "subscum"):
        assert score(fine)[0] < 0.5, (fine, score(fine), learned[0].bias, learned[0].slope, score.match(fine))


def test_held_out_labels_play_no_part(spark, learned):
    lexicon, docs, labels, _ = learned
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, flipped)
    assert again.weights == lexicon.weights and again.bias == pytest.approx(lexicon.bias)


def test_edges(spark, learned):
    lexicon, docs, labels, _ = learned
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "x" * 200_000)], "doc_id long, text string")
    got = toxicity.score_toxicity(odd, lexicon, [F.col("doc_id")]).collect()
    assert len(got) == 4 and all(r["score"] < 0.5 for r in got)
    assert toxicity.fit(docs, labels.limit(0)).weights == {} and toxicity.score_toxicity(docs.limit(0), lexicon, [F.col("doc_id")]).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_held_out_rows_of_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    got = registry.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    r = got.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")).alias("acc"), F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall")).first()
    assert r["acc"] > 0.98 and r["recall"] > 0.9


def test_texts_beyond_ascii_fold_in_arrays(monkeypatch):
    texts = ["".join(map(chr, range(0x110000))), "\u0130 \uff21b\u200bc \U0001d400 4", "", "plain TEXT 1|"]
    want = [t.lower().translate(toxicity.FOLD) for t in texts]
    words = ["".join(c if c.isalnum() else " " for c in t).split() for t in want]
    toxicity._tables()
    monkeypatch.setattr(toxicity, "FOLD", None)  # no look-up for each character
    assert [toxicity.folded(t) for t in texts[:2]] == want[:2] and [toxicity.tokens(t) for t in texts[:2]] == words[:2]
    monkeypatch.undo()
    assert [toxicity.folded(t) for t in texts] == want and [toxicity.tokens(t) for t in texts] == words


def test_learning_moves_texts_in_small_batches(spark, monkeypatch, learned):
    _, docs, labels, _ = learned
    seen, plain = [], toxicity.map_rows

    def noted(df, make, schema, rows=512, **more):
        seen.append(("array" in schema, rows, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))))
        return plain(df, make, schema, rows=rows, **more)

    monkeypatch.setattr(toxicity, "map_rows", noted)
    toxicity.fit(docs, labels)
    assert len(seen) == 3 and all(batch <= 2000 and (rows <= 64 or not words) for words, rows, batch in seen)
