import base64
import os

import pytest

from ridgeline.llm import tokencounts as tc
from ridgeline.llm.registry import VOCABULARY

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
TEXTS = [None, "", "hello world", "hello world", "é🙂" * 50, "a" * 5000, "it's <|endoftext|> fine\n\n  x"] + [f"doc {i} " * (i % 13) for i in range(200)]


def lengths():
    import tiktoken

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    code = tiktoken.Encoding("t", pat_str=tc.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [len(code.encode_ordinary(t or "")) for t in TEXTS]


def test_histogram(spark, monkeypatch):
    monkeypatch.setattr(tc, "BLOCK", 8)
    df = spark.createDataFrame([(t, 1, 2) for t in TEXTS], "text string, docs int, tokens int").repartition(4)
    counts = tc.encoded(df, VOCABULARY)
    n = lengths()
    assert sorted(r[0] for r in counts.collect()) == sorted(n)
    hist = tc.length_histogram(counts).cache()
    for r in hist.collect():
        at = r["n_tokens"]
        assert r["docs"] == n.count(at) and r["tokens"] == at * n.count(at)
        assert r["docs_ge"] == sum(v >= at for v in n) and r["tokens_ge"] == sum(v for v in n if v >= at)
        assert r["docs_le"] == sum(v <= at for v in n) and r["truncated_total"] == sum(min(v, at) for v in n)
    for q in (0.01, 0.5, 0.9, 1.0):
        s = sorted(n)
        assert tc.quantile(hist, q) == next(v for v in s if sum(x <= v for x in n) >= q * len(n))
    for r in tc.at_limits(hist, [0, 1, 7, 100, 10**6]).collect():
        assert r["truncated_total"] == sum(min(v, r["limit"]) for v in n) and r["fits"] == sum(v <= r["limit"] for v in n)


def test_no_rows(spark):
    hist = tc.length_histogram(tc.encoded(spark.createDataFrame([], "text string"), VOCABULARY))
    assert hist.count() == 0 and tc.quantile(hist, 0.5) is None
