import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipe
from ridgeline.llm import registry, toxicity
from ridgeline.llm.common import table, written

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), [table(spark, SF, "documents")]
    for name, f in pipe.STAGES:
        docs = written(f(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in pipe.STAGES] == ["toxicity", "jaccard", "secrets", "mixing", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_toxic_documents_go(spark, stages):
    lexicon = toxicity.fit(stages[0], table(spark, SF, "labels"))
    score = lexicon.matcher()
    want = {r["doc_id"] for r in stages[0].collect() if score(r["text"])[0] < 0.5}
    assert {r["doc_id"] for r in stages[1].collect()} == want


def test_one_of_each_group_stays(stages):
    sets = {}
    for r in stages[1].collect():
        w = r["text"].encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    kept, parent = {r["doc_id"] for r in stages[2].collect()}, {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b:
                c = len(sets[a] & sets[b])
                if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    assert kept == {i for i in ids if find(i) == i}


def test_secrets_are_masked_and_the_rest_is_not(stages):
    before, after = ({r["doc_id"]: r for r in s.collect()} for s in stages[2:4])
    assert set(before) == set(after)
    for i, r in after.items():
        assert r["n_chars"] == (len(r["text"]) if "[SECRET]" in r["text"] else before[i]["n_chars"])
        assert r["text"] == before[i]["text"] or "[SECRET]" in r["text"]


def test_mix_and_packing(stages):
    size = lambda rows: sum(len(r["text"].encode().split()) for r in rows)
    before, after = stages[3].collect(), stages[4].collect()
    assert abs(size(after) - size(before)) < 0.1 * size(before)
    assert sum(r["length"] for r in stages[5].collect()) == size(after)


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (None, "q r s t u v", None, None, None), (2, None, "en", "s", 0), (3, "A B C D E F", "en", "s", 11)], stages_schema())
    got = pipe.one_of_each_group(spark, docs, SF)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == [(False, 1), (False, 2), (True, 0)]


def test_groups_go_by_row_and_not_by_id(spark):
    one, two = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(5, "one clean text linked to nothing else here"), (5, two + " b"), (3, two), (None, one), (None, one + " more"), (None, "a lone text of its own and no one's copy"),
            (7, "z " + one), (None, "p q r s t u v"), (None, "P q r s t u v"), (8, "k l m n o p"), (8, "K l m n o p"), (None, ""), (None, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], stages_schema()).repartition(4)
    got = pipe.one_of_each_group(spark, docs, SF)
    assert got.columns == docs.columns
    want = [rows[0], rows[2], rows[5], rows[6], (None, "P q r s t u v"), (8, "K l m n o p"), (None, ""), (None, " ")]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["text"])) for r in got.collect())


def stages_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_tables_pass(spark):
    docs = spark.createDataFrame([], stages_schema())
    for _, f in pipe.STAGES:
        docs = f(spark, docs, SF)
        assert docs.count() == 0
        if "text" not in docs.columns:
            break


def test_registered(spark):
    assert set(registry.QUERIES) | {"pipeline"} <= set(entry.queries())
    ops = sorted(int(q[2:].split("_")[0]) for q in registry.QUERIES)
    assert ops == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("conversations", "documents"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    q, found = registry.QUERIES[name](spark, SF), c.sql(registry.ORACLES[name])
    assert sorted(q.columns) == sorted(found.columns)
    rows = lambda every, columns: sorted(str(tuple(r[columns.index(x)] for x in sorted(columns))) for r in every)
    assert rows(q.collect(), q.columns) == rows(found.fetchall(), found.columns)
