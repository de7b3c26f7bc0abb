"""Approximate nearest neighbours: an inverted file of coarse centroids, product-quantised residuals, exact reranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The index is fitted on this many vectors, or PER_LIST for each of its lists if those are more, and so on PER_LIST * MOST_LISTS at
#: most, those of least hash; every vector is indexed.
SAMPLE, PER_LIST, MOST_LISTS = 16_384, 16, 4_096
#: Vectors of a list that are scanned together, and queries of a list that are answered together.
CHUNK, BLOCK = 4_096, 1_024
#: Candidates of a list chunk that are reranked exactly first, for each asked neighbour; all that their quantisation error may put before these follow.
RERANK = 8
#: Queries, those of least hash, by which the number of probed lists is set.
ASKED = 512


@dataclass
class Index:
    """coarse: unit centroids. books: for each slice of the dimensions, its residual centroids. probes: lists a query looks at."""

    coarse: np.ndarray
    books: np.ndarray
    probes: int

    def lists(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each unit vector, nearest first."""
        near = x @ self.coarse.T
        if n == 1:
            return np.argmax(near, axis=1)[:, None]
        if n < near.shape[1] // 4:
            best = np.argpartition(-near, n - 1, axis=1)[:, :n]
            best.sort(axis=1)
            order = np.argsort(-np.take_along_axis(near, best, axis=1), axis=1, kind="stable")
            return np.take_along_axis(best, order, axis=1)
        return np.argsort(-near, axis=1, kind="stable")[:, :n]

    def codes(self, residual: np.ndarray) -> np.ndarray:
        m, k, w = self.books.shape
        out = np.empty((len(residual), m), np.uint8)
        for j in range(m):
            part = residual[:, j * w : (j + 1) * w]
            out[:, j] = np.argmin(((self.books[j] ** 2).sum(1) - 2 * part @ self.books[j].T), axis=1) if len(part) else 0
        return out

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Asymmetric tables: the inner product of each query's slices with every code's centroid."""
        m, k, w = self.books.shape
        return np.einsum("qmw,mkw->qmk", queries.reshape(len(queries), m, w), self.books)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, unit: bool) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - (0 if unit else 0.5 * (centres**2).sum(1)), axis=1)
        count = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, weights=x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def wanted_lists(rows: int) -> int:
    return int(min(max(1, 2 * rows**0.5), MOST_LISTS))


def fit(sample: np.ndarray, rows: int, asked: np.ndarray, neighbours: int = 5, slices: int = 16, codes: int = 256, recall: float = 0.98, seed: int = 6) -> Index:
    """An index for `rows` vectors from a sample of unit vectors. Lists follow the root of rows. A query probes as many lists as `recall`
    of the nearest neighbours in the sample of `asked`, unit queries, need, and a quarter more: queries may lie apart from most rows."""
    rng, dim = np.random.default_rng(seed), sample.shape[1]
    slices = max(s for s in range(1, min(slices, dim) + 1) if dim % s == 0)
    lists = max(1, min(wanted_lists(rows), len(sample) // PER_LIST))
    coarse = _kmeans(sample, lists, 8, rng, unit=True)
    residual = sample - coarse[np.argmax(sample @ coarse.T, axis=1)]
    w = dim // slices
    books = np.stack([_kmeans(residual[:, j * w : (j + 1) * w], min(codes, 256), 6, rng, unit=False) for j in range(slices)])
    like = asked @ sample.T
    like[like > 1 - 1e-12] = -2.0  # the query itself, and its copies, which lie in the list that it probes first
    near = np.argsort(-like, axis=1)[:, :neighbours]
    place = np.argsort(np.argsort(-(asked @ coarse.T), axis=1, kind="stable"), axis=1)
    home = np.argmax(sample @ coarse.T, axis=1)
    found = np.take_along_axis(like, near, axis=1) > -2.0
    need = np.sort(np.take_along_axis(place, home[near], axis=1)[found]) + 1
    probes = int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) if len(need) else 1
    return Index(coarse, books, min(lists, max(1, probes + probes // 4 + 1)))


def usable(v: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda c: c != 0)


def search(vectors: DataFrame, is_query: Column, neighbours: int = 5, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score: for each query its nearest found rows, by cosine in double precision on the
    original vectors, ties to the smaller key. Candidates are all rows but the query's own key; with no more candidates than
    asked, all are found.

    Rows whose vector is null, zero, or holds a null or non-finite component take no part, nor do null keys, nor vectors whose
    length isn't the commonest (the longer of equally common ones). Rows that repeat a key are separate rows. Other columns
    are ignored. No usable rows or queries give no rows.
    """
    dims = vectors.where(usable(F.col(vector))).groupBy(F.size(vector).alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    empty = vectors.select(F.col(key).alias("query_id"), F.lit(1).cast("int").alias("rank"), F.col(key).alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    if dims is None:
        return empty
    dim, rows = dims["n"], dims["c"]
    good = vectors.where(usable(F.col(vector)) & (F.size(vector) == dim) & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks"))
    sample = max(sample, PER_LIST * wanted_lists(rows))
    seen = _of_least_hash(good, sample, rows)
    if not len(seen):
        return empty
    asking = _of_least_hash(good.where("asks"), ASKED, rows)
    if not len(asking):
        return empty
    index = fit(_unit(np.stack(seen["v"].to_numpy())), rows, _unit(np.stack(asking["v"].to_numpy())), neighbours)
    shipped = vectors.sparkSession.sparkContext.broadcast(index)

    def assign(it):
        for pdf in it:
            if len(pdf):
                v = np.stack(pdf["v"].to_numpy())
                u, ix = _unit(v), shipped.value
                home = ix.lists(u, 1)[:, 0]
                codes = ix.codes(u - ix.coarse[home])
                yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "list": home.astype(np.int32), "codes": [c.tobytes() for c in codes], "asks": pdf["asks"]})

    kind = good.schema["id"].dataType.simpleString()
    filed = written(good.mapInPandas(assign, f"id {kind}, v array<double>, list int, codes binary, asks boolean"), "vectors")

    # A list of any length is cut into chunks by a hash of the key, so that a common vector's list is many tasks' work.
    size = filed.groupBy("list").agg(F.count("*").alias("size")).select("list", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks"))
    held = filed.join(F.broadcast(size), "list").select("list", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), "id", "v", "codes")

    def probe(it):
        for pdf in it:
            if len(pdf):
                ix = shipped.value
                yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "list": [r.astype(np.int32) for r in ix.lists(_unit(np.stack(pdf["v"].to_numpy())), ix.probes)]})

    asked = filed.where("asks").select("id", "v").mapInPandas(probe, f"id {kind}, v array<double>, list array<int>")
    asked = asked.select("id", "v", F.explode("list").alias("list")).join(F.broadcast(size), "list")
    asked = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id", "v")
    take = neighbours * RERANK

    def answer(have: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = []
        if len(have) and len(ask):
            ix = shipped.value
            have = have.sort_values("id", kind="stable")
            ids, v = have["id"].to_numpy(), np.stack(have["v"].to_numpy())
            codes = np.frombuffer(b"".join(have["codes"]), np.uint8).reshape(len(have), -1)
            u, norm = _unit(v), np.linalg.norm(v, axis=1)
            centre = ix.coarse[int(have["list"].iloc[0])]
            # The quantised unit vectors aren't of length 1: guesses are cosines with them. No inner product is off by more than the error's length.
            stored = (centre.reshape(codes.shape[1], -1) + ix.books[np.arange(codes.shape[1]), codes]).reshape(len(u), -1)
            length, error = np.maximum(np.linalg.norm(stored, axis=1), 1e-9), np.linalg.norm(u - stored, axis=1) + 1e-12
            for at in range(0, len(ask), BLOCK):
                part = ask.iloc[at : at + BLOCK]
                q = np.stack(part["v"].to_numpy())
                unit = _unit(q)
                table, near = ix.tables(unit), unit @ centre
                for i, qid in enumerate(part["id"].to_numpy()):
                    inner = near[i] + table[i][np.arange(codes.shape[1]), codes].sum(1)
                    others = np.flatnonzero(ids != qid)
                    best = others
                    if len(others) > take:
                        first = others[np.argpartition(-(inner / length)[others], take - 1)[:take]]
                        least = np.partition(u[first] @ unit[i], -neighbours)[-neighbours]
                        best = others[(inner + error)[others] >= least]  # whatever may be as near as those
                        exact = u @ unit[i] if 4 * len(best) > len(u) else None
                        exact = u[best] @ unit[i] if exact is None else exact[best]
                        best = best[exact >= np.partition(exact, -neighbours)[-neighbours] - 1e-12]  # ties by key follow on the measure itself
                    score = (v[best] * q[i]).sum(1) / (norm[best] * np.sqrt((q[i] * q[i]).sum()))
                    order = np.lexsort((ids[best], -score))[:neighbours]
                    out.append((np.full(len(order), qid), ids[best][order], score[order]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        return pd.DataFrame({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    found = held.groupBy("list", "chunk").cogroup(asked.groupBy("list", "chunk")).applyInPandas(answer, f"query_id {kind}, vec_id {kind}, score double")
    # The best of each salt first, so that a query over many chunks is never gathered whole.
    least = lambda rows: F.slice(F.sort_array(F.collect_list(rows)), 1, neighbours)
    part = found.groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(32)).alias("salt")).agg(least(F.struct((-F.col("score")).alias("s"), "vec_id")).alias("b"))
    best = part.select("query_id", F.explode("b").alias("x")).groupBy("query_id").agg(least(F.col("x")).alias("b"))
    return best.select("query_id", F.posexplode("b").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def _of_least_hash(good: DataFrame, sample: int, rows: int) -> pd.DataFrame:
    """The distinct vectors of least hash, so that a common vector is one. Hashes beyond what a sample of distinct vectors would reach are
    left where they are; only if too few are left, as where few vectors are distinct, all are looked at."""
    h, share = F.xxhash64("v"), 4 * sample / max(rows, 1)
    least = lambda df: df.select("v").distinct().orderBy(h, "v").limit(sample).toPandas()
    if share < 1:
        found = least(good.where(h < F.lit(int(-(2**63) + share * 2**64))))
        if len(found) == sample:
            return found
    return least(good)


def _unit(v: np.ndarray) -> np.ndarray:
    scale = np.abs(v).max(1, keepdims=True)  # before the norm, which may overflow
    v = v / scale
    return v / np.linalg.norm(v, axis=1, keepdims=True)
