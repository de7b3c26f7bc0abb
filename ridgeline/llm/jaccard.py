"""Exact Jaccard similarity join as a join in a metric space: regions around pivots, windows by the triangle inequality.

The distance 1 - J is a metric, and links are pairs within r = 1 - threshold. Texts that share nothing lie at distance 1 from
each other, so pivots that were drawn freely would tell nearly all documents nothing. Regions therefore begin as documents that
share a key that any linked pair must share:

- by the prefix of a set, its first elements in one order of all hashes, a share of r of them and one more. Elements that many
  documents have among their least-hashed ones come last in that order, so a passage that many quote makes no region; and,
- for documents that still have a key in a large region, by parts: the universe of hashes is cut into more parts than linked sets
  of that size can differ in, so linked sets agree on a whole part, which for other than near copies is most unlikely.

Small regions are joined in themselves, after filters that lose nothing. Larger ones that overlap make up one cell. In a cell
members become pivots in turn: members of a pivot's regions that are of other classes and in its windows |d(x, p) - d(y, p)| <= r of
earlier pivots are measured, and those within r are linked. A cell of up to CELL members is one task's work; a larger one is cut into
chunks of half that size, worked first each in itself and then, where a region still has several classes, two by two over all tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, map_rows, release, remove, text_bytes, working_tables, written
from .shingles import mix, overlap, shingle_sets

#: Members up to which a region is joined in itself, and pivots whose windows a cell keeps.
FEW, PIVOTS = 16, 16
#: Documents asked for, up to which their keys are broadcast; more are joined by shuffle.
FEW_KEYS = 100_000
#: Hot keys up to which they are broadcast; more are taken out by a join.
HOT_KEYS = 2_000_000
#: Members, and bytes of text, that a cell may have to be joined by one task.
CELL, CELL_BYTES = 4096, 32 << 20
#: Percent below which linked sets can differ in so many parts that most stay empty; there regions come from prefixes alone.
PARTS_FROM = 75
#: Documents of one pivot that one task measures, and sets that one task remembers to have seen.
MEMBERS, SEEN = 4096, 1 << 18


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n elements with any linked one."""
    return -(-percent * n // 100)


@lru_cache(maxsize=None)
def _bounds(percent: int) -> tuple[int, ...]:
    out = [1]
    while out[-1] < 2**40:
        out.append(out[-1] * 100 // percent + 1)
    return tuple(out)


def prefix(n: int, percent: int) -> int:
    """The number of a set's first elements, in any one order of all, of which any linked set has one among its own."""
    return n - needed(n, percent) + 1 if n else 0


@lru_cache(maxsize=None)
def _spare(differ: int, least: int) -> int:
    """Parts beyond those that can differ, so that sets of `least` elements rarely leave more parts than these empty."""
    spare = 3
    for _ in range(8):
        empty = (differ + 1 + spare) * math.exp(-least / (differ + 1 + spare))
        spare = int(empty + 4 * math.sqrt(empty)) + 3
    return spare


def part_keys(x: np.ndarray, percent: int) -> np.ndarray:
    """Keys of which linked, different sets share one at least: for the set's level of size and the next. Below PARTS_FROM percent
    they are the set's prefix, as parts would take a key for each empty part times each part."""
    if percent < PARTS_FROM:
        return mix(x[: prefix(len(x), percent)])
    bounds = np.array(_bounds(percent))
    own = int(np.searchsorted(bounds, len(x), "right")) - 1
    out = []
    for level in (own, own + 1):
        most = int(bounds[level + 1]) - 1
        differ = 2 * (100 - percent) * most // (100 + percent)
        if not differ or not len(x):
            continue  # only equal sets are linked
        spare = _spare(differ, int(bounds[max(level - 1, 0)]))
        m = differ + 1 + spare  # linked sets agree on spare + 1 parts at least
        tag = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
        high, low = (x >> np.uint64(32)) * np.uint64(m) >> np.uint64(32), (x & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)
        parts, sums = _sums(x, high)
        out.append(mix(mix(sums + tag) + parts))
        empty = np.setdiff1d(np.arange(m, dtype=np.uint64), parts, assume_unique=True)
        if len(empty) > spare:  # else one of the parts agreed on isn't empty; here an empty one counts with each part of another cut
            order = np.argsort(low, kind="stable")
            parts2, sums2 = _sums(x[order], low[order])
            all2 = np.zeros(m, np.uint64)
            all2[parts2.astype(np.int64)] = sums2
            second = mix(all2 + tag + np.arange(m, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            out += [mix(second + mix(np.full(m, e + np.uint64(77)))) for e in empty]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sums(x: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return part[first], np.add.reduceat(mix(x), first)


def _set_rows(shingle: int, percent: int):
    def make():
        seen: set[bytes] = set()

        def f(part):
            n, digest, keys = [], [], []
            for x in shingle_sets(part["raw"], shingle):
                d = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
                p = prefix(len(x), percent)
                # A task gives the elements of copies once; some more than p, should hot ones go last.
                keys.append([] if d in seen else x[: p + p // 2 + 8].view(np.int64))
                n.append(len(x))
                digest.append(d)
                if len(seen) < SEEN:
                    seen.add(d)
            return {"id": part["id"], "n": n, "digest": digest, "cid": [int.from_bytes(d[:8], "little", signed=True) for d in digest], "keys": keys}

        return f

    return make


def _prefix_size(percent: int) -> Column:
    return (F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1).cast("int")


def _linked(percent: int) -> Column:
    return 100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """v, label for every vertex of links (a, b): the least vertex reachable. Least labels go along links, and labels to their
    own labels, so the rounds follow the logarithm of a chain's length; nothing but minima is gathered at a vertex."""
    edges = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels["v"] == near["a"]).select("v", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("further"))
        step = written(step.join(jump, "label", "left").select("v", "was", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        done = step.where("label < was").isEmpty()
        labels = step.select("v", "label")
        if done:
            return labels


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, percent: int = 85) -> DataFrame:
    """key, n_shingles and component_id (the least key reachable by links), a row for each row of docs.

    A text's set: its distinct `shingle`-word shingles, A-Z lower-cased, as 64-bit hashes; with fewer words the whole sequence;
    without words or text the set is empty, linked with nothing, and the component is the row's own. Sets link when
    100 * intersection >= percent * union. Equal sets, whole copies among them, are one class from the start. Rows with repeated
    keys are rows of their own; null keys belong to components, whose least key leaves them out; a component of null keys
    alone is null. Texts of any length are whole; other columns, whatever their names, are ignored. No rows give no rows.
    """
    with working_tables(docs.sparkSession) as keep:
        return keep(written(_classes(docs, key, text, shingle, percent), "jaccard"))


def _classes(docs: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    slim = docs.select(docs[key].alias("id"), text_bytes(docs[text]).alias("raw"))
    kind = slim.schema["id"].dataType.simpleString()
    every = written(map_rows(slim, _set_rows(shingle, percent), f"id {kind}, n bigint, digest binary, cid bigint, keys array<bigint>", carry=["id"]), "sets")
    sets = written(every.select("id", "n", "digest", "cid"), "sets-slim")
    classes = sets.where("n > 0").groupBy("digest").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("cid").alias("cid"))
    classes = written(classes.withColumn("vid", F.monotonically_increasing_id()), "classes")

    pairs, crowded = _with_company(every, sets, slim, shingle, percent)
    named = classes.select("cid", "vid")
    pairs = pairs.join(named.toDF("a", "va"), "a").join(named.toDF("b", "vb"), "b").select(F.col("va").alias("a"), F.col("vb").alias("b"))
    pairs, crowded = written(pairs, "pairs"), written(crowded.join(named, "cid").select("vid"), "crowded")
    # The texts of the documents that are still in question, one for each class.
    ask = pairs.select(F.col("a").alias("vid")).union(pairs.select("b")).union(crowded).distinct()
    texts = _texts(slim, sets, classes.join(ask, "vid").select("vid", "digest"), shingle, "vid")
    links = _links(spark, pairs, crowded, classes, texts, shingle, percent)
    remove(texts)

    labels = components(spark, links)
    linked = written(labels.join(classes.select(F.col("vid").alias("v"), "digest", "least"), "v"), "linked")
    # The least key of every component, dealt over salts so that a hot component's classes don't meet in one task.
    least = linked.groupBy("label").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    named = linked.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(16)).cast("int")).join(least, ["label", "salt"]).select("digest", "component_id")
    alone = classes.join(linked, "digest", "left_anti").select("digest", F.col("least").alias("component_id"))
    full = sets.where("n > 0").select("id", "n", "digest").join(named.union(alone), "digest").select("id", "n", "component_id")
    out = full.union(sets.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _with_company(every: DataFrame, sets: DataFrame, slim: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """a, b: cids of classes that may be linked by elements that few share; and cid, hot: of classes with elements of their prefixes that
    many share, and how many. Removes `every`."""
    rows = every.where(F.size("keys") > 0).withColumn("p", _prefix_size(percent))
    # Elements that many documents have among their first come last in the order.
    firsts = rows.select(F.explode(F.slice("keys", F.lit(1), F.col("p"))).alias("k"))
    hot = written(firsts.groupBy("k").agg(F.count("*").alias("times")).where(F.col("times") > FEW).select("k"), "hot")
    cool = _cool_here(rows, hot) if hot.count() <= HOT_KEYS else _cool_by_join(rows, hot)
    cool = written(cool.withColumn("done", (F.size("keys") >= F.col("p")) | (F.col("known") >= F.col("n"))), "cool")
    remove(every)
    # Where the elements at hand don't suffice, the whole set is gone through.
    short = cool.where("not done").select("cid", "digest", "n", "p")
    more = _texts(slim, sets, short.select("cid", "digest").distinct(), shingle, "cid")

    def whole():
        def f(part):
            return {"cid": part["cid"], "keys": [x.view(np.int64) for x in shingle_sets(part["raw"], shingle)]}

        return f

    more = map_rows(more, whole, "cid bigint, keys array<bigint>").select("cid", F.posexplode("keys").alias("rank", "k")).join(hot, "k", "left_anti")
    more = short.select("cid", "n", "p").distinct().join(_lists(more, "cid"), "cid", "left")
    more = more.select("cid", "n", "p", F.slice(F.coalesce("keys", F.array().cast("array<bigint>")), F.lit(1), F.col("p")).alias("keys"))
    prefixes = cool.where("done").select("cid", "n", "p", "keys").unionByName(more)

    # One exchange by element serves for telling what is shared, for counting it, and for meeting.
    own = Window.partitionBy("k")
    entries = prefixes.select("cid", "n", F.posexplode("keys").alias("rank", "k")).repartition("k")
    met = entries.withColumn("lo", F.min("cid").over(own)).withColumn("hi", F.max("cid").over(own)).where("lo < hi").drop("lo", "hi")
    shared = written(met.dropDuplicates(["k", "cid"]).withColumn("times", F.count("*").over(own)), "shared")
    # Elements that many share, and hot ones that a prefix would go on with, may be shared without being counted below.
    unseen = shared.where(F.col("times") > FEW).select("cid", F.lit(1).alias("u"))
    unseen = unseen.unionByName(prefixes.where(F.size("keys") < F.col("p")).select("cid", (F.col("p") - F.size("keys")).alias("u")).distinct())
    crowded = written(unseen.groupBy("cid").agg(F.sum("u").alias("hot")), "crowded")
    remove(cool)
    few = shared.where(F.col("times") <= FEW).join(crowded, "cid", "left").select("k", "cid", "n", "rank", F.coalesce("hot", F.lit(0)).alias("hot"))
    x, y = (few.select("k", *[F.col(c).alias(f"{c}_{s}") for c in ("cid", "n", "rank", "hot")]) for s in "xy")
    size_ok = (100 * F.col("n_x") >= percent * F.col("n_y")) & (100 * F.col("n_y") >= percent * F.col("n_x"))
    both = x.join(y, "k").where((F.col("cid_x") < F.col("cid_y")) & size_ok)
    both = both.groupBy(F.col("cid_x").alias("a"), F.col("cid_y").alias("b")).agg(
        F.count("*").alias("c"), *[F.max(v).alias(v) for v in ("rank_x", "rank_y")], *[F.first(v).alias(v) for v in ("n_x", "n_y", "hot_x", "hot_y")]
    )
    # What is known to differ: the elements up to the last shared one, and the rest of the prefix that ends first.
    length = lambda n: n - F.ceil(n * percent / F.lit(100)) + 1
    differ = F.col("rank_x") + F.col("rank_y") + 2 - 2 * F.col("c") + F.least(length(F.col("n_x")) - 1 - F.col("rank_x"), length(F.col("n_y")) - 1 - F.col("rank_y"))
    may = (100 + percent) * (differ - 3 * F.least("hot_x", "hot_y")) <= (100 - percent) * (F.col("n_x") + F.col("n_y"))
    pairs = written(both.where(may).select("a", "b"), "pairs")
    remove(shared)
    return pairs, crowded


def _lists(rows: DataFrame, by: str) -> DataFrame:
    """`by`, keys in order of rank, from rows of it, rank and k: a set's elements, of one document."""
    return rows.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "k"))), lambda x: x["k"]).alias("keys"))


def _shipped(hot: DataFrame):
    """At most HOT_KEYS elements, ascending."""
    return hot.sparkSession.sparkContext.broadcast(np.sort(hot.toArrow().column("k").to_numpy()))


def _held(x: np.ndarray, those: np.ndarray) -> np.ndarray:
    return those[np.minimum(np.searchsorted(those, x), len(those) - 1)] == x if len(those) else np.zeros(len(x), bool)


def _cool_here(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """cid, digest, n, p, known (elements at hand) and keys, the first p of them that aren't hot."""
    shipped = _shipped(hot)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad = shipped.value
        for batch in batches:
            known = np.diff(batch.column("keys").offsets.to_numpy())
            x = batch.column("keys").flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), known)
            cool = ~_held(x, bad)
            upto = np.concatenate([[0], np.cumsum(cool)])
            nth = upto[1:] - upto[np.concatenate([[0], np.cumsum(known)])][row]
            cool &= nth <= batch.column("p").to_numpy()[row]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[cool], minlength=batch.num_rows))])
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x[cool], pa.int64()), type=arrow.field("keys").type)
            same = [batch.column(c) for c in ("cid", "digest", "n", "p")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(known, pa.int32()), keys], schema=arrow)
        release()

    schema = "cid bigint, digest binary, n bigint, p int, known int, keys array<bigint>"
    arrow = arrow_schema(schema)
    return rows.select("cid", "digest", "n", "p", "keys").mapInArrow(run, schema)


def _cool_by_join(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """The same for any number of hot elements."""
    rows = rows.dropDuplicates(["digest"])
    cool = _lists(rows.select("digest", F.posexplode("keys").alias("rank", "k")).join(hot, "k", "left_anti"), "digest").withColumnRenamed("keys", "cool")
    keys = F.slice(F.coalesce("cool", F.array().cast("array<bigint>")), F.lit(1), F.col("p"))
    return rows.join(cool, "digest", "left").select("cid", "digest", "n", "p", F.size("keys").alias("known"), keys.alias("keys"))


def _texts(slim: DataFrame, sets: DataFrame, asked: DataFrame, shingle: int, name: str) -> DataFrame:
    """name, raw: for each class asked for (name, digest), one document's text."""
    one = sets.join(asked.withColumnRenamed(name, "ask"), "digest").groupBy("ask", "digest").agg(F.min_by(F.struct("id"), F.struct(F.col("id").isNull(), "id")).alias("o"))
    one = written(one.select("ask", "digest", F.col("o.id").alias("oid")), "asked")
    if one.count() <= FEW_KEYS:  # rows of fixed-size keys, so the documents needn't move
        one = F.broadcast(one)
    docs_of = slim.join(one, slim["id"].eqNullSafe(one["oid"])).select("ask", "digest", "raw")

    def same_set():
        def f(part):
            keep = [i for i, s in enumerate(shingle_sets(part["raw"], shingle)) if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == part["digest"][i]]
            return {"ask": [part["ask"][i] for i in keep], "raw": [part["raw"][i] for i in keep]}

        return f

    # A key may repeat with other texts, so the set decides which text is the class's.
    return written(map_rows(docs_of, same_set, "ask bigint, raw binary").dropDuplicates(["ask"]).withColumnRenamed("ask", name), "texts")


def _links(spark: SparkSession, pairs: DataFrame, crowded: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """a, b: links enough to connect what is connected: pairs that are linked, and those that large regions add."""
    # Regions by parts, for documents that have a key of a large region.
    def parts():
        def f(part):
            got = [part_keys(s, percent) for s in shingle_sets(part["raw"], shingle)]
            return {"vid": part["vid"], "keys": [g.view(np.int64) for g in got], "n": part["n"]}

        return f

    of_crowded = texts.join(crowded, "vid").join(classes.select("vid", "n"), "vid")
    region = map_rows(of_crowded, parts, "vid bigint, n bigint, keys array<bigint>").select("vid", "n", F.explode("keys").alias("k"))
    region = written(region, "parts")
    again = region.groupBy("k").agg(F.count("*").alias("times")).where("times > 1")
    region = written(region.join(again, "k"), "regions")
    size_ok = (100 * F.col("n_x") >= percent * F.col("n_y")) & (100 * F.col("n_y") >= percent * F.col("n_x"))
    x, y = (region.where(F.col("times") <= FEW).select("k", F.col("vid").alias(f"vid_{s}"), F.col("n").alias(f"n_{s}")) for s in "xy")
    more = x.join(y, "k").where((F.col("vid_x") < F.col("vid_y")) & size_ok).select(F.col("vid_x").alias("a"), F.col("vid_y").alias("b"))
    links = written(_measured(pairs.union(more).distinct(), texts, shingle).where(_linked(percent)).select("a", "b"), "links")
    crowds = written(region.where(F.col("times") > FEW).select("k", "vid"), "large-regions")
    if not crowds.isEmpty():
        lead = crowds.groupBy("k").agg(F.min("vid").alias("lead"))
        led = written(crowds.join(lead, "k").select("vid", "lead").distinct(), "led")
        # Each member goes to its least lead, and the leads of its regions go together: far fewer edges than members and regions.
        least = led.groupBy("vid").agg(F.min("lead").alias("m"))
        edges = least.select(F.col("vid").alias("a"), F.col("m").alias("b")).union(led.join(least, "vid").select("lead", "m").distinct())
        cells = components(spark, edges)
        sizes = written(texts.select("vid", F.length("raw").alias("size")).join(cells.withColumnRenamed("v", "vid"), "vid").join(least, "vid"), "sizes")
        small = (F.count("*") <= CELL) & (F.sum("size") <= CELL_BYTES)
        cells = written(sizes.join(sizes.groupBy("label").agg(small.alias("small")), "label"), "cells")
        # A large cell is cut into chunks, neighbours by region together, so that any two of them make up a small one.
        share = F.greatest(2 / F.lit(CELL), 2 * F.col("size") / F.lit(CELL_BYTES))
        upto = F.sum(share).over(Window.partitionBy("label").orderBy("m", "vid").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        chunks = cells.where("not small").select("vid", "label", F.floor(upto).alias("chunk"))
        chunks = written(cells.where("small").select("vid", "label", F.lit(0).cast("long").alias("chunk")).unionByName(chunks), "chunks")
        of = crowds.groupBy("vid").agg(F.collect_set("k").alias("ks"))
        at_once = texts.join(chunks, "vid").join(of, "vid").select("label", "chunk", "vid", "raw", "ks").groupBy("label", "chunk")
        links = links.union(at_once.applyInPandas(lambda pdf: _cell_links(pdf, shingle, percent), "a bigint, b bigint"))
        links = written(links, "links")
        large = chunks.join(cells.where("not small").select("vid"), "vid", "left_semi")
        if not large.isEmpty():
            links = written(links.union(_across_chunks(spark, crowds.join(large, "vid"), texts, links, shingle, percent)), "links")
    return links


def _measured(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """a, b, shared, na, nb and the distance d for distinct pairs of a document a and a pivot b. A pivot's text moves once for each
    MEMBERS of its documents."""
    count = pairs.groupBy("b").agg(F.count("*").alias("c"))
    many = count.where(F.col("c") > MEMBERS).select("b", F.ceil(F.col("c") / MEMBERS).cast("int").alias("chunks"))
    member = pairs.join(many, "b", "left").withColumn("chunk", F.pmod(F.xxhash64("a"), F.coalesce("chunks", F.lit(1))).cast("int"))
    member = member.join(texts.withColumnRenamed("vid", "a"), "a").select("b", "chunk", F.lit(1).alias("side"), "a", "raw")
    head = count.join(many, "b", "left").select("b", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("chunk"))
    head = head.join(texts.withColumnRenamed("vid", "b"), "b").select("b", "chunk", F.lit(0).alias("side"), F.col("b").alias("a"), "raw")
    rows = head.unionByName(member).repartition("b", "chunk").sortWithinPartitions("b", "chunk", "side")

    def scan():
        pivot = None

        def f(part):
            nonlocal pivot
            out: dict[str, list] = {c: [] for c in ("a", "b", "shared", "na", "nb", "d")}
            for a, b, side, x in zip(part["a"], part["b"], part["side"], shingle_sets(part["raw"], shingle)):
                if not side:
                    pivot = x
                    continue
                shared = overlap(pivot, x)
                for c, v in zip(out, (a, b, shared, len(x), len(pivot), 1 - shared / (len(x) + len(pivot) - shared))):
                    out[c].append(v)
            return out

        return f

    return map_rows(rows.select("a", "b", "side", "raw"), scan, "a bigint, b bigint, shared bigint, na bigint, nb bigint, d double", rows=128)


def _cell_links(pdf: pd.DataFrame, shingle: int, percent: int) -> pd.DataFrame:
    """Links enough to connect what is connected in a cell. Members become pivots in turn, those of most regions first. A pivot
    meets the members of its regions that are of another class and no pivots yet, but for those that the windows of the first
    PIVOTS pivots keep from it. Of two chunks (columns chunk and class, if there), members meet those of the other alone, and classes
    begin as they are known."""
    pdf = pdf.sort_values("vid")
    ids, sets, r = pdf["vid"].to_numpy(), list(shingle_sets([bytes(t) for t in pdf["raw"]], shingle)), (100 - percent) / 100
    n, size = len(ids), np.array([len(s) for s in sets])
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])  # no set is empty
    kinds, flat = np.unique(np.concatenate(sets), return_inverse=True)
    flat, mark = flat.astype(np.int32), np.zeros(len(kinds), bool)
    degree = np.array([len(k) for k in pdf["ks"]])
    owner = np.repeat(np.arange(n), degree)
    _, region = np.unique(np.concatenate([np.asarray(k, np.int64) for k in pdf["ks"]]), return_inverse=True)
    by = np.argsort(region, kind="stable")
    members = np.split(owner[by], np.flatnonzero(np.diff(region[by])) + 1)
    own = np.split(region, np.cumsum(degree)[:-1])
    label, links, met, side = np.arange(n), [], np.zeros(n, bool), None
    if "class" in pdf:
        label, side = np.unique(pdf["class"].to_numpy(), return_inverse=True)[1], pdf["chunk"].to_numpy()
    away, used = np.full((PIVOTS, n), np.nan), 0
    for x in np.argsort(-degree, kind="stable").tolist():
        met[x] = True
        near = np.zeros(n, bool)
        for k in own[x]:
            near[members[k]] = True
        near &= ~met & (label != label[x])
        others = np.flatnonzero(near if side is None else near & (side != side[x]))
        others = others[~(np.abs(away[:used, others] - away[:used, x : x + 1]) > r + 1e-9).any(0)]
        if not len(others):
            continue
        p = flat[begin[x] : begin[x] + size[x]]
        mark[p] = True
        hits = mark[np.concatenate([flat[begin[y] : begin[y] + size[y]] for y in others])]
        mark[p] = False
        shared = np.add.reduceat(hits, np.concatenate([[0], np.cumsum(size[others])[:-1]]), dtype=np.int64)
        union = size[others] + size[x] - shared
        if used < PIVOTS:
            away[used, others], away[used, x] = 1 - shared / union, 0.0
            used += 1
        for y in others[100 * shared >= percent * union].tolist():
            if label[y] != label[x]:
                links.append((ids[x], ids[y]))
                label[label == label[y]] = label[x]
    del flat, sets, away
    release()
    return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)


def _across_chunks(spark: SparkSession, region: DataFrame, texts: DataFrame, links: DataFrame, shingle: int, percent: int) -> DataFrame:
    """a, b: links enough to connect what large cells connect between chunks. region: k, vid, label of the cell, chunk; links: those
    known, the ones within chunks among them. Two chunks meet in one task, if a region of several classes lies in both."""
    classes = components(spark, links).select(F.col("v").alias("vid"), F.col("label").alias("class"))
    region = region.join(classes, "vid", "left").withColumn("class", F.coalesce("class", "vid"))
    several = region.groupBy("k").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("k")
    region = written(region.join(several, "k"), "regions-of-several")
    parts = region.select("k", "label", "chunk").distinct()
    pairs = parts.withColumnRenamed("chunk", "x").join(parts.withColumnRenamed("chunk", "y"), ["k", "label"]).where("x < y")
    meetings = pairs.select("label", "x", "y").distinct().withColumn("chunk", F.explode(F.array("x", "y")))
    member = region.groupBy("vid", "label", "chunk", "class").agg(F.collect_set("k").alias("ks"))
    rows = member.join(texts, "vid").join(meetings, ["label", "chunk"]).select("label", "x", "y", "vid", "raw", "ks", "chunk", "class")
    return rows.groupBy("label", "x", "y").applyInPandas(lambda pdf: _cell_links(pdf, shingle, percent), "a bigint, b bigint")
